"""Encoding by distinct pieces against the tokenizers library; reading shards by their spans."""

import random

import numpy as np
from public_tokenizers import path as vocabulary
from tokenizers import Tokenizer

from brightlake.llm import bpe, repair

PATH = vocabulary("word_bpe_49k.json")


def library_ids(texts):
    tok = Tokenizer.from_file(PATH)
    return [np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_pieces_equal_the_library():
    around = (("", ""), ("ab", "cd"), ("Ab ", "' s"), ("5", "'s"), ("'", "S"), ("a'", ""))
    odd = [f"{a}{chr(c)}{b}" for c in range(0x250) for a, b in around]
    odd += [f"x{chr(c)}y {chr(c)}'s z" for c in [*range(0x250, 0x600), *range(0x2000, 0x2100), *range(0xFF00, 0xFF60), 0x1F600]]
    rng = random.Random(5)
    bits = ["'", "s", "t", "re", "ve", "ll", " ", "\n", "a", "B", "İ", "Ɓ", "5", "²", ".", '"', "_", "<|endoftext|>", "<|", "é", "é", "\xa0", "\x85", "\x1c", "“", "ΑΣ ", "</w>", "Ã©"]
    odd += ["".join(rng.choices(bits, k=rng.randint(1, 14))) for _ in range(4000)] + ["", "   ", "qxzj" * 3000, "'" * 500, "7" * 500]
    assert bpe.PieceEncoder(PATH).encode(odd) == library_ids(odd)


def test_pieces_are_learned_once_whatever_stands_beside_them(monkeypatch):
    enc, learned, learn = bpe.PieceEncoder(PATH), [], bpe.PieceEncoder.learn
    monkeypatch.setattr(bpe.PieceEncoder, "learn", lambda self, words: (learned.extend(words), learn(self, words)))
    enc.encode(["Zorblat, zorblat. (zorblat) zorblat's", "zorblat!! zorblat;"])
    enc.encode(["ZORBLAT: zorblat|zorblat"])
    assert learned.count("zorblat") == 1 and len(learned) == len(set(learned))


def test_memo_of_pieces_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "PIECES_HELD", 50)
    enc, rng = bpe.PieceEncoder(PATH), random.Random(1)
    texts = [" ".join("".join(rng.choices("abcdé", k=4)) for _ in range(40)) + "." for _ in range(60)]
    got = []
    for i in range(0, 60, 3):
        got += enc.encode(texts[i : i + 3])
        assert len(enc.known) == len(enc.size) <= 50 + 130
    assert got == library_ids(texts)


def test_ids_are_read_by_the_spans_of_the_file():
    rng = np.random.default_rng(2)
    for ids in (rng.integers(0, 4, 5000), np.tile(np.arange(30), 100), np.arange(5)):
        last = np.zeros(len(ids), bool)
        last[-1] = True
        s, _, rules, rounds = repair.compress(ids, last)
        assert (repair.expand(s, rules, rounds, repair.spans_of(rules)) == ids).all()
