"""Windows of the token alignment: all new ones of a slice at once, without a Python step per token."""

import hashlib

import numpy as np
from public_tokenizers import path as vocabulary

from brightlake.llm import align

A, B = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")
TEXTS = ["one plain text, twice plain", "", "a▁b keeps no bytes", None, "two  spaces", "ﬁne ½ too", "Straße 12.5 <unk> x\ty", "one plain text"]


def test_new_windows_are_aligned_together(monkeypatch):
    own, calls, learn = align.Aligner(A, B), [], align.Aligner.learn
    monkeypatch.setattr(align.Aligner, "learn", lambda self, a, n_a, b, n_b: (calls.append(len(n_a)), learn(self, a, n_a, b, n_b)))
    first = own.run(TEXTS)
    again = own.run(TEXTS)
    assert calls[0] == len(own.memo) == len(own.texts) and calls[1:] == [0]  # none twice
    assert first["groups_sha256"] == again["groups_sha256"] and first["pairs"] == again["pairs"]


def test_ids_of_many_texts_equal_those_of_each():
    own = align.Aligner(A, B)
    (a, b), counts = own.encode(TEXTS)
    want = [own.tokens(t) for t in TEXTS]
    assert [n.tolist() for n in counts] == [[len(w[k]) for w in want] for k in (0, 1)]
    assert a.tolist() == [i for w in want for i in w[0]] and b.tolist() == [i for w in want for i in w[1]]
    assert [bool(w[0]) for w in want][:4] == [True, False, False, False]


def test_groups_and_links_of_a_window():
    own = align.Aligner(A, B)
    for text in TEXTS:
        a, b = own.tokens(text)
        if not a:
            continue
        ends = [np.cumsum([len(t[i]) for i in ids]).tolist() for t, ids in ((own.a_bytes, a), (own.b_bytes, b))]
        groups, links, i, j = [[[a[0]], [b[0]]]], [a[0] * own.n_b + b[0]], 0, 0
        while (i, j) != (len(a) - 1, len(b) - 1):
            x, y = ends[0][i], ends[1][j]
            i, j = i + (x <= y), j + (y <= x)
            if x == y:
                groups.append([[], []])
            groups[-1][0] += [a[i]] * (x <= y)
            groups[-1][1] += [b[j]] * (y <= x)
            links.append(a[i] * own.n_b + b[j])
        got = own.run([text])
        named = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        assert got["groups_sha256"] == [hashlib.sha256(named.encode()).hexdigest()]
        kinds, n = np.unique(links, return_counts=True)
        assert np.frombuffer(got["pairs"][0], "<u4").tolist() == kinds.tolist() and np.frombuffer(got["counts"][0], "<u4").tolist() == n.tolist()
