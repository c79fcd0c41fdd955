"""Token alignment, language identification and whitening against brute force and held-out rows; edge cases."""

import collections
import hashlib
import itertools
import math

import numpy as np
import pytest

from brightlake.llm import align, language, queries, whiten

SF = "/root/testdata/sf0.001"
A, B = queries.vocabulary("byte_bpe_50k.json"), queries.vocabulary("piece_bpe_32k.model")
ODD = [
    None, "", " ", "\n\n  x", "a", "The same. text, twice", "The same. text, twice", "x" * 3000, "word " * 4000, "9 8" * 500, "A<|endoftext|>b <s> </s>",
    "Ünï cödé  two", "▁abc", "日本語 テスト \U0001f600 hi\U0001f600.", "tab\tnew\r\nline\x00 \x85\xa0end ", "12 % !!", "don't I'll 'S", "  lead and trail  ",
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names clash with results."""
    rows = [(i, t, "en" if i % 2 else None, i) for i, t in enumerate(ODD)] + [(5, ODD[5], "en", 5), (None, "no id", None, None), (None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score long").withColumnsRenamed({"score": "n_a"})


# -- alignment --------------------------------------------------------------------------------------------


def brute_alignment(texts):
    """The rows of the report by whole tokenisation with the libraries and comparison of byte ranges."""
    import sentencepiece
    from tokenizers import Tokenizer

    tok, sp = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    tok.encode_special_tokens = True
    letters = {c: b for b, c in enumerate(align._byte_letters())}
    spell_a = lambda i: bytes(letters[c] for c in tok.id_to_token(i))
    spell_b = lambda i: bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()
    found = []
    for t in texts:
        a, b = (tok.encode(f" {t}", add_special_tokens=False).ids, sp.encode(t)) if t else ([], [])
        x, y = [spell_a(i) for i in a], [spell_b(i) for i in b]
        if b"".join(x) != b"".join(y) or b"".join(x) != f" {t}".encode():
            a, b, x, y = [], [], [], []
        ends = [list(itertools.accumulate(map(len, z))) for z in (x, y)]
        links, j = [], 0
        for i, (end, size) in enumerate(zip(ends[0], map(len, x))):
            while j < len(b) and ends[1][j] <= end - size:
                j += 1
            links += [(a[i], b[k]) for k in itertools.takewhile(lambda k: ends[1][k] - len(y[k]) < end, range(j, len(b)))]
        groups, i, j = [], 0, 0
        for e in sorted(set(ends[0]) & set(ends[1])):
            p, q = ends[0].index(e) + 1 if len(a) < 500 else int(np.searchsorted(ends[0], e)) + 1, int(np.searchsorted(ends[1], e)) + 1
            groups.append(",".join(map(str, a[i:p])) + "|" + ",".join(map(str, b[j:q])))
            i, j = p, q
        found.append((len(a), len(b), groups, links))
    count = collections.Counter(x for f in found for x in f[3])
    best = collections.Counter()
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    return [
        (n_a, n_b, len(g), len(x), sum(count[p] == best[p[1]] for p in x), sum(count[p] for p in x), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "")
        for n_a, n_b, g, x in found
    ]


COLUMNS = "n_a n_b n_groups n_links n_best count_sum groups_sha256".split()


@pytest.mark.parametrize("frequent", [1 << 20, 200, 0])
def test_alignment_equals_brute_force(spark, odd, frequent):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    rows = docs.collect()
    want = collections.Counter((r["doc_id"], *w) for r, w in zip(rows, brute_alignment([r["text"] for r in rows])))
    got = align.report(docs, A, B, frequent).collect()
    assert got[0].__fields__ == ["doc_id", *COLUMNS]
    assert collections.Counter(map(tuple, got)) == want


def test_alignment_of_odd_tables(spark, odd):
    got = align.report(odd, A, B).collect()
    assert len(got) == odd.count()
    assert all(r["n_a"] == 0 and r["groups_sha256"] == "" for r in got if r["doc_id"] in (0, 1, 12))
    assert align.report(odd.limit(0), A, B).collect() == []


def test_alignment_memo_is_bounded_and_windows_do_not_change_results(monkeypatch):
    own = align.Aligner(A, B)
    texts = [t for t in ODD if t] + ["x" * 40_000 + " y", "ab " * 3000]
    whole = own.run(texts)
    monkeypatch.setattr(align, "MEMO_BYTES", 0)
    assert [own.run([t])["groups_sha256"][0] for t in texts] == whole["groups_sha256"]
    assert len(own.memo) <= 2 and whole["n_links"] == [a + b - g for a, b, g in zip(whole["n_a"], whole["n_b"], whole["n_groups"])]


def test_pair_counts_do_not_depend_on_what_a_task_holds(spark):
    linked = align.links(spark.read.parquet(f"{SF}/documents.parquet"), A, B)
    counts = [sorted(map(tuple, align.pair_counts(linked, held).collect())) for held in (1 << 21, 100)]
    assert counts[0] == counts[1]


# -- language ---------------------------------------------------------------------------------------------


def test_language_of_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = queries.QUERIES["op12_language"](spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == docs.count() and len(held) > 200
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_held_out_labels_are_never_read(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    other = docs.withColumn("lang", F.when(language.held_out(F.col("doc_id")), F.lit("xx")).otherwise(F.col("lang"))).withColumn(
        "text", F.when(language.held_out(F.col("doc_id")), F.lit("qqq qqq")).otherwise(F.col("text"))
    )
    one, two = language.fit(docs), language.fit(other)
    assert one.langs == two.langs and np.array_equal(one.weights, two.weights) and np.array_equal(one.idf, two.idf) and one.temperature == two.temperature


def test_language_edges(spark, odd):
    model = language.fit(odd)
    got = {r["doc_id"]: r for r in language.identify(odd, model).collect()}
    assert all((got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0) for i in (0, 1, 2, 9, 15))
    assert got[8]["lang_pred"] == "en" and language.identify(odd, model).count() == odd.count()
    empty = language.fit(odd.limit(0))
    assert {r["lang_pred"] for r in language.identify(odd, empty).collect()} == {"und"}
    assert language.identify(odd.limit(0), model).collect() == []


def test_character_ngrams():
    assert language.characters("Ab, 1c!").tolist() == [0, ord("a"), ord("b"), 0, ord("c"), 0]
    codes = language.characters("ein kleiner text " * 300)
    at, n = language.counts_of(codes)
    assert n.sum() == sum(len(codes) - k + 1 for k in range(1, 5))
    long = language.characters("ein kleiner text " * 2000)
    whole = language.counts_of(long)
    try:
        language.PIECE, piece = 1000, language.PIECE
        parts = language.counts_of(long)
    finally:
        language.PIECE = piece
    assert np.array_equal(whole[0], parts[0]) and np.array_equal(whole[1], parts[1]) and set(at) <= set(whole[0])


def test_follow_the_leader_equals_the_written_out_rule():
    rng = np.random.default_rng(1)
    rows = [(np.sort(rng.choice(6, 3, replace=False)), rng.random(3), int(rng.integers(3))) for _ in range(40)]
    got, bias = language.follow_leader(rows, 3, epochs=2, lasso=0.01, ridge=0.02, buckets=6)
    z, n = [[0.0] * 3 for _ in range(7)], [[0.0] * 3 for _ in range(7)]

    def weight(i, k):
        one, two = (0.0, 0.0) if i == 6 else (0.01 * 80, 0.02 * 80)
        v = z[i][k]
        return 0.0 if abs(v) <= one else (math.copysign(one, v) - v) / ((language.BETA + math.sqrt(n[i][k])) / language.ALPHA + two)

    for at, x, y in rows * 2:
        own = [*zip(at.tolist(), x.tolist()), (6, 1.0)]
        w = {(i, k): weight(i, k) for i, _ in own for k in range(3)}
        e = [math.exp(sum(w[i, k] * v for i, v in own)) for k in range(3)]
        for i, v in own:
            for k in range(3):
                g = v * (e[k] / sum(e) - (k == y))
                z[i][k] += g - (math.sqrt(n[i][k] + g * g) - math.sqrt(n[i][k])) / language.ALPHA * w[i, k]
                n[i][k] += g * g
    assert np.allclose(got, [[weight(i, k) for k in range(3)] for i in range(6)]) and np.allclose(bias, [weight(6, k) for k in range(3)])
    assert (got == 0).any()


def test_temperature_undoes_scaling():
    rng = np.random.default_rng(2)
    z = rng.normal(size=(4000, 3))
    y = np.array([rng.choice(3, p=p) for p in language.softmax(z)])
    assert abs(language.best_temperature(5 * z, y) / 5 - 1) < 0.1


# -- whitening --------------------------------------------------------------------------------------------


def brute_whitening(vectors, weights=None):
    x = np.floor(1024 * np.array(vectors, float)).astype(np.int64) + 100_000
    w = np.ones(len(x), np.int64) if weights is None else weights
    n, s = int(w.sum()), (w[:, None] * x).sum(axis=0)
    centred = x - s / n
    e, u = np.linalg.eigh((centred * w[:, None]).T @ centred / n)
    e, u = e[::-1], u[:, ::-1]
    return n, ((n * x - s).astype(object) ** 2).sum(axis=1), centred @ u[:, :8] / np.sqrt(e[:8]), e / e.sum()


def test_whitening_equals_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet")
    raw = rows.collect()
    n, deviation, w, share = brute_whitening([r["embedding"] for r in raw])
    place = {r["vec_id"]: i for i, r in enumerate(raw)}
    got = whiten.whiten(rows).collect()
    assert got[0].__fields__ == "vec_id component n deviation whitened explained identity_error".split()
    assert collections.Counter(r["vec_id"] for r in got) == {v: 8 for v in place} and len({r["identity_error"] for r in got}) == 1
    for r in got:
        i, k = place[r["vec_id"]], r["component"] - 1
        assert (r["n"], r["deviation"]) == (n, deviation[i]) and abs(r["explained"] / share[k] - 1) < 1e-9 and r["identity_error"] < 1e-9
    signs = {k: np.sign(sum(r["whitened"] * w[place[r["vec_id"]], k] for r in got if r["component"] == k + 1)) for k in range(8)}
    assert all(abs(r["whitened"] - signs[r["component"] - 1] * w[place[r["vec_id"]], r["component"] - 1]) < 1e-8 for r in got)


def test_copies_weigh_as_often_as_they_occur_or_once(spark, monkeypatch):
    vectors = [[1.0, 2.0, 0.5], [0.0, 1.0, -1.0], [3.0, -2.0, 0.25], [1.0, 1.0, 1.0]]
    times = np.array([50, 1, 2, 3])
    rows = [(i, vectors[k]) for i, k in enumerate(np.repeat(range(4), times).tolist())]
    data = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for heavy in (1000, 3):  # with all vectors, and with one, joined by broadcast
        monkeypatch.setattr(whiten, "HEAVY", heavy)
        for weights, w in (("rows", times), ("distinct", np.ones(4, np.int64))):
            n, deviation, white, _ = brute_whitening(vectors, w)
            got = whiten.whiten(data, weights=weights).collect()
            assert len(got) == 3 * 56 and {r["n"] for r in got} == {n}
            for r in got:
                k = vectors.index(dict(rows)[r["vec_id"]])
                assert r["deviation"] == deviation[k] and abs(abs(r["whitened"]) - abs(white[k, r["component"] - 1])) < 1e-9


def test_whitening_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (None, [1.0, 2.0]), (2, [1.0, None]), (3, [nan, 1.0]), (4, [3.0, 1.0]), (4, [3.0, 1.0]), (5, [inf, 1.0]), (6, [1e300, 1.0]), (7, []), (8, [1.0, 2.0, 3.0]), (9, [5.0, -1.0])]
    data = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, n string, component int")
    got = whiten.whiten(data).collect()
    assert collections.Counter(r["vec_id"] for r in got) == {None: 2, 4: 4, 9: 2} and {r["n"] for r in got} == {4}
    assert whiten.whiten(data.limit(0)).collect() == [] and whiten.whiten(data.where("vec_id = 4")).collect() == []
    assert whiten.whiten(data.limit(0)).columns == whiten.whiten(data).columns
    far = [(i, [1e13 * i, float(i * i)]) for i in range(6)]
    got = whiten.whiten(spark.createDataFrame(far, "vec_id long, embedding array<double>")).collect()
    assert {r["deviation"] for r in got} == {None} and {r["n"] for r in got} == {6}


def test_exact_deviations_beyond_products_of_longs():
    x = np.array([[3_000_000_000, 0], [0, 1]], np.int64)
    assert whiten.deviations(x, 1, [3_000_000_000, 0]) == [0, 9_000_000_000_000_000_001]
    assert whiten.deviations(x, 2, [3_000_000_000, 1]) == [9_000_000_000_000_000_001, 9_000_000_000_000_000_001]
