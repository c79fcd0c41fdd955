"""The operators against brute force, the tokenizers library and held-out labels; edge cases."""

import collections
import hashlib
import html as entities
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from brightlake.llm import bpe, chat, decontaminate, html, lines, neardup, pii, queries, repair, toxicity, winnow
from brightlake.session import scratch_path
from tests.compare import compare

SF = "/root/testdata/sf0.001"
PATH = queries.vocabulary()
ODD = [
    None, "", " ", "\n\n", "a", "a", "The same. text, twice", "The same. text, twice", "x" * 3000, "word " * 4000, "9" * 3000, "1 " * 2000,
    "A<|endoftext|>b  <|startoftext|>", "ΣΑΣ J̌ x İstanbul don't I'll 'S", "a\x1cb . ..., x.,", "Ⅷ. Ǆ. ŉ. ſ.", "日本語 テスト \U0001f600 hi\U0001f600.",
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows and columns whose names clash with results."""
    rows = [(i, t, "x", i) for i, t in enumerate(ODD)] + [(3, "\n\n", "x", 3), (None, "no id", None, None), (None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, score string, n_words long")


def texts(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


# -- line dedup -------------------------------------------------------------------------------------------


def exact_lines(rows, least):
    """Lines to drop when every generalised line is its own template."""
    key = lambda line: re.sub("[0-9]+", "<*>", line.strip(" "))
    seen = collections.defaultdict(set)
    for doc, text in rows:
        for line in text.split("\n"):
            seen[key(line)].add((doc, text))
    return {k for k, v in seen.items() if k and len(v) >= least}


def test_recurring_lines_go_but_for_the_first(spark, docs):
    got = {r["doc_id"]: r for r in lines.drop_recurring(docs).collect()}
    rows = texts(docs)
    recurs = exact_lines(rows, lines.LEAST_DOCS)
    left = collections.Counter()
    for doc, text in rows:
        kept = (got[doc]["text"] or "").split("\n")
        assert got[doc]["n_lines"] == len(text.split("\n"))
        for line in kept:
            left[re.sub("[0-9]+", "<*>", line.strip(" "))] += 1
    assert recurs and all(left[k] <= 1 for k in recurs)
    unique = [doc for doc, text in rows if not any(re.sub("[0-9]+", "<*>", x.strip(" ")) in recurs for x in text.split("\n"))]
    assert sum(got[d]["n_dropped"] == 0 for d in unique) >= 0.98 * len(unique)


def test_variable_words_are_generalised(spark):
    fixed = "Posted here by {} on page {} of our great site about the weather"
    rows = [(i, f"own text {'abc'[i % 3]}{i}\n" + fixed.format(f"name{chr(97 + i)}", i)) for i in range(12)]
    got = lines.drop_recurring(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()
    assert "Posted" in got[0]["text"] and all("Posted" not in r["text"] for r in got[1:])


def test_templates_in_a_crowded_leaf(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    common = [word() for _ in range(40)]
    noise = [f"Posted here by {' '.join(rng.choices(common, k=9))}" for _ in range(300)]
    fixed = [[word() for _ in range(9)] for _ in range(6)]  # five of equal numbers, one in three documents

    def like(t, n):
        return [f"Posted here by {' '.join(rng.choice(common) if i in (1, 6) else w for i, w in enumerate(fixed[t]))}" for _ in range(n)]

    own = [(t, line) for t in range(6) for line in like(t, 40 if t < 5 else 3)]
    twice = "Seen on page {} of our great site about the weather"  # two distinct lines in three documents
    extra = [twice.format(x) for x in ("anna", "anna", "bert")]
    rows = list(enumerate([line for _, line in own] + noise + extra))
    got = {r["doc_id"]: r["n_dropped"] for r in lines.drop_recurring(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    kept = collections.Counter(t for i, (t, _) in enumerate(own) if not got[i])
    assert kept == {t: 1 for t in range(6)}
    assert not any(got[len(own) + i] for i in range(len(noise)))
    assert [got[len(own) + len(noise) + i] for i in range(3)] == [0, 1, 1]


def test_long_lines_look_into_all_their_groups(spark):
    # forty further words in eleven runs: only the last run is free of variable words, and of each of four
    # lines five other runs stand in more lines than the template has
    letters = lambda n: "".join(chr(97 + int(d)) for d in str(n))
    begin = [i * 40 // 11 for i in range(12)]
    targets = [[f"v{letters(j)}x{letters(i)}" if i in begin[:10] else f"c{letters(i)}" for i in range(40)] for j in range(4)]
    rows = [(j, " ".join(["one", "two", "three", *t])) for j, t in enumerate(targets)]
    for j, t in enumerate(targets):
        for run in range(5):
            for k in range(4):
                own = [f"d{letters(j)}r{letters(run)}k{letters(k)}x{letters(i)}" for i in range(40)]
                own[begin[run] : begin[run + 1]] = t[begin[run] : begin[run + 1]]
                rows.append((len(rows), " ".join(["one", "two", "three", *own])))
    got = {r["doc_id"]: r["n_dropped"] for r in lines.drop_recurring(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {d for d, n in got.items() if n} == {1, 2, 3} and len(got) == 84


def test_line_dedup_edges(spark, odd):
    got = lines.drop_recurring(odd, least_docs=2).collect()
    assert len(got) == odd.count() and {"score", "n_words", "n_lines", "n_dropped"} <= set(got[0].asDict())
    by = collections.Counter((r["doc_id"], r["text"]) for r in got)
    assert by[(6, "The same. text, twice")] == 1 and by[(7, "")] == 1 and by[(3, "\n\n")] == 2
    assert lines.drop_recurring(odd.limit(0)).count() == 0


# -- winnowing --------------------------------------------------------------------------------------------


def test_winnowing_selects_rightmost_minima():
    rng = random.Random(1)
    for _ in range(150):
        text = "".join(rng.choice("ab") for _ in range(rng.randint(1, 120)))
        k, w = min(rng.randint(1, 20), len(text)), rng.randint(1, 20)
        codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
        h = [int(winnow.rolling_hashes(codes[i : i + k], k)[0]) for i in range(len(text) - k + 1)]
        want = {max(j for j in range(i, min(i + w, len(h))) if h[j] == min(h[i : i + w])) for i in range(max(1, len(h) - w + 1))}
        got = winnow.rolling_hashes(codes, k)
        assert h == got.tolist() and winnow.keep_minima(got, w).tolist() == sorted(want)
        prints = winnow.fingerprint(text, k, w)
        assert winnow.positions(prints).tolist() == sorted(want)


def test_winnowing_guarantee():
    rng = random.Random(2)
    shared = "".join(rng.choice("abcdefgh ") for _ in range(winnow.GRAM + winnow.WINDOW - 1))
    for _ in range(20):
        a, b = ("".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 300))) for _ in "ab")
        pa, pb = winnow.fingerprint(a + shared + b), winnow.fingerprint(b + shared + a)
        assert np.intersect1d(pa & winnow._LOW, pb & winnow._LOW).size


def test_edited_texts(docs):
    got = {r["doc_id"]: r for r in winnow.compare_with_edits(docs).collect()}
    rows = sorted(texts(docs), reverse=True)
    for i, (doc, text) in enumerate(rows):
        nxt = rows[(i + 1) % len(rows)][1]
        edit = text[: len(text) - len(text) // 3] + nxt[: len(text) // 3]
        g = got[doc]
        assert (g["n_chars"], g["edited_sha256"]) == (len(text), hashlib.sha256(edit.encode()).hexdigest())
        assert g["fingerprint"] == winnow.as_string(winnow.fingerprint(text)) and g["edited_fingerprint"] == winnow.as_string(winnow.fingerprint(edit))
        assert g["near_next"] == winnow.likeness(winnow.fingerprint(text), winnow.fingerprint(nxt))
    long = [g for g in got.values() if g["n_chars"] > 300]
    assert min(g["near_edited"] for g in long) > 0.1


def test_winnowing_edges(odd):
    got = winnow.compare_with_edits(odd).collect()
    assert len(got) == odd.count() and winnow.compare_with_edits(odd.limit(0)).count() == 0
    assert {r["fingerprint"] for r in got if r["doc_id"] in (4, 5)} == {winnow.as_string(winnow.fingerprint("a"))}
    one = winnow.compare_with_edits(odd.where("doc_id = 8")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0


# -- decontamination --------------------------------------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text, pattern):
    return re.findall(pattern, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_contamination(rows, items):
    windows = collections.defaultdict(set)
    for item, text in items:
        w = plain_words(text, WORD)
        for i in range(max(1, len(w) - 9)) if w else ():
            windows[tuple(w[i : i + 10])].add("" if item is None else str(item))
    out = {}
    for doc, text in rows:
        w, hit, found = plain_words(text, WORD), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if own := windows.get(tuple(w[i : i + n])):
                    found |= own
                    hit |= set(range(i, i + n))
        out[doc, text] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


@pytest.mark.parametrize("blocks", [1, 3])
def test_contamination_equals_brute_force(spark, docs, odd, blocks, monkeypatch):
    items = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text")
    items = items.unionByName(spark.createDataFrame([(900, "same text twice"), (900, None), (None, "x, y"), (901, "")], "item_id long, text string"))
    both = docs.select("doc_id", "text").unionByName(odd.where("doc_id is not null").selectExpr("doc_id + 10000 AS doc_id", "text"))
    if blocks > 1:
        total = items.agg(F.sum(F.octet_length("text"))).first()[0]
        search = decontaminate.search
        monkeypatch.setattr(decontaminate, "search", lambda i, q, w, r: search(i, q, w, r, block_bytes=total // (blocks - 1)))
    got = decontaminate.contamination(both, items).collect()
    want = brute_contamination(texts(both), [(r["item_id"], r["text"]) for r in items.collect()])
    assert collections.Counter((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in got) == collections.Counter(
        (doc, *want[doc, text]) for doc, text in texts(both)
    )
    assert any(r["contaminated"] for r in got)


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "one x two y three"), (2, "one " + "x " * 30 + "two three"), (3, "three two one")], "doc_id long, text string")
    items = spark.createDataFrame([("q", "one two three")], "item_id string, text string")
    got = {r["doc_id"]: (r["n_hit"], r["n_near"]) for r in decontaminate.contamination(docs, items, reach=5).collect()}
    assert got == {1: (0, 1), 2: (0, 0), 3: (0, 1)}
    assert decontaminate.contamination(docs, items.limit(0)).where("contaminated").count() == 0


# -- personal data ----------------------------------------------------------------------------------------

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, body):
    d = re.sub("[^0-9]", "", body)
    if kind == "ip":
        return all(int(x) <= 255 for x in body.split("."))
    if kind == "card":
        total = sum((2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) if i % 2 else int(c) for i, c in enumerate(reversed(d)))
        return 14 <= len(d) <= 19 and total % 10 == 0
    return 10 <= len(d) <= 15 if kind == "phone" else True


def test_base_spans_equal_the_patterns(spark, docs, odd):
    more = [
        "a@b.c_d@e.f x@y..z q@w.e.", "1.2.3.4.5.6.7.8 999.1.2.3.4 001.0255.3.4 1.2.3", "4041894974608795 4041-8949-7460-8795 4041  8949 4041 8949 7460 8795 12",
        "+1 (269) 555-3296 +49 30 1234567 +1+2 12345678901 +12-", "ünï a.b+c%d@x-y.co.uk, é@b.c", "\x01\x02 1\x012 a\x03b@c.d", "a." * 3000 + "@b.c",
        "\U0001f600 12.34.56.78 \U0001f600 x@y.z", "a-.b@c-.-d.e 1-2-3.4.5.6 1.2-3.4", "+1.2.3.4.5.6.7.8.9.0.1 --5@6.7",
    ]
    extra = spark.createDataFrame([(20000 + i, t) for i, t in enumerate(more)], "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text")).unionByName(extra)
    got = collections.Counter((r["doc_id"], r["base_sha256"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) for r in pii.report(both).collect())
    want = collections.Counter()
    for doc, text in texts(both):
        own = sorted((m.start(), i, m.end()) for i, k in enumerate(BASE) for m in re.finditer(BASE[k], text) if valid(k, m.group()))
        said = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in own)
        n = collections.Counter(k for _, k, _ in own)
        want[(doc, hashlib.sha256(said.encode()).hexdigest(), n[0], n[1], n[2], n[3])] += 1
    assert got == want
    assert pii.report(both.limit(0)).count() == 0


def test_emails_with_hyphens_between_digits(spark):
    more = ["john.2024-05@ex.org", "x@mail1-2.com", "x@ec2-10-0-0-1.aws.com", "x@ex.a1-2b", "1-2@3-4.5-6 1-2-@-3-4.-5", "a1-2.b@c 1-2@3.4-5@6-7.8"]
    got = {r["doc_id"]: r for r in pii.report(spark.createDataFrame(list(enumerate(more)), "doc_id long, text string")).collect()}
    for i, text in enumerate(more):
        own = sorted((m.start(), k, m.end()) for k, kind in enumerate(BASE) for m in re.finditer(BASE[kind], text) if valid(kind, m.group()))
        said = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in own)
        assert got[i]["n_email"] == sum(k == 0 for _, k, _ in own) > 0 and got[i]["base_sha256"] == hashlib.sha256(said.encode()).hexdigest(), text
    wide = spark.createDataFrame([(0, "x1-2 (at) ec2-10-0.aws1-2.com")], "doc_id long, text string").select(pii.candidates(pii.prepared(F.col("text"))).alias("c"))
    assert (0, 0, 29) in {(c["kind"], c["start"], c["end"]) for c in wide.first()["c"]}


def test_boosted_candidates_add_like_spans(spark):
    rows = [(i, f"call +1 ({200 + i}) 555-{1000 + i} now, or order {1000 + i} of 2024") for i in range(60)] + [(99, "call (269) 555-3296 now, 999.1.2.3")]
    got = {r["doc_id"]: r for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[99]["spans"] == "phone:5:19" and got[99]["n_phone"] == 0 and all(got[i]["n_phone"] == 1 for i in range(60))


# -- pages ------------------------------------------------------------------------------------------------


def test_pages_give_their_articles(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").withColumn("text", F.lit("clash"))
    more = spark.createDataFrame([(9001, "u", None), (9002, None, ""), (9003, "u", "<p>a&nbsp;&lt;b"), (9003, "u", "<p>a&nbsp;&lt;b")], "page_id long, url string, html string")
    both = pages.select("page_id", "url", "html").unionByName(more)
    got = html.extract(both, html.fit(pages)).collect()
    assert len(got) == both.count()
    text = {r["page_id"]: r["text"] for r in got}
    assert text[9001] == "" and text[9002] == ""
    for r in pages.collect():
        body = re.search(r"<article>(.*)</article>", r["html"], re.S).group(1)
        want = " ".join(" ".join(entities.unescape(re.sub(r"</?b>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)>", body))
        assert text[r["page_id"]] == " ".join(want.split())


def test_labeller_gradient():
    rng = np.random.default_rng(0)
    model = html.Labeller()
    data = [((rng.random((n, html.BUCKETS + 3)) < 0.02).astype(float), None) for n in (3, 6, 5, 9) * 8]
    data = [(x, (np.cumsum(x[:, 0]) % 2)) for x, _ in data]
    for x, y in data:
        x[:, 1] = y
    model.fit(data, epochs=60)
    x, mask = html.padded([d[0] for d in data])
    p = model.chances(x, mask)
    assert all(((p[i, : len(y)] > 0.5) == (y > 0.5)).all() for i, (_, y) in enumerate(data))


# -- near duplicates --------------------------------------------------------------------------------------


def brute_classes(rows):
    sets, same = {}, collections.defaultdict(list)
    for doc, text in rows:
        w = tuple(plain_words(text, r"[^\x20\x09-\x0D]+"))
        sets[doc] = {w[i : i + 5] for i in range(len(w) - 4)} if len(w) >= 5 else {w} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


def planted(n_groups=12, seed=3):
    """Groups of copies with edits around the threshold, whose first member is not the least edited."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6)))
    rows = []
    for _ in range(n_groups):
        base = [word() for _ in range(rng.choice([4, 20, 60, 150]))]
        for _ in range(rng.randint(2, 25)):
            own = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 5, 8])):
                own[rng.randrange(len(own))] = word()
            rows.append(" ".join(own))
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_near_duplicates_equal_brute_force(spark, docs):
    rows = texts(docs) + [(10000 + i, t) for i, t in planted()] + [(20000, ""), (20001, ""), (20002, "One two"), (20003, "one TWO"), (20004, "\t \n")]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, component_id long")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(df).collect()}
    assert got == brute_classes(rows)


def test_near_duplicates_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert neardup.near_duplicates(empty).count() == 0
    got = neardup.near_duplicates(spark.createDataFrame([(1, None), (2, None)], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in got) == [(1, 1, True), (2, 2, True)]


def test_near_duplicates_with_repeated_and_missing_ids(spark):
    rows = planted(8, seed=5)
    own = brute_classes(rows)
    # every third row has no id, others share one of seven: the class of a row is that of its own text
    ids = [None if i % 3 == 0 else i % 7 for i, _ in rows]
    rows2 = [(d, t) for d, (_, t) in zip(ids, rows)] + [(ids[5], rows[5][1]), (ids[5], rows[5][1]), (None, None), (3, ""), (None, rows[0][1])]
    owner = [own[i][1] for i, _ in rows] + [own[5][1]] * 2 + [None, None, own[0][1]]
    least = {}
    for root, (d, _) in zip(owner, rows2):
        if root is not None and d is not None:
            least[root] = min(d, least.get(root, d))
    want = []
    for root, (d, t) in zip(owner, rows2):
        name = d if root is None else least.get(root)
        want.append((d, brute_classes([(0, t or "")])[0][0], name, name == d))
    df = spark.createDataFrame(rows2, "doc_id long, text string")
    got = [tuple(r) for r in neardup.near_duplicates(df).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_near_duplicates_of_long_texts(spark):
    words = [f"w{i * 7919 % 50021}" for i in range(60_000)]
    near = words[:50] + ["x"] * 20 + words[70:]
    far = words[:20_000] + [f"v{i}" for i in range(40_000)]
    df = spark.createDataFrame([(i, " ".join(w), 0) for i, w in enumerate([words, near, far])], "doc_id int, text string, node int")
    assert sorted((r["doc_id"], r["component_id"]) for r in neardup.near_duplicates(df).collect()) == [(0, 0), (1, 0), (2, 2)]


def test_pigeonhole_guarantee():
    rng = np.random.default_rng(5)
    for errors in (0, 12, 2 * neardup.CHUNKS - 1):
        for _ in range(50):
            a = rng.integers(0, 1 << 16, neardup.VALUES).astype(np.uint16)
            b = a.copy()
            at = rng.choice(neardup.VALUES, errors, replace=False)
            b[at] = b[at] ^ np.uint16(1)
            keys = neardup.keys_of(np.stack([a, b]))
            assert (keys[0] == keys[1]).any()


# -- encoding ---------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_bpe_equals_the_library(docs, odd, library):
    both = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    want = collections.Counter()
    for doc, text in texts(both):
        ids = library.encode(text, add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want[(doc, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())] += 1
    assert collections.Counter(tuple(r) for r in bpe.digests(both, PATH).collect()) == want
    rows = bpe.decode(bpe.encode(odd, PATH), PATH).collect()
    assert len(rows) == odd.count() and bpe.digests(odd.limit(0), PATH).count() == 0


def test_forced_cuts_keep_tokens_whole():
    enc = bpe.ForcedBoundaryEncoder(PATH)
    for token in itertools.islice(enc.vocab, 0, None, 97):
        body = token.removesuffix(enc.end)
        assert enc.fragments_of(body) == [body + enc.end]
    assert enc.merge_long("qxzj" * 60 + enc.end) == enc.merge("qxzj" * 60 + enc.end)


def test_token_shards_round_trip(spark, docs, odd, library):
    both = docs.select("doc_id", "text").unionByName(odd.where("doc_id is not null").selectExpr("doc_id + 10000 AS doc_id", "text").distinct())
    path = scratch_path(spark, "shards")
    repair.write(both, PATH, path, shard_ids=5000)
    got = {r["doc_id"]: r for r in repair.digests(spark, path).collect()}
    start = 0
    for doc, text in sorted(texts(both)):
        ids = [*library.encode(text, add_special_tokens=False).ids, 2]
        g = got[doc]
        assert (g["start"], g["n_tokens"], g["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    shard = max((r.asDict() for r in spark.read.parquet(path).collect()), key=lambda r: len(r["rules"]))
    assert len(shard["rules"])
    whole = {r["doc_id"]: r["ids"] for r in repair.read(spark, path).collect()}
    for place, doc in enumerate(shard["doc_ids"]):
        assert repair.document_ids(shard, place).astype("<u4").tobytes() == bytes(whole[doc])


def test_repair_goes_on_until_no_pair_is_frequent():
    # one sequence of 200 ids again and again takes eight rounds of halving
    rng = np.random.default_rng(3)
    ids = np.concatenate([np.r_[np.tile(np.arange(10, 210), 40), rng.integers(1000, 60000, 50), 2] for _ in range(30)]).astype(np.uint32)
    last = ids == 2
    s, ends, rules, rounds = repair.compress(ids, last.copy())
    assert (repair.expand(s.copy(), rules, rounds) == ids).all() and len(rounds) > 3
    inner = ~ends[:-1]
    pairs = np.column_stack([s[:-1], s[1:]])[inner]
    assert np.unique(pairs, axis=0, return_counts=True)[1].max() < repair.LEAST


def test_repair_on_runs():
    rng = np.random.default_rng(1)
    for ids in (np.zeros(500), rng.integers(0, 3, 4000), np.tile([1, 2, 3, 4], 600), np.arange(3), np.zeros(0)):
        last = np.zeros(len(ids), bool)
        last[99::100] = True
        last[-1:] = True
        s, ends, rules, rounds = repair.compress(ids, last.copy())
        assert (repair.expand(s.copy(), rules, rounds) == ids).all()
        spans = np.array([repair.spans_of(rules)[x - repair.FIRST] if x >= repair.FIRST else 1 for x in s.tolist()])
        assert spans.sum() == len(ids) and ends.sum() == last.sum()


def test_shards_of_nothing(spark, odd):
    path = scratch_path(spark, "shards")
    repair.write(odd.limit(0), PATH, path)
    assert repair.digests(spark, path).count() == 0


# -- conversations ----------------------------------------------------------------------------------------


def test_chat_equals_its_sql(spark, duck):
    ok, note = compare(spark, duck, queries.QUERIES["op8_chat"], queries.ORACLES["op8_chat"])
    assert ok, note


def test_snapshots_collapse(spark):
    rows = [(1, 0, "user", "hi"), (2, 0, "user", "hi"), (2, 1, "assistant", "yo"), (3, 0, "user", "hi"), (3, 1, "assistant", "yo"), (4, 0, "user", "ho")]
    rows += [(2, 1, "assistant", "yo"), (5, 0, None, "ho"), (6, None, "user", None), (None, 0, "user", "hi")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, n_turns string")
    got = {r["conv_id"]: (r["n_turns"], r["copies"]) for r in chat.format_chats(df).collect()}
    assert got == {2: (2, 2), 4: (1, 2), 6: (1, 1)}
    assert chat.format_chats(df.limit(0)).count() == 0


# -- toxicity ---------------------------------------------------------------------------------------------


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    for n in (1, 2, 5):
        x, move = rng.normal(size=n) * 2, rng.normal(size=(2, 2))
        p, z = np.zeros(n), 0.0
        for s in itertools.product((0, 1), repeat=n):
            w = np.exp(sum(x[i] for i in range(n) if s[i]) + sum(move[s[i], s[i + 1]] for i in range(n - 1)))
            p, z = p + w * np.array(s), z + w
        assert np.allclose(toxicity.marginals([x, x[:0], x[:1]], move)[0], p / z)
        f, b = toxicity.chain(x[None], move)
        assert np.allclose(1 / (1 + np.exp(-(f + b)))[0], p / z)


def test_held_out_toxicity(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.scores(docs, labels).join(labels, "doc_id").where("held_out").select("predicted", "toxic", "doc_id").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in got)
    hit = sum(r["predicted"] and r["toxic"] for r in got)
    assert hit >= 0.8 * sum(r["toxic"] for r in got) and hit >= 0.95 * sum(r["predicted"] for r in got)


def test_toxicity_edges(spark, odd):
    labels = spark.createDataFrame([(i, 0) for i in range(10)] + [(11, None)], "doc_id long, toxic int")
    got = toxicity.scores(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] < 0.7 and r["predicted"] == 0 for r in got)
    assert toxicity.scores(odd.limit(0), labels).count() == 0
