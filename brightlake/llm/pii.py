"""Personal data by boosted candidates (DataFrame and SQL functions only).

Base spans of four kinds come from fixed patterns and checks. High-recall generators propose further,
overlapping spans of the same kinds (numbers without a country code, bracketed addresses, quads and
card numbers with other separators). Candidates are described by a few discrete format and context
features; boosted trees of depth two learn from all candidates of the table which look like base
spans (a candidate inside a base span of its kind is a positive one). As features are discrete, their
distinct combinations, whose number is bounded by the product of the levels, are counted on Spark and
the trees grow from the counts. A threshold per kind, the lowest with a precision of ``PRECISION``
among the candidates with at least that score, selects what is added; base spans always stay.

Offsets are code points, ends exclusive. Null and empty texts have no spans. Repeated rows give repeated
results. Without any candidate nothing is added.

Patterns are written without repeated groups and with possessive runs, so that long texts neither
exhaust the stack nor take quadratic time: single separators inside digit runs and points inside names
are first replaced by control characters of the same length.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

KINDS = ("email", "ip", "card", "phone")
PRECISION = 0.9
ROUNDS = 12
RATE = 0.5
LEAST_WEIGHT = 2.0
#: Stand-ins: blank and hyphen between two digits, point between two name characters.
_BLANK, _HYPHEN, _POINT, _OTHER = "\x01", "\x02", "\x03", "\x04"
_NAME = r"A-Za-z0-9._%+\x02\x03-"
_DOMAIN = r"A-Za-z0-9\x02-"
BASE = {
    "email": rf"(?:(?<![{_NAME}])|\G)[{_NAME}]++@[{_DOMAIN}]++\x03[\x03{_DOMAIN}]*",
    "ip": r"(?<![0-9])[0-9]++\x03[0-9]++\x03[0-9]++\x03[0-9]+",
    "card": r"[0-9][0-9\x01\x02]+",
    "phone": r"\+[0-9][\x20().0-9\x01\x02\x03-]+[0-9]",
}
#: Candidate generators: kind and pattern on the prepared text.
WIDE = {
    "email": rf"(?:(?<![{_NAME}])|\G)[{_NAME}]++ ?[(\[](?:at|AT)[)\]] ?[\x03{_DOMAIN}]+",
    "ip": r"(?<![0-9])[0-9]{1,3}[\x02\x01][0-9]{1,3}[\x02\x01][0-9]{1,3}[\x02\x01][0-9]{1,3}(?![0-9])",
    "card": r"(?<![0-9])[0-9]{4}[ \x01\x02\x03/][0-9]{4}[ \x01\x02\x03/][0-9]{4}[ \x01\x02\x03/][0-9]{2,7}(?![0-9])",
    "phone": r"(?<![0-9])\(?[0-9]{3}\)?[ \x01\x02\x03][0-9]{3}[ \x01\x02\x03-][0-9]{4}(?![0-9])",
}
LEVELS = ("kind", "digits", "parts", "left", "right", "check", "mark")


def prepared(text: Column) -> Column:
    """The text with stand-ins; every character keeps its place."""
    t = F.translate(text, "\x01\x02\x03", _OTHER * 3)
    t = F.regexp_replace(t, r"(?<=[0-9]) (?=[0-9])", _BLANK)
    t = F.regexp_replace(t, r"(?<=[0-9])-(?=[0-9])", _HYPHEN)
    return F.regexp_replace(t, r"(?<=[A-Za-z0-9\x02-])\.(?=[A-Za-z0-9\x02-])", _POINT)


def _found(prep: Column, pattern: str, kind: str) -> Column:
    """Array of (start, end, body) of all matches, from the lengths of matches and of the gaps."""
    bodies = F.regexp_extract_all(prep, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(prep, pattern, -1), lambda g: F.length(g))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,body:string>>").alias("all"))
    pairs = F.zip_with(bodies, F.slice(gaps, 1, F.greatest(F.size(bodies), F.lit(1))), lambda b, g: F.struct(b.alias("b"), g.alias("g")))
    step = lambda s, x: F.struct(
        (s["at"] + x["g"] + F.length(x["b"])).alias("at"),
        F.array_append(s["all"], F.struct((s["at"] + x["g"]).alias("start"), (s["at"] + x["g"] + F.length(x["b"])).alias("end"), x["b"].alias("body"))).alias("all"),
    )
    found = F.aggregate(F.filter(pairs, lambda x: x["b"].isNotNull()), start, step, lambda s: s["all"])
    found = F.transform(found, lambda x: F.struct(F.lit(KINDS.index(kind)).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["body"].alias("body")))
    return F.when(F.size(bodies) > 0, found).otherwise(F.array().cast("array<struct<kind:int,start:int,end:int,body:string>>"))


def digits_of(body: Column) -> Column:
    return F.regexp_replace(body, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the digits pass the card checksum."""
    total = F.aggregate(
        F.transform(
            F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""),
            lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)),
        ),
        F.lit(0),
        lambda s, x: s + x,
    )
    return total % 10 == 0


def _octets(body: Column) -> Column:
    """Whether all parts are at most 255; leading zeros of any number are allowed."""
    parts = F.split(F.regexp_replace(body, r"[\x01\x02.]", _POINT), _POINT)
    return F.forall(parts, lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 2) | F.forall(
        F.transform(parts, lambda p: F.regexp_replace(p, "^0+", "")), lambda p: (F.length(p) <= 2) | ((F.length(p) == 3) & (p <= "255"))
    )


def _valid(kind: str, body: Column) -> Column:
    n = F.length(digits_of(body))
    if kind == "ip":
        return _octets(body)
    if kind == "card":
        return F.when(n.between(14, 19), luhn(digits_of(body))).otherwise(F.lit(False))
    return n.between(10, 15) if kind == "phone" else F.lit(True)


def base_spans(prep: Column) -> Column:
    """Valid base spans of all kinds, sorted by start, then kind."""

    def valid(kind: str) -> Column:
        return F.filter(_found(prep, BASE[kind], kind), lambda x: _valid(kind, x["body"]))

    found = F.concat(*map(valid, KINDS))
    return F.array_sort(F.transform(found, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))))


def candidates(prep: Column) -> Column:
    """All matches of the generators and of the base patterns, valid or not."""
    return F.concat(*[_found(prep, p[k], k) for p in (BASE, WIDE) for k in KINDS])


def featured(rows: DataFrame) -> DataFrame:
    """One row per candidate of rows with (row, prep, base): its levels and whether a base span holds it."""
    c = rows.select("row", "prep", "base", F.explode(candidates(F.col("prep"))).alias("c"))
    kind, start, end, body = (F.col(f"c.{n}") for n in ("kind", "start", "end", "body"))
    n = F.length(digits_of(body))
    before, after = F.substring("prep", start, F.lit(1)), F.expr("substring(prep, c.end + 1, 1)")
    before = F.when(start == 0, F.lit("")).otherwise(before)

    def char(x: Column) -> Column:
        return F.when(x == "", 0).when(x.rlike(r"^[\s]$"), 1).when(x.rlike(r"^[0-9A-Za-z\x01-\x03]$"), 2).when(x.rlike(r"^[+=:/@#-]$"), 3).otherwise(4)

    check = F.lit(0)
    for i, k in enumerate(KINDS):
        check = F.when(kind == i, _valid(k, body).cast("int")).otherwise(check)
    inside = F.exists("base", lambda b: (b["kind"] == kind) & (b["start"] <= start) & (b["end"] >= end))
    return c.select(
        "row",
        kind.alias("kind"),
        start.alias("start"),
        end.alias("end"),
        F.least(n, F.lit(20)).alias("digits"),
        F.least(F.length(F.regexp_replace(body, r"[A-Za-z0-9]", "")), F.lit(7)).alias("parts"),
        # a country code before a number is what the wide generator leaves out: not told apart from white space
        F.when((kind == 3) & (char(before) == 2), 1).otherwise(char(before)).alias("left"),
        char(after).alias("right"),
        check.alias("check"),
        F.when(body.contains("("), 1).when(body.contains(_HYPHEN) | body.contains("-"), 2).when(body.contains(_BLANK) | body.contains(" "), 3).otherwise(0).alias("mark"),
        inside.alias("inside"),
    )


def boost(cells: list[tuple[tuple[int, ...], float, float]], rounds: int = ROUNDS) -> tuple[float, list[dict]]:
    """Depth-two trees on cells (levels, positive weight, negative weight): start and trees.

    A tree is {"f", "at", "low", "high"}: ``level f <= at`` goes low; leaves are numbers.
    """
    pos, neg = sum(c[1] for c in cells), sum(c[2] for c in cells)
    start = math.log((pos + 1) / (neg + 1))
    score = [start] * len(cells)
    trees = []

    def leaf(own, grads):
        return RATE * sum(grads[i][0] for i in own) / (sum(grads[i][1] for i in own) + 1.0)

    def split(own, grads):
        total = sum(grads[i][0] for i in own), sum(grads[i][1] for i in own)
        best = (1e-6, None, None)
        for f in range(len(LEVELS)):
            by: dict[int, list[float]] = {}
            for i in own:
                b = by.setdefault(cells[i][0][f], [0.0, 0.0, 0.0])
                b[0] += grads[i][0]
                b[1] += grads[i][1]
                b[2] += cells[i][1] + cells[i][2]
            weight = sum(b[2] for b in by.values())
            g = h = w = 0.0
            for level in sorted(by)[:-1]:
                g, h, w = g + by[level][0], h + by[level][1], w + by[level][2]
                if min(w, weight - w) < LEAST_WEIGHT:
                    continue
                gain = g * g / (h + 1) + (total[0] - g) ** 2 / (total[1] - h + 1) - total[0] ** 2 / (total[1] + 1)
                if gain > best[0]:
                    best = (gain, f, level)
        return best[1:]

    def grow(own, grads, depth):
        f, at = split(own, grads) if depth else (None, None)
        if f is None:
            value = leaf(own, grads)
            for i in own:
                score[i] += value
            return value
        low, high = [i for i in own if cells[i][0][f] <= at], [i for i in own if cells[i][0][f] > at]
        return {"f": f, "at": at, "low": grow(low, grads, depth - 1), "high": grow(high, grads, depth - 1)}

    for _ in range(rounds):
        grads = []
        for (_, p, n), s in zip(cells, score):
            q = 1 / (1 + math.exp(-s))
            grads.append((p - q * (p + n), q * (1 - q) * (p + n)))
        trees.append(grow(list(range(len(cells))), grads, 2))
    return start, trees


def predict(levels: tuple[int, ...], start: float, trees: list) -> float:
    s = start
    for t in trees:
        while isinstance(t, dict):
            t = t["low"] if levels[t["f"]] <= t["at"] else t["high"]
        s += t
    return s


def as_column(start: float, trees: list) -> Column:
    """The trees as nested CASE expressions."""

    def one(t):
        return F.when(F.col(LEVELS[t["f"]]) <= t["at"], one(t["low"])).otherwise(one(t["high"])) if isinstance(t, dict) else F.lit(float(t))

    total = F.lit(start)
    for t in trees:
        total = total + one(t)
    return total


def thresholds(cells, start, trees, precision: float = PRECISION) -> dict[int, float]:
    """Per kind the lowest score above which the share of positives is at least ``precision``."""
    out = {}
    for kind in range(len(KINDS)):
        own = sorted(((predict(lv, start, trees), p, n) for lv, p, n in cells if lv[0] == kind), reverse=True)
        out[kind], good, all_ = math.inf, 0.0, 0.0
        for i, (s, p, n) in enumerate(own):
            good, all_ = good + p, all_ + p + n
            if (i + 1 == len(own) or own[i + 1][0] < s) and good >= precision * all_:
                out[kind] = s
    return out


def find(docs: DataFrame, precision: float = PRECISION) -> DataFrame:
    """(doc_id, base, added): arrays of (start, kind, end), kinds numbered as in ``KINDS``."""
    from brightlake.session import stored

    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.when(text.rlike("[0-9@(\\[]"), prepared(text)).otherwise(F.lit("")).alias("prep"))
    rows = rows.withColumn("base", base_spans(F.col("prep"))).withColumn("row", F.xxhash64("doc_id", "prep"))
    found = stored(featured(rows), "candidates")
    counts = found.groupBy(*LEVELS).agg(F.count_if("inside").alias("yes"), F.count_if(~F.col("inside")).alias("no")).collect()  # bounded by the levels
    cells = sorted((tuple(r[c] for c in LEVELS), float(r["yes"]), float(r["no"])) for r in counts)
    start, trees = boost(cells) if cells else (0.0, [])
    limits = thresholds(cells, start, trees, precision)
    scored = found.where("not inside and check = 1")  # a failed check of the kind is final
    scored = scored.withColumn("score", as_column(start, trees))
    chosen = F.lit(False)
    for kind, limit in limits.items():
        if limit < math.inf:
            chosen = chosen | ((F.col("kind") == kind) & (F.col("score") >= F.lit(limit)))
    added = scored.where(chosen).groupBy("row").agg(F.array_sort(F.collect_set(F.struct("start", "kind", "end"))).alias("added"))  # within one text
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return rows.select("doc_id", "base", "row").join(added, "row", "left").select("doc_id", "base", F.coalesce("added", none).alias("added"))


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) of every row."""
    found = find(docs)

    def count(i: int) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == i)).cast("long").alias(f"n_{KINDS[i]}")

    counts = map(count, range(len(KINDS)))
    every = F.array_sort(F.array_union("base", "added"))
    return found.select(
        "doc_id", *counts, F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(every).alias("spans"), F.size("added").cast("long").alias("n_added")
    )
