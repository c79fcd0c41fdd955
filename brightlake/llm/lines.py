"""Line dedup with a fixed-depth tree of log templates.

Lines are cut at line feeds. Runs of digits become ``<*>``. A line's leaf in the tree is its number of
words (blanks of the trimmed line plus one) and its ``DEPTH`` leading words. Within a leaf like lines are grouped by runs of their
further words: a line with at most v variable words has v + 1 runs, so one run at least holds none, and all lines of the
template share it. Within a group every word of a line has a number of lines with that word there; the words at least as
frequent as the least of the most frequent ``ALIKE`` (rounded up, in ``least_docs`` lines or more) are constant, the others
become ``<*>``. How many other lines the leaf holds does not matter. A line takes the template of the most lines among those of
its groups, if another line has it too; any other line is its own template. A line looks into all its groups; groups
of the same lines are one. Templates found in at least ``least_docs`` documents recur: their first line
(by doc_id, then text, then line number) stays, all others are dropped.

A document is a row's (doc_id, text): rows equal in both count as one and are treated alike. Blank
lines are never dropped. Null texts stay null with 0 lines, an empty text is one blank line. Null
doc_ids come first. Other columns pass through; ``n_lines`` and ``n_dropped`` replace any of that name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from brightlake.llm.common import key128
from brightlake.session import materialize, small_side, stored

LEAST_DOCS = 3
DEPTH = 3
ALIKE = 0.75
LEAST_CONSTANT = 3
_VARIABLE = "<*>"


def parsed(docs: DataFrame) -> DataFrame:
    """A row per line that is not blank: document, line number, generalised line, its hash and leaf."""
    hashed = docs.select("doc_id", F.xxhash64("text").alias("tie"), F.split("text", "\n").alias("lines"))
    lines = hashed.select("doc_id", "tie", F.posexplode("lines").alias("line", "body"))
    lines = lines.withColumn("body", F.trim("body")).where("body <> ''")
    # filters move below what makes their columns: they are on the body, so that no line is generalised for a filter
    size = F.octet_length("body") - F.octet_length(F.replace("body", F.lit(" "))) + 1  # bytes: characters would have to be counted
    masked = F.when(F.col("body").rlike("[0-9]"), F.regexp_replace("body", "[0-9]+", _VARIABLE)).otherwise(F.col("body"))
    lines = lines.select("doc_id", "tie", "line", size.alias("n_words"), masked.alias("masked"))
    one, two = key128(F.col("masked"))
    lines = lines.select("doc_id", "tie", "line", "masked", one.alias("h1"), two.alias("h2"), "n_words")
    return lines.withColumn("leaf", F.xxhash64("n_words", F.substring_index("masked", " ", DEPTH)))


def distinct_lines(lines: DataFrame) -> DataFrame:
    """(leaf, h1, h2, masked, n): every distinct line and how often it comes. As a key, unlike as a value, the line leaves rows to be hashed, not sorted."""
    return lines.groupBy("leaf", "h1", "h2", "masked").agg(F.count(F.lit(1)).alias("n"))


def generalised(docs: DataFrame, lines: DataFrame, least_docs: int) -> DataFrame:
    """(h1, h2, t1, t2): lines that take a template with variable words, and its hash."""
    long_enough = F.col("n_words") >= DEPTH + LEAST_CONSTANT + 1
    # leaves with two distinct lines and enough in all; exact copies collapse before anything is sent
    leaves = lines.where(long_enough).groupBy("leaf", "h1").agg(F.count(F.lit(1)).alias("n")).groupBy("leaf").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("n"))
    leaves = small_side(leaves.where((F.col("kinds") > 1) & (F.col("n") >= least_docs)).select("leaf"))
    kinds = distinct_lines(parsed(docs).where(long_enough).join(leaves, "leaf"))
    kinds = materialize(kinds.withColumn("words", F.split("masked", " ")).drop("masked"))

    further = F.size("words") - DEPTH
    parts = F.floor(further * (1 - ALIKE)).cast("int") + 1
    begin = lambda i: F.floor(i * further / parts).cast("int")
    run = lambda i: F.xxhash64("leaf", i, F.slice("words", begin(i) + DEPTH + 1, begin(i + 1) - begin(i)))
    runs = kinds.select("h1", "h2", "n", F.explode(F.transform(F.sequence(F.lit(0), parts - 1), run)).alias("group"))
    members = F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("lines"), F.bit_xor("h1").alias("x1"), F.bit_xor("h2").alias("x2")
    sizes = runs.groupBy("group").agg(*members).where((F.col("kinds") > 1) & (F.col("lines") >= least_docs))
    # named by its lines, a group that several runs of a long line share is looked into once
    own = runs.join(small_side(sizes.select("group", F.xxhash64("kinds", "lines", "x1", "x2").alias("same"))), "group").groupBy("h1", "h2")
    own = own.agg(F.collect_set("same").alias("groups"))  # at most a line's runs
    # numbered: a word of a line in a group is sent with a row number and a place, not with three hashes
    rows = kinds.join(own, ["h1", "h2"]).select(F.monotonically_increasing_id().alias("row"), "h1", "h2", "n", "words", "groups")
    rows = materialize(rows)

    cells = rows.select("row", "n", "words", F.posexplode("groups").alias("place", "group"))
    cells = cells.select("row", "n", "place", "group", F.posexplode(F.slice("words", DEPTH + 1, further)).alias("at", "word"))
    cells = cells.select("row", "n", "place", "at", F.xxhash64("group", "at", "word").alias("cell"))
    often = small_side(cells.groupBy("cell").agg(F.sum("n").alias("often")).where(F.col("often") >= least_docs))
    found = cells.select("row", "place", "at", "cell").join(often, "cell", "left").groupBy("row", "place")
    found = found.agg(F.sort_array(F.collect_list(F.struct("at", F.coalesce("often", F.lit(0)).alias("often")))).alias("often"))  # a line's words
    found = found.withColumn("often", F.col("often.often")).join(rows.drop("groups"), "row")
    most = F.greatest(F.ceil(further * ALIKE).cast("int"), F.lit(LEAST_CONSTANT))
    found = found.withColumn("least", F.element_at(F.sort_array("often", False), most)).where(F.col("least") >= least_docs)
    rest = F.zip_with(F.slice("words", DEPTH + 1, further), "often", lambda w, x: F.when(x >= F.col("least"), w).otherwise(F.lit(_VARIABLE)))
    one, two = key128(F.concat(F.slice("words", 1, DEPTH), rest))
    found = materialize(found.select("h1", "h2", "n", one.alias("t1"), two.alias("t2")).distinct())
    shared = found.groupBy("t1", "t2").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("lines"))
    shared = small_side(shared.where((F.col("kinds") > 1) & (F.col("lines") >= least_docs)).select("t1", "t2", "lines"))
    best = found.join(shared, ["t1", "t2"]).groupBy("h1", "h2").agg(F.max(F.struct("lines", "t1", "t2")).alias("best"))
    return best.select("h1", "h2", "best.t1", "best.t2")


def recurring_lines(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(doc_id, tie, lines): numbers of the lines to drop in each document that has some."""
    lines = stored(parsed(docs).drop("masked"), "lines")  # hashes only: read again instead of parsed again
    templates = small_side(generalised(docs, lines, least_docs))
    keyed = lines.join(templates, ["h1", "h2"], "left").select(
        "doc_id", "tie", "line", F.coalesce("t1", "h1").alias("h1"), F.coalesce("t2", "h2").alias("h2")
    )
    # per document first: a template repeated within one counts once, and no key gathers its documents
    per_doc = keyed.groupBy("h1", "h2", "doc_id", "tie").agg(F.min("line").alias("line"))
    recurs = (
        per_doc.groupBy("h1", "h2")
        .agg(F.count(F.lit(1)).alias("docs"), F.min(F.struct("doc_id", "tie", "line")).alias("first"))
        .where(F.col("docs") >= least_docs)
        .select("h1", "h2", "first")
    )
    again = keyed.join(small_side(recurs), ["h1", "h2"]).where(~F.struct("doc_id", "tie", "line").eqNullSafe(F.col("first")))
    return again.groupBy("doc_id", "tie").agg(F.collect_set("line").alias("lines"))


def drop_recurring(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """All rows and columns, with the recurring lines taken out of ``text``; n_lines, n_dropped."""
    drops = recurring_lines(docs.select("doc_id", "text"), least_docs).select(
        F.col("doc_id").alias("__doc"), F.col("tie").alias("__tie"), F.col("lines").alias("__lines")
    )
    own = docs.drop("n_lines", "n_dropped")
    joined = own.join(drops, F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.xxhash64("text") == F.col("__tie")), "left")
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("__lines", i)), "\n")
    dropped = F.coalesce(F.size("__lines"), F.lit(0))
    return joined.select(
        *[F.when(dropped > 0, kept).otherwise(F.col("text")).alias("text") if c == "text" else F.col(c) for c in own.columns],
        F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long").alias("n_lines"),
        dropped.cast("long").alias("n_dropped"),
    )
