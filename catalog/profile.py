"""Queries of section E: profiles, scores, outliers, text."""

from brightlake.functions.fixed import ENGLISH_STOP_WORDS
from brightlake.operators import profile as op
from catalog.base import register, table
from catalog.frames import GAPS_SQL, gaps

NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def each(template, columns):
    return " UNION ALL ".join(template.format(c=c) for c in columns)


OVERVIEW = f"""SELECT count(*) AS row_count, CAST(5 AS BIGINT) AS column_count, count(*) * 5 AS total_cells,
  3 * count(*) - count(price) - count(priority) - count(visits) AS missing_cells,
  100.0 * (3 * count(*) - count(price) - count(priority) - count(visits)) / (5 * count(*)) AS missing_percentage,
  CAST(3 AS BIGINT) AS columns_with_missing, CAST(0 AS BIGINT) AS duplicate_rows, CAST(4 AS BIGINT) AS numeric_count,
  CAST(1 AS BIGINT) AS categorical_count, CAST(0 AS BIGINT) AS datetime_count FROM {GAPS_SQL}"""


@register("e1_table_overview", OVERVIEW, dec="missing_percentage")
def _(spark, sf):
    return op.table_overview(gaps(spark, sf))


PROFILE = """SELECT '{c}' AS "column", count(DISTINCT {c}) AS unique_count, 100.0 * count(DISTINCT {c}) / count(*) AS unique_percentage,
  count(*) - count({c}) AS missing_count, 100.0 * (count(*) - count({c})) / count(*) AS missing_percentage,
  CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, avg({c}) AS mean, median({c}) AS median, stddev_samp({c}) AS std,
  count(*) FILTER ({c} = 0) AS zeros_count, 100.0 * count(*) FILTER ({c} = 0) / count({c}) AS zeros_percentage,
  count(*) FILTER ({c} < 0) AS negative_count, skewness({c}) AS skewness, kurtosis({c}) AS kurtosis,
  count(*) FILTER ({c} IN (0, 1)) = count({c}) AS is_binary,
  CASE WHEN count(*) FILTER ({c} IN (0, 1)) < count({c}) THEN count(*) FILTER ({c} < lo OR {c} > hi) END AS outliers_count,
  CASE WHEN count(*) FILTER ({c} IN (0, 1)) < count({c}) THEN 100.0 * count(*) FILTER ({c} < lo OR {c} > hi) / count({c}) END AS outliers_percentage,
  CASE WHEN count(*) FILTER ({c} IN (0, 1)) < count({c}) THEN any_value(lo) END AS lower_bound,
  CASE WHEN count(*) FILTER ({c} IN (0, 1)) < count({c}) THEN any_value(hi) END AS upper_bound
  FROM src, (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM
   (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM src))"""
PROFILE_DEC = "unique_percentage missing_percentage min max mean:4 median std:4 zeros_percentage skewness:5 kurtosis:5 outliers_percentage lower_bound upper_bound"


@register(
    "e2_column_profile_numeric",
    "WITH src AS (SELECT o_totalprice AS a, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_custkey * o_custkey END AS b, o_orderkey % 2 AS c FROM orders) "
    + each(PROFILE, ["a", "b", "c"]),
    dec=PROFILE_DEC,
)
def _(spark, sf):
    df = table(spark, sf, "orders").selectExpr(
        "o_totalprice AS a", "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_custkey * o_custkey END AS b", "o_orderkey % 2 AS c"
    )
    return op.numeric_profile(df)


@register(
    "e3_column_profile_datetime",
    each(
        """SELECT '{c}' AS "column", count(*) - count({c}) AS missing_count, min({c}) AS min_date, max({c}) AS max_date,
    CAST(floor(epoch(max({c}) - min({c})) / 86400) AS BIGINT) AS range_days FROM events""",
        ["ts"],
    ),
)
def _(spark, sf):
    return op.datetime_profile(table(spark, sf, "events"))


CAT = """SELECT '{c}' AS "column", count(DISTINCT {c}) AS unique_count, count(*) - count({c}) AS missing_count,
  (SELECT {c} FROM src WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, {c} LIMIT 1) AS most_common_value,
  (SELECT count(*) AS n FROM src WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY n DESC LIMIT 1) AS most_common_count,
  100.0 * (SELECT count(*) AS n FROM src WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY n DESC LIMIT 1) / count({c}) AS most_common_percentage,
  count(*) FILTER ({c} = '') AS empty_strings, 100.0 * count(*) FILTER ({c} = '') / count({c}) AS empty_strings_percentage FROM src"""
CAT_SRC = """WITH src AS (SELECT CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END AS priority,
  CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderstatus END AS status FROM orders) """


def cat_frame(spark, sf):
    return table(spark, sf, "orders").selectExpr(
        "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END AS priority",
        "CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderstatus END AS status",
    )


@register("e4_column_profile_categorical", CAT_SRC + each(CAT, ["priority", "status"]), dec="most_common_percentage empty_strings_percentage")
def _(spark, sf):
    return op.categorical_profile(cat_frame(spark, sf))


GRADE = "CASE WHEN {s} >= 90 THEN 'A+' WHEN {s} >= 80 THEN 'A' WHEN {s} >= 70 THEN 'B+' WHEN {s} >= 60 THEN 'B' WHEN {s} >= 50 THEN 'C+' WHEN {s} >= 40 THEN 'C' ELSE 'D' END"
EVENTS_GAPS = """SELECT CASE WHEN event_id % 17 = 0 THEN NULL ELSE value END AS value, user_id % 20 AS u, event_type,
  CASE WHEN event_id % 2 = 0 THEN '2024-01-01' END AS note_date FROM events"""


def penalty_sql(limit):
    return f"""WITH src AS ({EVENTS_GAPS}), m AS (SELECT 100.0 * (2 * count(*) - count(value) - count(note_date)) / (4 * count(*)) AS miss FROM src),
      d AS (SELECT 100.0 * sum(n - 1) / sum(n) AS dup FROM (SELECT count(*) AS n FROM src GROUP BY value, u, event_type, note_date)),
      o AS ({each(PROFILE, ['value', 'u'])}),
      p AS (SELECT coalesce(sum(least(10, 0.5 * outliers_percentage)) FILTER (outliers_percentage > {limit}), 0) AS outp FROM o)
      SELECT least(30, miss * 3) AS mp, least(20, dup * 4) AS dp, least(30, outp) AS op FROM m, d, p"""


def score_frame(spark, sf):
    return table(spark, sf, "events").selectExpr(
        "CASE WHEN event_id % 17 = 0 THEN NULL ELSE value END AS value",
        "user_id % 20 AS u",
        "event_type",
        "CASE WHEN event_id % 2 = 0 THEN '2024-01-01' END AS note_date",
    )


@register(
    "e5_quality_score",
    f"""SELECT 100 - mp - dp - op AS score, {GRADE.format(s='(100 - mp - dp - op)')} AS grade, mp AS missing_penalty, dp AS duplicate_penalty,
    op AS outlier_penalty FROM ({penalty_sql(5)})""",
    dec="score:1 missing_penalty:1 duplicate_penalty:1 outlier_penalty:1",
)
def _(spark, sf):
    return op.quality_score(score_frame(spark, sf))


@register(
    "e6_home_quality_score",
    f"""SELECT greatest(0, least(100, 95 - mp - dp - op)) AS score, {GRADE.format(s='greatest(0, least(100, 95 - mp - dp - op))')} AS grade,
    CAST(5 AS DOUBLE) AS type_penalty FROM ({penalty_sql(10)})""",
    dec="score:5",
)
def _(spark, sf):
    return op.home_quality_score(score_frame(spark, sf))


@register(
    "e7_analysis_readiness",
    """SELECT 100.0 * count(*) / 6 AS score, CASE WHEN count(*) / 6 >= 0.8 THEN 'high' WHEN count(*) / 6 >= 0.5 THEN 'medium' ELSE 'low' END AS level,
    'order_id,user_id,product_id,total_price,category' AS present_columns
    FROM (SELECT unnest(['order_id', 'user_id', 'product_id', 'total_price', 'category']))""",
    dec="score",
)
def _(spark, sf):
    from catalog.frames import sales

    return op.analysis_readiness(sales(spark, sf))


INFO = """SELECT '{c}' AS "column", '{t}' AS data_type, count(DISTINCT {c}) AS unique_count, count(*) - count({c}) AS missing_count,
 100.0 * (count(*) - count({c})) / count(*) AS missing_percentage,
 (SELECT string_agg(v, ', ' ORDER BY v) FROM (SELECT DISTINCT CAST({c} AS VARCHAR) AS v FROM {src} WHERE {c} IS NOT NULL ORDER BY v LIMIT 3)) AS sample_values FROM {src}"""


@register(
    "e8_schema_info",
    " UNION ALL ".join(
        INFO.format(c=c, t=t, src=GAPS_SQL) for c, t in (("o_orderkey", "bigint"), ("priority", "string"), ("visits", "bigint"))
    ),
    dec="missing_percentage",
)
def _(spark, sf):
    return op.schema_info(gaps(spark, sf).select("o_orderkey", "priority", "visits"))


STATS = """SELECT '{c}' AS "column", count(*) - count({c}) AS missing_count, avg({c}) AS mean, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max,
 stddev_samp({c}) AS std, skewness({c}) AS skewness, kurtosis({c}) AS kurtosis, stddev_samp({c}) / avg({c}) AS cv, median({c}) AS median,
 quantile_cont({c}, 0.25) AS p25, quantile_cont({c}, 0.5) AS p50, quantile_cont({c}, 0.75) AS p75, quantile_cont({c}, 0.9) AS p90 FROM lineitem"""


@register("e9_basic_stats", each(STATS, NUMBERS), dec="mean:4 min max std:4 skewness:5 kurtosis:5 cv median p25 p50 p75 p90")
def _(spark, sf):
    return op.basic_stats(table(spark, sf, "lineitem"), NUMBERS, (0.25, 0.5, 0.75, 0.9)).drop("is_normal")


ENTROPY = """(SELECT -sum(p * log2(p)) FROM (SELECT count(*) / sum(count(*)) OVER () AS p FROM src WHERE {c} IS NOT NULL GROUP BY {c}))"""
CSTATS = (
    """SELECT '{c}' AS "column", count(DISTINCT {c}) AS unique_count,
  (SELECT max(n) FROM (SELECT count(*) AS n FROM src WHERE {c} IS NOT NULL GROUP BY {c})) AS top_count,
  100.0 * (SELECT max(n) FROM (SELECT count(*) AS n FROM src WHERE {c} IS NOT NULL GROUP BY {c})) / count({c}) AS top_percentage,
  count(*) - count({c}) AS missing_count,
  (SELECT string_agg(v, ', ' ORDER BY n DESC, v) FROM (SELECT {c} AS v, count(*) AS n FROM src WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY n DESC, v LIMIT 3)) AS top_values,
  """
    + ENTROPY
    + """ AS entropy FROM src"""
)


@register("e10_categorical_stats", CAT_SRC + each(CSTATS, ["priority", "status"]), dec="top_percentage:2 entropy")
def _(spark, sf):
    return op.categorical_stats(cat_frame(spark, sf))


@register("e11_entropy", "SELECT 'p_brand' AS \"column\", entropy(p_brand) AS entropy FROM part", dec="entropy")
def _(spark, sf):
    return op.entropy(table(spark, sf, "part"), "p_brand")


@register(
    "e12_describe_numeric",
    f"""WITH src AS (SELECT c_acctbal AS a FROM customer), p AS ({PROFILE.format(c='a')})
    SELECT 'c_acctbal' AS "column", missing_count, missing_percentage, unique_count, min, max, mean, median, std, skewness, kurtosis, zeros_count, negative_count,
    (upper_bound - lower_bound) / 4 AS iqr, lower_bound, upper_bound, outliers_count, outliers_percentage FROM p""",
    dec="missing_percentage min max mean:4 median std:4 skewness:5 kurtosis:5 iqr:4 lower_bound:4 upper_bound:4 outliers_percentage",
)
def _(spark, sf):
    return op.describe_numeric(table(spark, sf, "customer"), "c_acctbal")


@register(
    "e13_describe_categorical",
    f"""WITH src AS (SELECT p_brand FROM part), c AS (SELECT p_brand AS category, count(*) AS "count" FROM src GROUP BY 1),
    m AS (SELECT * FROM c ORDER BY "count" DESC, category LIMIT 1)
    SELECT 'p_brand' AS "column", c.category, c."count", {ENTROPY.format(c='p_brand')} AS entropy, (SELECT count(*) FROM c) = 2 AS is_binary,
    m.category AS mode, m."count" AS mode_count, 100.0 * m."count" / (SELECT count(*) FROM src) AS mode_percentage FROM c, m
    ORDER BY c."count" DESC, c.category LIMIT 5""",
    dec="entropy mode_percentage",
)
def _(spark, sf):
    return op.describe_categorical(table(spark, sf, "part"), "p_brand")


@register(
    "e14_describe_datetime",
    """WITH p AS (SELECT 'weekday' AS part, CAST(isodow(o_orderdate) - 1 AS INT) AS value FROM orders
      UNION ALL SELECT 'month', CAST(month(o_orderdate) AS INT) FROM orders)
    SELECT part, value, count(*) AS "count", (SELECT min(o_orderdate) FROM orders) AS min_date, (SELECT max(o_orderdate) FROM orders) AS max_date,
    (SELECT CAST(date_diff('day', min(o_orderdate), max(o_orderdate)) AS INT) FROM orders) AS range_days FROM p GROUP BY 1, 2""",
)
def _(spark, sf):
    return op.describe_datetime(table(spark, sf, "orders"), "o_orderdate")


OUT = """SELECT '{c}' AS "column", count(*) FILTER ({c} < lo OR {c} > hi) AS outlier_count,
  100.0 * count(*) FILTER ({c} < lo OR {c} > hi) / count({c}) AS outlier_percentage, any_value(lo) AS lower_bound, any_value(hi) AS upper_bound FROM src, """
OUT_DEC = "outlier_percentage lower_bound:4 upper_bound:4"
OUT_SRC = "WITH src AS (SELECT value, CAST(user_id * user_id AS DOUBLE) AS u2 FROM events) "


def out_frame(spark, sf):
    return table(spark, sf, "events").selectExpr("value", "CAST(user_id * user_id AS DOUBLE) AS u2")


@register(
    "e15_outliers_iqr",
    OUT_SRC + each(OUT + "(SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM src))", ["value", "u2"]),
    dec=OUT_DEC,
)
def _(spark, sf):
    return op.outliers(out_frame(spark, sf), "iqr", 1.5)


@register(
    "e16_outliers_zscore",
    OUT_SRC + each(OUT + "(SELECT avg({c}) - 2 * stddev_pop({c}) AS lo, avg({c}) + 2 * stddev_pop({c}) AS hi FROM src)", ["value", "u2"]),
    dec=OUT_DEC,
)
def _(spark, sf):
    return op.outliers(out_frame(spark, sf), "zscore", 2.0)


@register(
    "e17_outliers_quantile",
    OUT_SRC + each(OUT + "(SELECT quantile_cont({c}, 0.015) AS lo, quantile_cont({c}, 0.985) AS hi FROM src)", ["value", "u2"]),
    dec=OUT_DEC,
)
def _(spark, sf):
    return op.outliers(out_frame(spark, sf), "quantile", 1.5)


@register(
    "e18_text_columns",
    "SELECT * FROM (" + each("""SELECT '{c}' AS "column", count(DISTINCT {c}) / count(*) AS unique_ratio FROM documents""", ["text", "lang", "source"]) + ") WHERE unique_ratio > 0.5",
    dec="unique_ratio",
)
def _(spark, sf):
    return op.text_columns(table(spark, sf, "documents"))


@register(
    "e19_text_stats",
    r"""WITH m AS (SELECT text, length(text) AS n, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS w FROM documents)
    SELECT count(text) AS "count", count(*) - count(text) AS missing_count, count(DISTINCT text) AS unique_count, count(DISTINCT text) / count(text) AS unique_ratio,
    CAST(min(n) AS INT) AS min_length, CAST(max(n) AS INT) AS max_length, avg(n) AS mean_length, median(n) AS median_length,
    CAST(min(w) AS INT) AS min_words, CAST(max(w) AS INT) AS max_words, avg(w) AS mean_words, median(w) AS median_words,
    count(*) FILTER (text = '') AS empty_count, count(*) FILTER (regexp_matches(text, '^\s+$')) AS whitespace_only_count,
    count(*) FILTER (regexp_matches(text, '\d')) AS contains_numbers_count, count(*) FILTER (regexp_matches(text, '\d')) / count(text) AS contains_numbers_ratio FROM m""",
    dec="unique_ratio mean_length median_length mean_words median_words contains_numbers_ratio",
)
def _(spark, sf):
    return op.text_stats(table(spark, sf, "documents"), "text")


# a word is a whole run of word characters made of Latin or Hangul letters only
STOP = ", ".join(f"'{w}'" for w in ENGLISH_STOP_WORDS)


@register(
    "e20_word_frequencies",
    f"""SELECT word, count(*) AS frequency FROM (SELECT unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{M}}\\p{{N}}_]+')) AS word FROM documents)
    WHERE regexp_full_match(word, '[a-zA-Z가-힣]+') AND word NOT IN ({STOP}) GROUP BY 1 HAVING count(*) >= 2 ORDER BY 2 DESC, 1 LIMIT 30""",
)
def _(spark, sf):
    return op.word_frequencies(table(spark, sf, "documents"), "text", top_n=30)


@register(
    "e21_dominant_category",
    CAT_SRC + """SELECT 'status' AS "column", v AS category, 100.0 * n / (SELECT count(status) FROM src) AS percentage
    FROM (SELECT status AS v, count(*) AS n FROM src GROUP BY 1 ORDER BY n DESC, v LIMIT 1) WHERE 100.0 * n / (SELECT count(status) FROM src) > 30""",
    dec="percentage",
)
def _(spark, sf):
    return op.dominant_category(cat_frame(spark, sf), threshold=30.0)
