"""Statistics, orderings, joins and allocations over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievewright.functions.text import letter_count, token_set
from sievewright.operators import mixture, projection, stats
from sievewright.operators.extract import language_report
from sievewright.plans.common import sql_tokens, table

EPOCHS, BUDGET = 5.0, 400_000.0
VIRTUAL = [("notebooks", 20_000.0), ("issues", 100_000.0), ("commits", 80_000.0)]


def size_histogram(spark, d):
    return stats.histogram(table(spark, d, "documents"), "n_chars", 0.0, 20_000.0, 40)


def size_cdf(spark, d):
    return stats.cumulative(size_histogram(spark, d)).select("bin", "n", "running", F.round("share", 9).alias("share"))


def size_percentiles(spark, d):
    out = stats.percentiles(table(spark, d, "documents"), "n_chars", [1, 25, 50, 75, 90, 99], ["lang"])
    return out.select("lang", "percent", F.round("n_chars", 6).alias("n_chars"))


def size_summary(spark, d):
    out = stats.describe(table(spark, d, "documents"), "n_chars", ["lang"])
    return out.withColumns({"mean": F.round("mean", 6), "median": F.round("median", 6)})


def lang_distribution(spark, d):
    return language_report(table(spark, d, "documents"), F.col("lang")).withColumn("pct", F.round("pct", 6))


def letter_ratios(spark, d):
    out = stats.ratios(table(spark, d, "documents"), letter_count(F.col("text")), F.length("text"), ["lang"])
    return out.select("lang", F.round("ratio_of_sums", 6).alias("ratio_of_sums"), F.round("mean_of_ratios", 6).alias("mean_of_ratios"))


def role_counts(spark, d):
    return stats.value_counts(table(spark, d, "conversations"), "role")


def distinct_words(spark, d):
    """Distinct words, sources and texts by language."""
    docs = table(spark, d, "documents")
    words = docs.select("lang", F.explode(token_set(F.col("text"))).alias("w")).groupBy("lang").agg(F.count_distinct("w").alias("words"))
    return docs.groupBy("lang").agg(F.count_distinct("source").alias("sources"), F.count_distinct("text").alias("texts")).join(words, "lang")


def largest_documents(spark, d):
    """Top 20 by size; a missing size counts as nothing."""
    return table(spark, d, "documents").select("doc_id", F.coalesce("n_chars", F.lit(0)).alias("n_chars")).orderBy(F.desc("n_chars"), "doc_id").limit(20)


def seeded_sample(spark, d):
    return projection.hash_shuffle(table(spark, d, "documents").select("doc_id", "lang"), "doc_id", 42, 100)


def first_sources(spark, d):
    return stats.first_positions(table(spark, d, "documents"), "source", "doc_id")


def call_averages(spark, d):
    calls = table(spark, d, "events").select("event_type", "value", F.lit(1).alias("calls"))
    return stats.averages_with_total(calls, "event_type", "value", "calls").withColumn("average", F.round("average", 6))


def event_ratio(spark, d):
    """Mean value of clicks over that of views, by user."""
    events = table(spark, d, "events")
    series = lambda kind: events.where(F.col("event_type") == kind).groupBy("user_id").agg(F.avg("value").alias("value"))
    return stats.series_ratio(series("click"), series("view"), "user_id", "value").select("user_id", F.round("ratio", 6).alias("ratio"))


def unimax_allocation(spark, d):
    sizes = table(spark, d, "documents").groupBy(F.col("source").alias("name")).agg(F.sum("n_chars").cast("double").alias("size"))
    sizes = sizes.unionByName(spark.createDataFrame(VIRTUAL, "name string, size double"))
    out = mixture.unimax(sizes, "name", "size", EPOCHS, BUDGET)
    return out.select("name", F.round("tokens", 4).alias("tokens"), F.round("leftover", 4).alias("leftover"))


def scored_runs(spark, d):
    """Orders with their customers where known, and the customers' nations by an inner join on renamed keys."""
    left = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), "o_totalprice").join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), "c_custkey", "left")
    nations = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return left.join(nations, "c_nationkey").groupBy("n_name").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def recoded_types(spark, d):
    """Fixed spellings of event types and keys cut out of names."""
    named = projection.recode(table(spark, d, "events"), "event_type", {"signup": "sign-up", "error": "failure"})
    key = projection.key_after(F.col("props"), '"k": ', "}")
    return named.select("event_type", key.alias("k")).groupBy("event_type", "k").agg(F.count("*").alias("n"))


def expanded_props(spark, d):
    """JSON settings as columns."""
    parsed = table(spark, d, "events").select("event_id", F.from_json("props", "k long").alias("props"))
    return projection.expand_struct(parsed, "props")


QUERIES = {
    f.__name__: f
    for f in (
        size_histogram,
        size_cdf,
        size_percentiles,
        size_summary,
        lang_distribution,
        letter_ratios,
        role_counts,
        distinct_words,
        largest_documents,
        first_sources,
        seeded_sample,
        call_averages,
        event_ratio,
        unimax_allocation,
        scored_runs,
        recoded_types,
        expanded_props,
    )
}

_HIST = """h AS (
  SELECT CAST(least(floor(n_chars / 500.0::DOUBLE), 39) AS INTEGER) AS bin, count(*) AS n FROM documents WHERE n_chars BETWEEN 0 AND 20000 GROUP BY 1)"""
_CASES = " ".join(f"WHEN {p} THEN quantile_cont(n_chars, {p / 100})" for p in (1, 25, 50, 75, 90, 99))

ORACLES = {
    "size_histogram": f"WITH {_HIST} SELECT bin, bin * 500.0::DOUBLE AS bin_low, n FROM h",
    "size_cdf": f"WITH {_HIST} SELECT bin, n, CAST(sum(n) OVER (ORDER BY bin) AS BIGINT) AS running, round(sum(n) OVER (ORDER BY bin) / sum(n) OVER ()::DOUBLE, 9) AS share FROM h",
    "size_percentiles": f"""
SELECT lang, percent, round(CASE percent {_CASES} END, 6) AS n_chars FROM documents, (VALUES (1.0::DOUBLE), (25), (50), (75), (90), (99)) p(percent) GROUP BY lang, percent""",
    "size_summary": "SELECT lang, count(n_chars) AS n, round(avg(n_chars), 6) AS mean, round(median(n_chars), 6) AS median, min(n_chars) AS least, max(n_chars) AS most FROM documents GROUP BY lang",
    "lang_distribution": "SELECT lang AS language, count(*) AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 6) AS pct, lang <> 'en' AS foreign FROM documents GROUP BY lang".replace("foreign", '"foreign"'),
    "letter_ratios": r"""
WITH m AS (SELECT lang, length(regexp_replace(text, '\P{L}', '', 'g')) AS a, length(text) AS b FROM documents)
SELECT lang, round(sum(a) * 100.0::DOUBLE / nullif(sum(b), 0), 6) AS ratio_of_sums, round(avg(a::DOUBLE / nullif(b, 0)) * 100, 6) AS mean_of_ratios FROM m GROUP BY lang""",
    "role_counts": "SELECT role, count(*) AS n FROM conversations GROUP BY role",
    "distinct_words": f"""
SELECT lang, sources, texts, words FROM (SELECT lang, count(DISTINCT source) AS sources, count(DISTINCT text) AS texts FROM documents GROUP BY lang)
JOIN (SELECT lang, count(DISTINCT w) AS words FROM (SELECT lang, unnest({sql_tokens('text')}) AS w FROM documents) GROUP BY lang) USING (lang)""",
    "seeded_sample": "SELECT doc_id, lang FROM documents ORDER BY md5(concat_ws(':', CAST(doc_id AS VARCHAR), '42')), doc_id LIMIT 100",
    "largest_documents": "SELECT doc_id, coalesce(n_chars, 0) AS n_chars FROM documents ORDER BY 2 DESC, 1 LIMIT 20",
    "first_sources": "SELECT source, min(doc_id) AS first FROM documents GROUP BY source".replace("first", '"first"'),
    "call_averages": """
WITH a AS (SELECT event_type, sum(value) / count(*) AS average FROM events GROUP BY event_type)
SELECT event_type, round(average, 6) AS average FROM a UNION ALL SELECT 'TOTAL', round(sum(average), 6) FROM a""",
    "event_ratio": """
SELECT a.user_id, round(a.v / b.v, 6) AS ratio FROM (SELECT user_id, avg(value) AS v FROM events WHERE event_type = 'click' GROUP BY 1) a
JOIN (SELECT user_id, avg(value) AS v FROM events WHERE event_type = 'view' GROUP BY 1) b USING (user_id)""",
    "unimax_allocation": f"""
WITH RECURSIVE s AS (SELECT source AS name, CAST(sum(n_chars) AS DOUBLE) AS size FROM documents GROUP BY source UNION ALL VALUES {', '.join(map(str, VIRTUAL))}),
o AS (SELECT name, size / 4 AS u, row_number() OVER (ORDER BY size, name) - 1 AS i, count(*) OVER () AS n FROM s),
w AS (SELECT CAST(-1 AS BIGINT) AS i, NULL::VARCHAR AS name, 0.0::DOUBLE AS tokens, {BUDGET}::DOUBLE AS b
      UNION ALL SELECT o.i, o.name, least({EPOCHS} * o.u, w.b / (o.n - o.i)), w.b - least({EPOCHS} * o.u, w.b / (o.n - o.i)) FROM w JOIN o ON o.i = w.i + 1)
SELECT name, round(tokens, 4) AS tokens, round({BUDGET} - (SELECT sum(tokens) FROM w), 4) AS leftover FROM w WHERE i >= 0""",
    "scored_runs": """
SELECT n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders LEFT JOIN customer ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name""",
    "recoded_types": """
SELECT CASE event_type WHEN 'signup' THEN 'sign-up' WHEN 'error' THEN 'failure' ELSE event_type END AS event_type, regexp_extract(props, '"k": ([^}]*)', 1) AS k, count(*) AS n FROM events GROUP BY 1, 2""",
    "expanded_props": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
}
