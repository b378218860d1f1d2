"""Document-quality rules over documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievewright.functions.text import line_statistics, lines, occurrences
from sievewright.operators import projection, quality, stats
from sievewright.plans.common import sql_config, sql_count, sql_head, sql_lines, table


def config_or_test_flags(spark, d):
    return table(spark, d, "documents").select("doc_id", quality.is_config_or_test(F.col("text")).alias("config_or_test"))


def config_or_test_report(spark, d):
    return quality.removal_report(table(spark, d, "documents"), quality.is_config_or_test(F.col("text")), "text")


def config_or_test_split(spark, d):
    kept, removed = quality.split_by(table(spark, d, "documents"), quality.is_config_or_test(F.col("text")))
    side = lambda df, name: df.select("doc_id", F.lit(name).alias("side"))
    return side(kept, "kept").unionByName(side(removed, "removed"))


def autogenerated_flags(spark, d):
    return table(spark, d, "documents").select("doc_id", quality.is_autogenerated(F.col("text")).alias("autogenerated"))


def few_assignments(spark, d):
    return table(spark, d, "documents").select("doc_id", occurrences(F.col("text"), "=").alias("assignments"), quality.has_few_assignments(F.col("text")).alias("few"))


def no_keywords(spark, d):
    return table(spark, d, "documents").select("doc_id", quality.has_no_code_words(F.col("text")).alias("no_keywords"))


def heuristic_overlap(spark, d):
    flags = {"few": quality.has_few_assignments(F.col("text")), "nokw": quality.has_no_code_words(F.col("text")), "config": quality.is_config_or_test(F.col("text"))}
    out = quality.flag_overlaps(table(spark, d, "documents"), flags)
    return out.select("flag", "n", F.round("pct", 6).alias("pct"))


def line_stats(spark, d):
    most, mean, alnum = line_statistics(F.col("text"))
    return table(spark, d, "documents").select("doc_id", most.cast("long").alias("max_line_length"), F.round(mean, 6).alias("avg_line_length"), F.round(alnum, 6).alias("alphanum_fraction"))


def line_stats_filter(spark, d):
    df = table(spark, d, "documents")
    return df.where(quality.has_odd_lines(F.col("text"))).select("doc_id", "lang")


def content_classes(spark, d):
    return table(spark, d, "pages").select("page_id", quality.content_class(F.col("html")).alias("class"))


def content_class_pivot(spark, d):
    return stats.class_pivot(table(spark, d, "documents"), ["source", "lang"], quality.content_class(F.col("text")), ["xml", "data", "unknown"])


def size_bands(spark, d):
    df = projection.add_length(projection.add_size(table(spark, d, "documents"), "text"), "text")
    return df.groupBy(quality.size_band(F.col("size")).alias("band")).agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.sum("nl_size").alias("characters"))


def mathjax_counts(spark, d):
    return table(spark, d, "pages").select("page_id", quality.math_expressions(F.col("html")).cast("long").alias("n"))


def mathjax_report(spark, d):
    both = table(spark, d, "pages").select(F.col("html").alias("t")).unionByName(table(spark, d, "documents").select(F.concat(F.lit("$$x$$ \\("), "source", F.lit("\\) "), F.col("text")).alias("t")))
    hit = quality.math_expressions(F.col("t")) > 0
    return both.agg(
        F.count("*").alias("docs"),
        F.count_if(hit).alias("matching"),
        F.round(F.count_if(hit) * 100.0 / F.count("*"), 6).alias("pct"),
        F.sum(F.when(hit, F.length("t")).otherwise(0)).alias("characters"),
        F.round(F.sum(F.when(hit, F.length("t")).otherwise(0)) / 3.5, 4).alias("tokens"),
    )


def stars_threshold_sweep(spark, d):
    """Documents with 0 to 39 stars; every seventh number is unknown."""
    df = table(spark, d, "documents").withColumn("stars", F.when(F.col("doc_id") % 7 != 0, F.col("doc_id") * 31 % 40))
    out = quality.threshold_sweep(df, F.col("stars"), F.length("text"), [0, 3, 5, 10, 15], ["lang"])
    return out.select("lang", "threshold", "removed", F.round("rows_pct", 6).alias("rows_pct"), F.round("volume_pct", 6).alias("volume_pct"))


def null_to_zero(spark, d):
    df = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return projection.null_to_zero(df, "quality").select("doc_id", F.col("quality").cast("int").alias("quality"))


def alnum_ratio_report(spark, d):
    _, _, alnum = line_statistics(F.col("text"))
    return quality.comment_ratio_report(table(spark, d, "documents"), alnum, 0.75, 0.8)


def known_path(spark, d):
    df = table(spark, d, "documents")
    return df.where(quality.in_known_path(F.col("source"), F.col("lang"), "src1/e")).select("doc_id")


def extension_quality(spark, d):
    most, _, alnum = line_statistics(F.col("text"))
    return stats.extension_quality(table(spark, d, "documents"), ["lang", "source"], {"low_alphanum": alnum < 0.75, "long_lines": most > 1000, "non_text": ~F.col("text").rlike("[a-z]")})


def line_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(lines(F.col("text"))).cast("long").alias("n_lines"))


QUERIES = {
    f.__name__: f
    for f in (
        config_or_test_flags,
        config_or_test_report,
        config_or_test_split,
        autogenerated_flags,
        few_assignments,
        no_keywords,
        heuristic_overlap,
        line_stats,
        line_stats_filter,
        content_classes,
        content_class_pivot,
        size_bands,
        mathjax_counts,
        mathjax_report,
        stars_threshold_sweep,
        null_to_zero,
        alnum_ratio_report,
        known_path,
        extension_quality,
        line_counts,
    )
}

_LEN = f"[length(l) FOR l IN {sql_lines('text')}]"
_MOST = f"coalesce(list_max({_LEN}), 0)"
_ALNUM = r"length(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g')) / nullif(length(text), 0)"
_CLASS = r"""CASE WHEN contains(substr({0}, 1, 100), '<?xml version=') THEN 'xml'
 WHEN length(regexp_replace({0}, '\P{{L}}', '', 'g')) <= 0.25 * length({0}) THEN 'data' ELSE 'unknown' END"""
_NOKW = "NOT (contains(lower(text), 'def ') OR contains(lower(text), 'class ') OR contains(lower(text), 'for ') OR contains(lower(text), 'while '))"
_FEW = f"{sql_count('text', '=')} <= 4"
_MATH = r"len([m FOR m IN regexp_extract_all({0}, '\$\$.*?\$\$|\\\(.*?\\\)|\\\[.*?\\\]') IF regexp_matches(m, '\p{{L}}')])"

ORACLES = {
    "config_or_test_flags": f"SELECT doc_id, {sql_config('text')} AS config_or_test FROM documents",
    "config_or_test_split": f"SELECT doc_id, CASE WHEN {sql_config('text')} THEN 'removed' ELSE 'kept' END AS side FROM documents",
    "config_or_test_report": f"""
SELECT *, (rows_before - rows_after) * 100.0::DOUBLE / rows_before AS rows_removed_pct, (volume_before - volume_after) * 100.0::DOUBLE / volume_before AS volume_removed_pct,
       (volume_before - volume_after) * 100.0::DOUBLE / nullif(volume_after, 0) AS volume_removed_pct_of_new
FROM (SELECT count(*) AS rows_before, count(*) FILTER (NOT f) AS rows_after, CAST(sum(n) AS BIGINT) AS volume_before,
             CAST(sum(CASE WHEN f THEN 0 ELSE n END) AS BIGINT) AS volume_after
      FROM (SELECT length(text) AS n, {sql_config('text')} AS f FROM documents))""",
    "autogenerated_flags": f"SELECT doc_id, {sql_head('text', ('autogenerated', 'auto-generated', 'automatically generated'))} AS autogenerated FROM documents",
    "few_assignments": f"SELECT doc_id, {sql_count('text', '=')} AS assignments, {_FEW} AS few FROM documents",
    "no_keywords": f"SELECT doc_id, {_NOKW} AS no_keywords FROM documents",
    "heuristic_overlap": f"""
WITH f AS (SELECT {_FEW} AS few, {_NOKW} AS nokw, {sql_config('text')} AS config FROM documents)
SELECT flag, n, round(n * 100.0::DOUBLE / (SELECT count(*) FROM f), 6) AS pct FROM (
 SELECT 'few' AS flag, count(*) AS n FROM f WHERE few UNION ALL SELECT 'nokw', count(*) FROM f WHERE nokw UNION ALL
 SELECT 'config', count(*) FROM f WHERE config UNION ALL SELECT 'few&nokw', count(*) FROM f WHERE few AND nokw UNION ALL
 SELECT 'few&config', count(*) FROM f WHERE few AND config UNION ALL SELECT 'nokw&config', count(*) FROM f WHERE nokw AND config)""",
    "line_stats": f"SELECT doc_id, CAST({_MOST} AS BIGINT) AS max_line_length, round(list_avg({_LEN}), 6) AS avg_line_length, round({_ALNUM}, 6) AS alphanum_fraction FROM documents",
    "line_stats_filter": f"SELECT doc_id, lang FROM documents WHERE {_MOST} > 1000 OR coalesce(list_avg({_LEN}) > 100, false) OR coalesce({_ALNUM} < 0.25, false)",
    "content_classes": f"SELECT page_id, {_CLASS.format('html')} AS class FROM pages",
    "content_class_pivot": f"""
SELECT source, lang, count(*) FILTER (c = 'xml') AS xml, count(*) FILTER (c = 'data') AS data, count(*) FILTER (c = 'unknown') AS unknown
FROM (SELECT source, lang, {_CLASS.format('text')} AS c FROM documents) GROUP BY source, lang""",
    "size_bands": """
SELECT CASE WHEN b < 750 THEN 'small' WHEN b > 10000 THEN 'large' ELSE 'middle' END AS band, count(*) AS n, CAST(sum(b) AS BIGINT) AS bytes, CAST(sum(c) AS BIGINT) AS characters
FROM (SELECT strlen(text) AS b, length(text) AS c FROM documents) GROUP BY 1""",
    "mathjax_counts": f"SELECT page_id, CAST({_MATH.format('html')} AS BIGINT) AS n FROM pages",
    "mathjax_report": rf"""
WITH both_ AS (SELECT html AS t FROM pages UNION ALL SELECT '$$x$$ \(' || source || '\) ' || text FROM documents), m AS (SELECT length(t) AS n, {_MATH.format('t')} > 0 AS hit FROM both_)
SELECT count(*) AS docs, count(*) FILTER (hit) AS matching, round(count(*) FILTER (hit) * 100.0::DOUBLE / count(*), 6) AS pct,
       CAST(sum(CASE WHEN hit THEN n ELSE 0 END) AS BIGINT) AS characters, round(sum(CASE WHEN hit THEN n ELSE 0 END) / 3.5::DOUBLE, 4) AS tokens FROM m""",
    "stars_threshold_sweep": """
WITH s AS (SELECT lang, CASE WHEN doc_id % 7 <> 0 THEN doc_id * 31 % 40 ELSE 0 END AS stars, length(text) AS n FROM documents)
SELECT lang, CAST(threshold AS DOUBLE) AS threshold, count(*) FILTER (stars <= threshold) AS removed, round(count(*) FILTER (stars <= threshold) * 100.0::DOUBLE / count(*), 6) AS rows_pct,
       round(sum(CASE WHEN stars <= threshold THEN n ELSE 0 END) * 100.0::DOUBLE / sum(n), 6) AS volume_pct
FROM s, (VALUES (0), (3), (5), (10), (15)) t(threshold) GROUP BY lang, threshold""",
    "null_to_zero": "SELECT doc_id, CAST(coalesce(quality, 0) AS INTEGER) AS quality FROM documents LEFT JOIN labels USING (doc_id)",
    "alnum_ratio_report": f"""
WITH r AS (SELECT {_ALNUM} AS r FROM documents)
SELECT count(*) AS total, count(*) FILTER (r > 0.75 AND r <= 0.8) AS kept, count(*) FILTER (r < 1e-6) AS "none", count(*) FILTER (r < 0.75) AS below_low,
       count(*) FILTER (r > 0.75) AS above_75, count(*) FILTER (r > 0.8) AS above_high, count(*) FILTER (r > 0.9) AS above_90 FROM r""",
    "known_path": "SELECT doc_id FROM documents WHERE contains(source || '/' || lang, 'src1/e')",
    "extension_quality": f"""
SELECT lang, source, count(*) AS n, count(*) FILTER ({_ALNUM} < 0.75) AS low_alphanum, count(*) FILTER ({_MOST} > 1000) AS long_lines,
       count(*) FILTER (NOT regexp_matches(text, '[a-z]')) AS non_text FROM documents GROUP BY lang, source""",
    "line_counts": f"SELECT doc_id, CAST(len({sql_lines('text')}) AS BIGINT) AS n_lines FROM documents",
}
