"""Threaded conversations: every conversation is a thread, every turn an event."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievewright.operators import threads
from sievewright.plans.common import table

AUTHORS = {"system": "release-watch[bot]", "assistant": "helper"}
MAIL = "\nFrom: someone\nReply to this email directly, view it on GitHub now\nsent from afar"


def _author():
    out = F.lit("asker")
    for role, name in AUTHORS.items():
        out = F.when(F.col("role") == role, name).otherwise(out)
    return out


def _threads(spark, d):
    turns = table(spark, d, "conversations").withColumn("author", _author())
    return threads.collect_threads(turns, "conv_id", "turn", "author", "text")


def _without_bots(spark, d):
    counted = threads.add_counts(_threads(spark, d))
    return threads.add_counts(threads.remove_bots(counted), suffix="_no_bots", users=False)


def thread_merge(spark, d):
    """Even turns hold their text as a comment, odd ones as a description."""
    turns = table(spark, d, "conversations").withColumns(
        {"comment": F.when(F.col("turn") % 2 == 0, F.col("text")), "description": F.when(F.col("turn") % 2 == 1, F.col("text"))}
    )
    rows = turns.groupBy("conv_id").agg(F.collect_list(F.struct("turn", "comment", "description")).alias("events"))
    return threads.merge_text(rows).select("conv_id", F.inline("events"))


def thread_stats(spark, d):
    return threads.add_counts(_threads(spark, d)).drop("events")


def thread_bot_filter(spark, d):
    return _without_bots(spark, d).drop("events")


def thread_bot_report(spark, d):
    out = threads.bot_report(_without_bots(spark, d))
    return out.select(*(F.round(c, 6).alias(c) for c in out.columns))


def thread_user_filter(spark, d):
    return _without_bots(spark, d).where(threads.by_users(200, 7000)).select("conv_id", "user_count", "text_size_no_bots")


def thread_size_windows(spark, d):
    """Threads in windows of text size and number of events."""
    t, n = F.col("text_size"), F.col("event_count")
    windows = {"100-200": t.between(100, 200), "6000-7000": t.between(6000, 7000), "200-7000": t.between(200, 7000), "one": n == 1, "two": n == 2, "ten or more": n >= 10}
    wide = threads.add_counts(_threads(spark, d)).agg(*(F.count_if(c).alias(k) for k, c in windows.items()))
    return wide.unpivot([], list(windows), "win", "n")


def thread_percentiles(spark, d):
    return threads.percentile_table(threads.add_counts(_threads(spark, d)), [5, 25, 50, 75, 95, 99], ["user_count", "event_count", "text_size"])


def thread_render(spark, d):
    """Conversations as text, plain and with the metadata of every event."""
    turns = table(spark, d, "conversations").withColumn("author", _author())
    event = F.struct("turn", "author", "text", F.lit("created").alias("action"), F.col("role").alias("type"), F.concat(F.lit("turn "), F.col("turn").cast("string")).alias("title"))
    rows = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(event)).alias("events"))
    return rows.select("conv_id", threads.render(F.col("events")).alias("rendered"), threads.render(F.col("events"), ("action", "type", "title")).alias("detailed"))


def email_strip(spark, d):
    """Every third turn quotes a mail."""
    quoted = F.when(F.col("turn") % 3 == 0, F.concat("text", F.lit(MAIL))).otherwise(F.col("text"))
    turns = table(spark, d, "conversations").select("conv_id", "turn", F.lit("x").alias("author"), quoted.alias("text"))
    out = threads.strip_mail(threads.collect_threads(turns, "conv_id", "turn", "author", "text"))
    return out.select("conv_id", F.inline("events")).select("conv_id", "turn", "text")


QUERIES = {
    f.__name__: f
    for f in (
        thread_merge,
        thread_stats,
        thread_bot_filter,
        thread_bot_report,
        thread_user_filter,
        thread_size_windows,
        thread_percentiles,
        thread_render,
        email_strip,
    )
}

_COUNTED = """c AS (
  SELECT conv_id, count(DISTINCT role) AS user_count, count(*) AS event_count, CAST(sum(coalesce(length(text), 0)) AS BIGINT) AS text_size,
         count(*) FILTER (role <> 'system') AS event_count_no_bots, CAST(sum(CASE WHEN role <> 'system' THEN coalesce(length(text), 0) ELSE 0 END) AS BIGINT) AS text_size_no_bots
  FROM conversations GROUP BY conv_id)"""
_PERCENTS = "(VALUES (5.0::DOUBLE), (25), (50), (75), (95), (99)) p(percent)"


def _at(col: str) -> str:
    cases = " ".join(f"WHEN {p} THEN quantile_cont({col}, {p / 100})" for p in (5, 25, 50, 75, 95, 99))
    return f"CAST(trunc(CASE percent {cases} END) AS BIGINT) AS {col}"


ORACLES = {
    "thread_merge": "SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations",
    "thread_stats": f"WITH {_COUNTED} SELECT conv_id, user_count, event_count, text_size FROM c",
    "thread_bot_filter": f"WITH {_COUNTED} SELECT *, event_count_no_bots = 0 AS bot_issue, event_count_no_bots < event_count AS modified_by_bot FROM c",
    "thread_bot_report": f"""
WITH {_COUNTED} SELECT round(count(*) FILTER (event_count_no_bots < event_count) * 100.0::DOUBLE / count(*), 6) AS modified_pct,
 round(count(*) FILTER (event_count_no_bots = 0) * 100.0::DOUBLE / count(*), 6) AS removed_pct,
 round(sum(event_count - event_count_no_bots) * 100.0::DOUBLE / sum(event_count), 6) AS events_removed_pct FROM c""",
    "thread_user_filter": f"WITH {_COUNTED} SELECT conv_id, user_count, text_size_no_bots FROM c WHERE user_count >= 2 OR (text_size_no_bots BETWEEN 200 AND 7000 AND event_count <= 10)",
    "thread_size_windows": f"""
WITH {_COUNTED} SELECT '100-200' AS win, count(*) AS n FROM c WHERE text_size BETWEEN 100 AND 200 UNION ALL
SELECT '6000-7000', count(*) FROM c WHERE text_size BETWEEN 6000 AND 7000 UNION ALL SELECT '200-7000', count(*) FROM c WHERE text_size BETWEEN 200 AND 7000 UNION ALL
SELECT 'one', count(*) FROM c WHERE event_count = 1 UNION ALL SELECT 'two', count(*) FROM c WHERE event_count = 2 UNION ALL SELECT 'ten or more', count(*) FROM c WHERE event_count >= 10""",
    "thread_percentiles": f"WITH {_COUNTED} SELECT percent, {_at('user_count')}, {_at('event_count')}, {_at('text_size')} FROM c, {_PERCENTS} GROUP BY percent",
    "thread_render": """
SELECT conv_id, string_agg(concat_ws(chr(10), 'author: ' || CASE role WHEN 'system' THEN 'release-watch[bot]' WHEN 'assistant' THEN 'helper' ELSE 'asker' END, text, repeat('-', 75)), chr(10) ORDER BY turn) AS rendered,
       string_agg(concat_ws(chr(10), 'author: ' || CASE role WHEN 'system' THEN 'release-watch[bot]' WHEN 'assistant' THEN 'helper' ELSE 'asker' END || ', created ' || role || ': turn ' || turn, text, repeat('-', 75)), chr(10) ORDER BY turn) AS detailed
FROM conversations GROUP BY conv_id""",
    "email_strip": r"SELECT conv_id, turn, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS text FROM conversations",
}
