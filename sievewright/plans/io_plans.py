"""Readers, writers and the small row operators: every query writes or reads a whole table and gives back what arrived."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from sievewright.operators import projection, quality, stats
from sievewright.plans.common import sql_config, sql_tokens, table
from sievewright.session import scratch
from sievewright.sources import readers, writers


def _docs(spark, d):
    return table(spark, d, "documents")


def corpus_partition(spark, d):
    """One language of a corpus in folders by language, with two of its columns."""
    path = scratch(spark, "corpus")
    _docs(spark, d).write.mode("overwrite").partitionBy("lang").parquet(path)
    return readers.read_corpus(spark, path, {"lang": "de"}, ["doc_id", "n_chars"])


def corpus_with_ids(spark, d):
    """Parquet with dense ids in the order of doc_id, through a cached copy."""
    path, cache = scratch(spark, "corpus"), scratch(spark, "cache")
    _docs(spark, d).write.mode("overwrite").parquet(path)
    readers.read_source(spark, path, "parquet", ["doc_id"], cache)
    return readers.read_source(spark, cache, "cached", ["doc_id"]).select("__id__", "doc_id", "lang")


def corpus_from_jsonl(spark, d):
    """JSON lines with dense ids."""
    path = scratch(spark, "jsonl")
    writers.write_json(_docs(spark, d).select("doc_id", "text", "source"), path)
    return readers.read_source(spark, path, "jsonl", ["doc_id"]).select("__id__", "doc_id", F.sha2("text", 256).alias("digest"), "source")


def jsonl_glob(spark, d):
    """JSON lines of several folders by a glob, counted by language."""
    base = scratch(spark, "jsonl")
    for k in range(3):
        writers.write_json(_docs(spark, d).where(F.col("doc_id") % 3 == k), f"{base}/data_{k}.jsonl")
    df = readers.read_jsonl(spark, f"{base}/data_*.jsonl", "doc_id long, text string, lang string")
    return df.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("characters"))


def jsonl_raw(spark, d):
    """JSON lines with the raw line, which must hold what was parsed."""
    path = scratch(spark, "jsonl")
    writers.write_json(table(spark, d, "benchmark"), path)
    df = readers.read_jsonl_raw(spark, path, "item_id long, text string")
    again = F.from_json("raw", "item_id long, text string")
    return df.select("item_id", "text", (again["item_id"] == F.col("item_id")).alias("same"))


def csv_without_total(spark, d):
    """A CSV table whose last row is a total without a key."""
    path = scratch(spark, "csv")
    rows = table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    total = rows.agg(F.lit(None).cast("int").alias("n_nationkey"), F.lit("total").alias("n_name"), F.sum("n_regionkey").alias("n_regionkey"))
    rows.unionByName(total).write.mode("overwrite").csv(path, header=True)
    return readers.read_csv(spark, path, "n_nationkey").select(*(F.col(c).cast("long") if c != "n_name" else F.col(c) for c in rows.columns))


def benchmark_content(spark, d):
    """Two splits of a benchmark as one, with string and list columns joined."""
    items = table(spark, d, "benchmark").withColumn("tags", F.array(F.lit("tag"), F.concat(F.lit("t"), (F.col("item_id") % 3).cast("string"))))
    splits = [items.where(F.col("item_id") % 2 == k) for k in (0, 1)]
    return readers.load_benchmark(splits, ["text", "tags"]).select("item_id", F.col("__content__").alias("content"))


def task_docstrings(spark, d):
    """Docstrings of prompts in three forms."""
    t, quotes, single = F.col("text"), F.lit('"""'), F.lit("'''")
    prompt = F.when(F.col("item_id") % 3 == 0, F.concat(F.lit("def f():\n    "), quotes, F.lit(" "), t, F.lit("\n    "), quotes, F.lit("\n")))
    prompt = prompt.when(F.col("item_id") % 3 == 1, F.concat(quotes, F.lit("Module."), quotes, F.lit("\ndef f():\n    "), quotes, t, quotes)).otherwise(F.concat(F.lit("def f():\n    "), single, t, single))
    return table(spark, d, "benchmark").select("item_id", readers.docstring_of(prompt).alias("docstring"))


def task_range(spark, d):
    """The tasks of a published range of ids, whose number is checked."""
    return readers.task_range(table(spark, d, "benchmark"), 11, 30, 20, "item_id").select("item_id", "text")


def public_settings(spark, d):
    """Settings of runs without their private keys, one row for each."""
    settings = F.create_map(F.lit("_step"), F.col("event_id").cast("string"), F.lit("kind"), F.col("event_type"), F.lit("value"), F.round("value", 3).cast("string"))
    df = readers.public_settings(table(spark, d, "events").select("event_id", settings.alias("config")))
    return df.select("event_id", F.explode("config").alias("name", "setting")).where("name = 'kind'")


def stored_params(spark, d):
    """Fitted parameters written and read: the mean size of each language."""
    path = scratch(spark, "params")
    means = {r["lang"]: r["m"] for r in _docs(spark, d).groupBy("lang").agg(F.avg("n_chars").alias("m")).collect()}
    writers.write_params(spark, path, {"mean_size": means, "languages": sorted(means)})
    got = readers.read_params(spark, path)
    return spark.createDataFrame([(k, round(got["mean_size"][k], 6)) for k in got["languages"]], "lang string, mean double")


def pandas_round_trip(spark, d):
    """A small table to pandas and back."""
    pdf = table(spark, d, "nation").toPandas()
    return spark.createDataFrame(pdf).select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name")


def sized_shards(spark, d):
    """Named shards of some 64 KB, read again with the shard's place."""
    path = scratch(spark, "shards")
    size = _docs(spark, d).agg(F.sum("n_chars")).first()[0] or 0
    writers.write_shards(_docs(spark, d), path, "doc_id", size, max(64 << 10, size // 200))
    df = spark.read.parquet(path).withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    return df.select("doc_id", "lang", F.col("file").rlike(r"^train-\d{5}-of-\d{5}[.]parquet$").alias("named"))


def saved_table(spark, d):
    """A table written by columns and read whole."""
    path = scratch(spark, "saved")
    _docs(spark, d).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path).select("doc_id", "lang", "source", F.sha2("text", 256).alias("digest"))


def part_counters(spark, d):
    """Nested counters of many parts, by source, added up."""
    inner = _docs(spark, d).groupBy("source", "lang").agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars"))
    value = F.map_from_arrays(F.array(F.lit("docs"), F.lit("chars")), F.array("docs", "chars"))
    parts = inner.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("lang", value))).alias("counter"))
    return writers.merge_nested(parts, "counter").select(F.array_join("path", "/").alias("path"), "n")


def merged_counters(spark, d):
    """Flat counters of parts added up by key."""
    parts = _docs(spark, d).groupBy("source", "lang").agg(F.count("*").alias("n"))
    return writers.merge_counters(parts, "lang", "n")


def written_split(spark, d):
    """Both outputs of a split by the configuration rule."""
    kept, removed = scratch(spark, "kept"), scratch(spark, "removed")
    writers.write_split(_docs(spark, d), quality.is_config_or_test(F.col("text")), kept, removed)
    side = lambda path, name: spark.read.parquet(path).select("doc_id", F.lit(name).alias("side"))
    return side(kept, "kept").unionByName(side(removed, "removed"))


def token_text(spark, d):
    """A text file with one document a line, tokens joined by blanks."""
    from sievewright.functions.text import tokens

    path = scratch(spark, "tokens")
    writers.write_token_text(_docs(spark, d).select(tokens(F.col("text")).alias("t")), path, "t")
    return spark.read.text(path).select(F.sha2("value", 256).alias("line")).groupBy("line").agg(F.count("*").alias("n"))


def batch_map(spark, d):
    """A function over batches of rows: characters and words of every document."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "characters": pdf["text"].str.len(), "blanks": pdf["text"].str.count(" ")})

    return _docs(spark, d).select("doc_id", "text").mapInPandas(run, "doc_id long, characters long, blanks long")


def housekeeping(spark, d):
    """Columns renamed, dropped, chosen by name and cast."""
    df = _docs(spark, d).withColumnRenamed("n_chars", "TEST_size").withColumn("size", F.col("TEST_size").cast("string")).drop("text")
    return projection.select_columns(df, lambda c: "TEST_" not in c)


def lookup_by_position(spark, d):
    """The document at the position that a table of positions names."""
    docs = readers.with_row_id(_docs(spark, d).select("doc_id", "lang"), ["doc_id"])
    wanted = table(spark, d, "benchmark").select("item_id", (F.col("item_id") * 3).alias("__id__"))
    return wanted.join(docs, "__id__").select("item_id", "doc_id", "lang")


def formatted_numbers(spark, d):
    """Numbers as labels."""
    df = table(spark, d, "nation").select("n_nationkey", (F.col("n_nationkey") * 1250.5).alias("c"))
    return projection.label_columns(df, c="%.2f").select("n_nationkey", "c_label")


def complete_runs(spark, d):
    """Runs that reached 99 % of their planned steps: users by their greatest event, of the longest user's."""
    last = table(spark, d, "events").groupBy("user_id").agg(F.max("event_id").alias("step"))
    planned = table(spark, d, "events").agg(F.max("event_id").alias("planned"))
    return last.crossJoin(F.broadcast(planned)).where(quality.run_is_complete(F.col("step"), F.col("planned"))).select("user_id", "step")


def loss_gap(spark, d):
    """Rows where one loss exceeds the other by more than a gap: mean values of clicks and views by user."""
    e = table(spark, d, "events").groupBy("user_id").agg(F.avg(F.when(F.col("event_type") == "click", F.col("value"))).alias("a"), F.avg(F.when(F.col("event_type") == "view", F.col("value"))).alias("b"))
    return quality.gap_at_least(e, F.col("a"), F.col("b"), 1.0).select("user_id")


def named_runs(spark, d):
    """Rows whose name a regular expression finds, counted by name."""
    return quality.named(table(spark, d, "events"), F.col("event_type"), "^(click|sign.*)$").groupBy("event_type").agg(F.count("*").alias("n"))


def complete_rows(spark, d):
    """Rows without nulls or empty strings, and with a positive label."""
    df = _docs(spark, d).join(table(spark, d, "labels"), "doc_id", "left")
    return quality.complete_rows(df, ["lang", "source", "quality"], F.col("quality") > 0).select("doc_id", "lang")


def profile_table(spark, d):
    """Nested profiles as flat rows."""
    e = table(spark, d, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("n"), F.sum("value").alias("v"))
    e = e.withColumns({"batch": (F.col("user_id") % 2 * 8 + 8).cast("long"), "length": (F.col("user_id") % 5 * 128 + 64).cast("long")})
    part = F.struct(F.col("user_id").cast("string").alias("key"), F.round("v", 4).alias("cpu"), F.lit(0.0).alias("cuda"), F.col("n").alias("total"))
    by_length = e.groupBy("event_type", "batch", "length").agg(F.collect_list(part).alias("parts"))
    by_batch = by_length.groupBy("event_type", "batch").agg(F.collect_list(F.struct("length", "parts")).alias("lengths"))
    by_type = by_batch.groupBy("event_type").agg(F.collect_list(F.struct("batch", "lengths")).alias("batches"))
    whole = by_type.select(F.create_map("event_type", "batches").alias("profile"))
    return stats.profile_rows(whole).select("cls", "batch", "length", "key", "cpu", "total")


QUERIES = {
    f.__name__: f
    for f in (
        corpus_partition,
        corpus_with_ids,
        corpus_from_jsonl,
        jsonl_glob,
        jsonl_raw,
        csv_without_total,
        benchmark_content,
        task_docstrings,
        task_range,
        public_settings,
        stored_params,
        pandas_round_trip,
        sized_shards,
        saved_table,
        part_counters,
        merged_counters,
        written_split,
        token_text,
        batch_map,
        housekeeping,
        lookup_by_position,
        formatted_numbers,
        complete_runs,
        loss_gap,
        named_runs,
        complete_rows,
        profile_table,
    )
}

ORACLES = {
    "corpus_partition": "SELECT doc_id, n_chars FROM documents WHERE lang = 'de'",
    "corpus_with_ids": "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS __id__, doc_id, lang FROM documents",
    "corpus_from_jsonl": "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS __id__, doc_id, sha256(text) AS digest, source FROM documents",
    "jsonl_glob": "SELECT lang, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS characters FROM documents GROUP BY lang",
    "jsonl_raw": "SELECT item_id, text, true AS same FROM benchmark",
    "csv_without_total": "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation",
    "benchmark_content": "SELECT item_id, text || ' tag t' || (item_id % 3) AS content FROM benchmark",
    "task_docstrings": r"SELECT item_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS docstring FROM benchmark",
    "task_range": "SELECT item_id, text FROM benchmark WHERE item_id BETWEEN 11 AND 30",
    "public_settings": "SELECT event_id, 'kind' AS name, event_type AS setting FROM events",
    "stored_params": "SELECT lang, round(avg(n_chars), 6) AS mean FROM documents GROUP BY lang",
    "pandas_round_trip": "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation",
    "sized_shards": "SELECT doc_id, lang, true AS named FROM documents",
    "saved_table": "SELECT doc_id, lang, source, sha256(text) AS digest FROM documents",
    "part_counters": """
SELECT lang || '/docs' AS path, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT lang || '/chars', CAST(sum(n_chars) AS BIGINT) FROM documents GROUP BY lang""",
    "merged_counters": "SELECT lang, count(*) AS n FROM documents GROUP BY lang",
    "written_split": f"SELECT doc_id, CASE WHEN {sql_config('text')} THEN 'removed' ELSE 'kept' END AS side FROM documents",
    "token_text": f"SELECT sha256(array_to_string({sql_tokens('text')}, ' ')) AS line, count(*) AS n FROM documents GROUP BY 1",
    "batch_map": "SELECT doc_id, length(text) AS characters, length(text) - length(replace(text, ' ', '')) AS blanks FROM documents",
    "housekeeping": "SELECT doc_id, lang, source, CAST(n_chars AS VARCHAR) AS size FROM documents",
    "lookup_by_position": "SELECT item_id, doc_id, lang FROM benchmark JOIN (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS k, doc_id, lang FROM documents) ON k = item_id * 3",
    "formatted_numbers": "SELECT n_nationkey, printf('%.2f', CAST(n_nationkey * 1250.5 AS DOUBLE)) AS c_label FROM nation",
    "complete_runs": "SELECT user_id, max(event_id) AS step FROM events GROUP BY user_id HAVING max(event_id) >= 0.99 * (SELECT max(event_id) FROM events)",
    "loss_gap": """
SELECT user_id FROM (SELECT user_id, avg(value) FILTER (event_type = 'click') AS a, avg(value) FILTER (event_type = 'view') AS b FROM events GROUP BY user_id) WHERE a - b > 1.0""",
    "named_runs": "SELECT event_type, count(*) AS n FROM events WHERE event_type = 'click' OR starts_with(event_type, 'sign') GROUP BY event_type",
    "complete_rows": "SELECT doc_id, lang FROM documents JOIN labels USING (doc_id) WHERE quality > 0 AND lang <> '' AND source <> ''",
    "profile_table": """
SELECT event_type AS cls, CAST(user_id % 2 * 8 + 8 AS BIGINT) AS batch, CAST(user_id % 5 * 128 + 64 AS BIGINT) AS length, CAST(user_id AS VARCHAR) AS key, round(sum(value), 4) AS cpu, count(*) AS total
FROM events GROUP BY event_type, user_id""",
}
