"""Sinks: sized Parquet shards, JSON, text, and split outputs."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewright.session import materialize


def shard_count(total_bytes: int, shard_bytes: int = 1000 << 20, share: float = 1.0) -> int:
    return int(total_bytes * share / shard_bytes) + 1


def write_shards(df: DataFrame, path: str, order: str, total_bytes: int, shard_bytes: int = 1000 << 20, share: float = 1.0) -> int:
    """Contiguous Parquet shards of about shard_bytes in the order of a column; returns how many.

    They are called train-00000-of-00007.parquet and so on. An empty range has no file, so the number
    is that of the files.
    """
    n = shard_count(total_bytes, shard_bytes, share)
    df.repartitionByRange(n, order).sortWithinPartitions(order).write.mode("overwrite").parquet(path)
    return name_shards(df.sparkSession, path)


def name_shards(spark: SparkSession, path: str, stem: str = "train") -> int:
    """Rename the part files of a written folder by their order; a rename for each shard and no data moved."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    parts = sorted(f.getPath().getName() for f in files.listStatus(folder) if f.getPath().getName().startswith("part-"))
    for k, name in enumerate(parts):
        files.rename(hadoop.Path(folder, name), hadoop.Path(folder, f"{stem}-{k:05d}-of-{len(parts):05d}.parquet"))
    return len(parts)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_token_text(df: DataFrame, path: str, tokens_col: str) -> None:
    """One document a line, tokens joined by blanks."""
    df.select(F.array_join(tokens_col, " ").alias("value")).write.mode("overwrite").text(path)


def write_split(df: DataFrame, flag: Column, kept_path: str, removed_path: str) -> None:
    """Rows where flag is true go to removed_path and the rest, nulls included, to kept_path, in one evaluation."""
    marked = materialize(df.withColumn("__removed", F.coalesce(flag, F.lit(False))), "split")
    marked.where(~F.col("__removed")).drop("__removed").write.mode("overwrite").parquet(kept_path)
    marked.where("__removed").drop("__removed").write.mode("overwrite").parquet(removed_path)


def merge_counters(df: DataFrame, key: str, value: str) -> DataFrame:
    """Counters of many parts added up by key."""
    return df.groupBy(key).agg(F.sum(value).alias(value))


def merge_nested(df: DataFrame, col: str) -> DataFrame:
    """Nested counters (maps of maps of numbers, to any depth) of many parts added up, as (path, n); path lists the keys.

    A null counter and a null number add nothing.
    """
    rows = df.select(F.array().cast("array<string>").alias("path"), F.col(f"`{col}`").alias("v"))
    while rows.schema["v"].dataType.typeName() == "map":
        rows = rows.select("path", F.explode("v").alias("k", "v")).select(F.concat("path", F.array(F.col("k").cast("string"))).alias("path"), "v")
    return rows.where("v IS NOT NULL").groupBy("path").agg(F.sum("v").alias("n"))


def write_params(spark: SparkSession, path: str, params: dict) -> None:
    """Fitted parameters (anything that JSON can hold) as one JSON line for each name."""
    rows = [(k, json.dumps(v)) for k, v in params.items()]
    spark.createDataFrame(rows, "name string, value string").coalesce(1).write.mode("overwrite").json(path)
