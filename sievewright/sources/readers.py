"""Sources: Parquet with partition pruning, JSON lines, CSV, benchmark loading."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_corpus(spark: SparkSession, path: str, partition: dict[str, str] | None = None, columns: list[str] | None = None) -> DataFrame:
    """A Parquet corpus; partition selects directories (pruned, not filtered), columns are pruned at the scan."""
    df = spark.read.parquet(path)
    for name, value in (partition or {}).items():
        df = df.where(F.col(name) == value)
    return df.select(*columns) if columns else df


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its files make up one split at most (a single row group, say); any larger table stays as it is read."""
    spark = df.sparkSession
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size()))
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return df.repartition(spark.sparkContext.defaultParallelism) if 1 << 20 <= size <= split else df


def with_row_id(df: DataFrame, order: list[str], id_col: str = "__id__") -> DataFrame:
    """Dense ids from 0 in a total order, without pulling the table through one task.

    Rows are range-partitioned by the order; each partition's offset is the count of those before
    it. The partition sizes are a driver-side list as long as the number of partitions.
    """
    from sievewright.session import materialize

    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id())
    ranged = materialize(ranged.withColumn("__at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "ids")
    sizes = {r["__part"]: r["n"] for r in ranged.groupBy("__part").agg(F.count("*").alias("n")).collect()}
    starts, total = {}, 0
    for part in sorted(sizes):
        starts[part] = total
        total += sizes[part]
    if not starts:
        return df.withColumn(id_col, F.lit(0).cast("long")).limit(0)
    offset = F.create_map(*[F.lit(x) for kv in starts.items() for x in kv])
    return ranged.withColumn(id_col, (offset[F.col("__part")] + F.col("__at")).cast("long")).drop("__part", "__at")


def read_params(spark: SparkSession, path: str) -> dict:
    """What writers.write_params() wrote. Parameters are few by nature; they come to the driver."""
    return {r["name"]: json.loads(r["value"]) for r in spark.read.schema("name string, value string").json(path).collect()}


def read_jsonl(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """JSON lines under a path or glob."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path)


def read_jsonl_raw(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with the unchanged line in `raw` beside the parsed fields."""
    parsed = spark.read.text(path).select(F.col("value").alias("raw"), F.from_json("value", schema).alias("j"))
    return parsed.select("raw", "j.*")


def read_source(spark: SparkSession, path: str, kind: str, order: list[str], cache_path: str | None = None) -> DataFrame:
    """Parquet, JSON lines or an earlier cached copy, with a dense __id__; written to cache_path if given."""
    if kind == "cached":
        return spark.read.parquet(path)
    df = spark.read.json(path) if kind == "jsonl" else spark.read.parquet(path)
    df = with_row_id(df, order)
    if cache_path:
        df.write.mode("overwrite").parquet(cache_path)
        df = spark.read.parquet(cache_path)
    return df


def read_csv(spark: SparkSession, path: str, drop_last_without: str | None = None) -> DataFrame:
    """CSV with a header; rows without a value in drop_last_without (totals) are left out."""
    df = spark.read.csv(path, header=True, inferSchema=True)
    return df.where(F.col(drop_last_without).isNotNull()) if drop_last_without else df


def joined_text(df: DataFrame, columns: list[str]) -> Column:
    """String and string-list columns joined by blanks."""
    kinds = dict(df.dtypes)
    return F.concat_ws(" ", *(F.array_join(c, " ") if kinds[c].startswith("array") else F.col(c) for c in columns))


def load_benchmark(splits: list[DataFrame], columns: list[str]) -> DataFrame:
    """The union of a benchmark's splits with its text columns joined as __content__."""
    out = splits[0]
    for s in splits[1:]:
        out = out.unionByName(s)
    return out.withColumn("__content__", joined_text(out, columns))


def task_range(df: DataFrame, low: int, high: int, expected: int | None = None, id_col: str = "task_id") -> DataFrame:
    """Rows with id in [low, high]; raises when run if there aren't exactly `expected`."""
    out = df.where(F.col(id_col).between(low, high))
    if expected is None:
        return out
    n = F.count("*").over(Window.partitionBy())
    return out.withColumn("__n", n).where(F.when(F.col("__n") != expected, F.raise_error(F.concat(F.lit("rows: "), F.col("__n").cast("string")))).otherwise(True)).drop("__n")


def docstring_of(prompt: Column) -> Column:
    """The docstring of a prompt: between the only pair of triple double quotes, or the second of two pairs, or the only pair of triple single quotes."""
    parts, single = F.split(prompt, '"""'), F.split(prompt, "'''")
    from sievewright.functions.text import strip

    return (
        F.when(F.size(parts) == 3, strip(F.element_at(parts, 2)))
        .when(F.size(parts) == 5, strip(F.element_at(parts, 4)))
        .when(F.size(single) == 3, strip(F.element_at(single, 2)))
        .otherwise(F.raise_error(F.lit("no docstring")))
    )


def public_settings(df: DataFrame, col: str = "config") -> DataFrame:
    """A map column without the keys that start with an underscore."""
    return df.withColumn(col, F.map_filter(col, lambda k, _: ~F.startswith(k, F.lit("_"))))
