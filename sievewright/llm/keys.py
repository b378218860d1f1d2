"""Document ids of any type as 64-bit keys, and the number of shuffle partitions that a table needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
PARTITION_BYTES = 64 << 20


def is_whole(docs: DataFrame, id_col: str) -> bool:
    return isinstance(docs.schema[id_col].dataType, WHOLE)


def key_of(docs: DataFrame, id_col: str) -> Column:
    """The id itself if it is a whole number, else a 64-bit hash of it; null for a null id."""
    col = F.col(f"`{id_col}`")
    return col.cast("long") if is_whole(docs, id_col) else F.when(col.isNotNull(), F.xxhash64(col.cast("string")))


def restore(out: DataFrame, docs: DataFrame, id_col: str, *keys: str) -> DataFrame:
    """out with the ids of docs in place of the keys in the columns `keys`: as they are for whole numbers, else by an equi-join."""
    if is_whole(docs, id_col):
        return out
    names = docs.where(F.col(f"`{id_col}`").isNotNull()).select(key_of(docs, id_col).alias("__key"), F.col(f"`{id_col}`").alias("__name")).distinct()
    for k in keys:
        columns = [F.col("__name").alias(k) if c == k else F.col(c) for c in out.columns]
        out = out.join(names.withColumnRenamed("__key", "__k"), F.col(k) == F.col("__k"), "left").select(columns)
    return out


def partitions_for(docs: DataFrame, share: float = 1.0) -> int:
    """Shuffle partitions for `share` times the size of the files under docs: the session's number, or more where those would be too large."""
    leaves = docs._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size()))
    # a table without files has no known size, and Spark then names a number beyond all others
    wanted = int(size * share / PARTITION_BYTES) + 1 if size < 1 << 60 else 1
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(wanted, 1 << 20))
