"""Allocation of a token budget over sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def unimax(sizes: DataFrame, key: str, size_col: str, epochs: float, budget: float, chars_per_token: float = 4.0) -> DataFrame:
    """(key, tokens, leftover): an even share of the budget for each source, capped at `epochs` passes.

    In ascending order of size every source may take an equal part of what is left. The sequential
    rule has a closed form: up to the first source whose cap isn't below its part all take their
    cap, and from there on all take that part. Sources are few; the window runs over their sizes.
    """
    up = Window.orderBy("__u", key)
    s = sizes.select(key, (F.col(size_col) / chars_per_token).alias("__u"))
    s = s.withColumns({"__i": F.row_number().over(up) - 1, "__n": F.count("*").over(Window.partitionBy()), "__cap": F.col("__u") * epochs})
    s = s.withColumn("__before", F.coalesce(F.sum("__cap").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("__part", (F.lit(float(budget)) - F.col("__before")) / (F.col("__n") - F.col("__i")))
    s = s.withColumn("__stop", F.min(F.when(F.col("__cap") >= F.col("__part"), F.struct("__i", "__part"))).over(Window.partitionBy()))
    tokens = F.when(F.col("__stop").isNull() | (F.col("__i") < F.col("__stop.__i")), F.col("__cap")).otherwise(F.col("__stop.__part"))
    s = s.withColumn("tokens", tokens)
    return s.select(key, "tokens", (F.lit(float(budget)) - F.sum("tokens").over(Window.partitionBy())).alias("leftover"))
