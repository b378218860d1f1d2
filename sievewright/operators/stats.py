"""Whole-dataset statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def percentiles(df: DataFrame, col: str, percents: list[float], keys: list[str] | None = None) -> DataFrame:
    """Exact linearly interpolated percentiles, a row for each percent."""
    ps = F.array(*(F.lit(p / 100.0) for p in percents))
    wide = df.groupBy(*(keys or [])).agg(F.percentile(col, ps).alias("v"))
    zipped = F.explode(F.arrays_zip(F.array(*map(F.lit, [float(p) for p in percents])).alias("percent"), F.col("v").alias("value")))
    return wide.select(*(keys or []), zipped.alias("r")).select(*(keys or []), "r.percent", F.col("r.value").alias(col))


def histogram(df: DataFrame, col: str, low: float, high: float, bins: int) -> DataFrame:
    """Rows by equal bins of [low, high]; the last bin is closed; values outside are left out. Empty bins have no row."""
    width = (high - low) / bins
    b = F.least(F.floor((F.col(col) - low) / width), F.lit(bins - 1)).cast("int")
    counted = df.where(F.col(col).between(low, high)).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))
    return counted.select("bin", (F.lit(low) + F.col("bin") * width).alias("bin_low"), "n")


def cumulative(hist: DataFrame) -> DataFrame:
    """A histogram with running counts and shares; the bins are few, so one ordered window over them is cheap."""
    run = F.sum("n").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    return hist.withColumns({"running": run, "share": run / F.sum("n").over(Window.partitionBy())})


def describe(df: DataFrame, col: str, keys: list[str] | None = None) -> DataFrame:
    """Count, mean, exact median, least and greatest."""
    return df.groupBy(*(keys or [])).agg(F.count(col).alias("n"), F.avg(col).alias("mean"), F.median(col).alias("median"), F.min(col).alias("least"), F.max(col).alias("most"))


def value_counts(df: DataFrame, *cols: str) -> DataFrame:
    return df.groupBy(*cols).agg(F.count("*").alias("n"))


def ratios(df: DataFrame, part: Column, whole: Column, keys: list[str] | None = None) -> DataFrame:
    """The ratio of the sums and the mean of the ratios, in percent; they differ when sizes do."""
    return df.groupBy(*(keys or [])).agg(
        F.try_divide(F.sum(part) * 100.0, F.sum(whole)).alias("ratio_of_sums"), (F.avg(F.try_divide(part, whole)) * 100).alias("mean_of_ratios")
    )


def before_after(before: DataFrame, after: DataFrame, key: str, text_col: str, total: str = "total") -> DataFrame:
    """Rows and characters by key before and after a step, the changes in percent, and a row of totals."""

    def sums(df: DataFrame, tag: str) -> DataFrame:
        g = df.groupBy(key).agg(F.count("*").alias(f"rows_{tag}"), F.sum(F.length(text_col)).alias(f"size_{tag}"))
        return g

    both = sums(before, "before").join(sums(after, "after"), key, "left").na.fill(0, ["rows_after", "size_after"])
    names = [f"{a}_{b}" for a in ("rows", "size") for b in ("before", "after")]
    rolled = both.rollup(key).agg(*(F.sum(n).alias(n) for n in names), F.grouping(key).alias("g"))
    change = lambda a: F.try_divide((F.col(f"{a}_after") - F.col(f"{a}_before")) * 100.0, F.col(f"{a}_before"))
    return rolled.select(F.when(F.col("g") == 1, total).otherwise(F.col(key)).alias(key), *names, change("rows").alias("delta_rows_pct"), change("size").alias("delta_size_pct"))


def class_pivot(df: DataFrame, keys: list[str], cls: Column, values: list[str]) -> DataFrame:
    """Counts of each class as columns, by keys."""
    return df.withColumn("__class", cls).groupBy(*keys).pivot("__class", values).agg(F.count(F.lit(1))).na.fill(0, values)


def extension_quality(df: DataFrame, keys: list[str], flags: dict[str, Column]) -> DataFrame:
    """Counts of rows and of flagged rows by keys."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), *(F.count_if(F.coalesce(c, F.lit(False))).alias(name) for name, c in flags.items()))


def averages_with_total(df: DataFrame, key: str, time_col: str, count_col: str, total: str = "TOTAL") -> DataFrame:
    """Time per call by key, and a row with the sum of these averages."""
    per = df.groupBy(key).agg((F.sum(time_col) / F.sum(count_col)).alias("average"))
    return per.rollup(key).agg(F.sum("average").alias("average"), F.grouping(key).alias("g")).select(F.when(F.col("g") == 1, total).otherwise(F.col(key)).alias(key), "average")


def first_positions(df: DataFrame, col: str, order: str) -> DataFrame:
    """Distinct values with the place of their first occurrence (an order-preserving distinct)."""
    return df.groupBy(col).agg(F.min(order).alias("first"))


def series_ratio(a: DataFrame, b: DataFrame, key: str | list[str], value: str) -> DataFrame:
    """Element-wise ratio of two series aligned by key."""
    keys = [key] if isinstance(key, str) else key
    return a.select(*keys, F.col(value).alias("a")).join(b.select(*keys, F.col(value).alias("b")), keys).select(*keys, F.try_divide("a", "b").alias("ratio"))


def profile_rows(df: DataFrame, col: str = "profile") -> DataFrame:
    """A map from class to nested lists of (batch, [(length, [(key, cpu, cuda, total)])]) as flat rows."""
    return (
        df.select(F.explode(col).alias("cls", "batches"))
        .select("cls", F.explode("batches").alias("b"))
        .select("cls", F.col("b.batch").alias("batch"), F.explode("b.lengths").alias("l"))
        .select("cls", "batch", F.col("l.length").alias("length"), F.explode("l.parts").alias("p"))
        .select("cls", "batch", "length", "p.*")
    )
