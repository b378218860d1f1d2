"""Rule-based document filters; every rule is a boolean Column over a text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewright.functions.text import head, letter_count, line_statistics, occurrences

CONFIG_OR_TEST_HEADS = ("configuration file", "test file", "unit tests")
GENERATED_HEADS = ("autogenerated", "auto-generated", "automatically generated")
CODE_WORDS = ("class ", "while ", "def ", "for ")
MATH = r"(?d)\$\$.*?\$\$|\\\(.*?\\\)|\\\[.*?\\\]"


def _head_has(text: Column, phrases: tuple[str, ...], width: int) -> Column:
    return F.lower(head(text, width)).rlike("|".join(phrases))


def is_config_or_test(text: Column, width: int = 5, share: int = 20) -> Column:
    """A telling phrase in the first lines, or more mentions of "config" or of "test" than one per `share` line breaks."""
    allowed = F.floor(occurrences(text, "\n") / share)
    low = F.lower(text)
    return _head_has(text, CONFIG_OR_TEST_HEADS, width) | (occurrences(low, "config") > allowed) | (occurrences(low, "test") > allowed)


def is_autogenerated(text: Column, width: int = 5) -> Column:
    return _head_has(text, GENERATED_HEADS, width)


def has_few_assignments(text: Column, most: int = 4) -> Column:
    return occurrences(text, "=") <= most


def has_no_code_words(text: Column) -> Column:
    low = F.lower(text)
    hit = F.lit(False)
    for w in CODE_WORDS:
        hit = hit | F.contains(low, F.lit(w))
    return ~hit


def has_odd_lines(text: Column, longest: int = 1000, mean: int = 100, alnum: float = 0.25) -> Column:
    """Too long lines, too long lines on average, or too few letters and digits."""
    most, average, share = line_statistics(text)
    return (most > longest) | F.coalesce(average > mean, F.lit(False)) | F.coalesce(share < alnum, F.lit(False))


def content_class(text: Column) -> Column:
    """"xml" by a declaration in the first 100 characters, "data" when at most a quarter are letters, else "unknown"."""
    return (
        F.when(F.contains(F.substring(text, 1, 100), F.lit("<?xml version=")), "xml")
        .when(letter_count(text) <= 0.25 * F.length(text), "data")
        .otherwise("unknown")
    )


def math_expressions(text: Column) -> Column:
    """How many TeX expressions of a page have a letter in them."""
    found = F.regexp_extract_all(text, F.lit(MATH), F.lit(0))
    return F.size(F.filter(found, lambda m: m.rlike(r"\p{L}")))


def split_by(df: DataFrame, flag: Column) -> tuple[DataFrame, DataFrame]:
    """(kept, removed): complementary rows; a null flag keeps."""
    removed = F.coalesce(flag, F.lit(False))
    return df.where(~removed), df.where(removed)


def removal_report(df: DataFrame, flag: Column, text_col: str) -> DataFrame:
    """One row of counts and volumes (characters) before and after removing flagged rows.

    volume_removed_pct is of the old volume; volume_removed_pct_of_new divides by what is left, as
    some published reports do.
    """
    marked = df.select(F.length(text_col).alias("size"), F.coalesce(flag, F.lit(False)).alias("gone"))
    size, gone = F.col("size"), F.col("gone")
    one = marked.agg(
        F.count("*").alias("rows_before"),
        F.count_if(~gone).alias("rows_after"),
        F.sum(size).alias("volume_before"),
        F.sum(F.when(~gone, size).otherwise(0)).alias("volume_after"),
    )
    lost = F.col("volume_before") - F.col("volume_after")
    return one.withColumns(
        {
            "rows_removed_pct": F.try_divide((F.col("rows_before") - F.col("rows_after")) * 100.0, F.col("rows_before")),
            "volume_removed_pct": F.try_divide(lost * 100.0, F.col("volume_before")),
            "volume_removed_pct_of_new": F.try_divide(lost * 100.0, F.col("volume_after")),
        }
    )


def flag_overlaps(df: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """Counts and percentages of every flag and of every pair of flags, in one pass."""
    names = list(flags)
    marked = df.select(*(F.coalesce(c, F.lit(False)).alias(n) for n, c in flags.items()))
    aggs = [F.count("*").alias("total")] + [F.count_if(n).alias(n) for n in names]
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    aggs += [F.count_if(F.col(a) & F.col(b)).alias(f"{a}&{b}") for a, b in pairs]
    keys = names + [f"{a}&{b}" for a, b in pairs]
    wide = marked.agg(*aggs)
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("flag"), F.col(f"`{k}`").alias("n")) for k in keys)))
    return wide.select("total", rows.alias("r")).select("r.flag", "r.n", F.try_divide(F.col("r.n") * 100.0, F.col("total")).alias("pct"))


def threshold_sweep(df: DataFrame, value: Column, size: Column, thresholds: list[float], keys: list[str] | None = None) -> DataFrame:
    """For each threshold: rows with value at most it, and their share of rows and of volume; a null value counts as 0."""
    v = F.coalesce(value, F.lit(0))
    aggs = [F.count("*").alias("total"), F.sum(size).alias("volume")]
    for k, t in enumerate(thresholds):
        aggs += [F.count_if(v <= t).alias(f"n{k}"), F.sum(F.when(v <= t, size).otherwise(0)).alias(f"v{k}")]
    marked = df.groupBy(*(keys or [])).agg(*aggs)
    each = F.explode(F.array(*(F.struct(F.lit(float(t)).alias("threshold"), F.col(f"n{k}").alias("n"), F.col(f"v{k}").alias("v")) for k, t in enumerate(thresholds))))
    return marked.select(*(keys or []), "total", "volume", each.alias("r")).select(
        *(keys or []), "r.threshold", F.col("r.n").alias("removed"), F.try_divide(F.col("r.n") * 100.0, F.col("total")).alias("rows_pct"), F.try_divide(F.col("r.v") * 100.0, F.col("volume")).alias("volume_pct")
    )


def size_band(size: Column, low: int = 750, high: int = 10_000) -> Column:
    return F.when(size < low, "small").when(size > high, "large").otherwise("middle")


def comment_ratio_report(df: DataFrame, ratio: Column, low: float = 0.01, high: float = 0.8) -> DataFrame:
    """How many rows a comment-ratio filter keeps, and the counts at the usual cuts."""
    return df.agg(
        F.count("*").alias("total"),
        F.count_if((ratio > low) & (ratio <= high)).alias("kept"),
        F.count_if(ratio < 1e-6).alias("none"),
        F.count_if(ratio < low).alias("below_low"),
        F.count_if(ratio > 0.75).alias("above_75"),
        F.count_if(ratio > high).alias("above_high"),
        F.count_if(ratio > 0.9).alias("above_90"),
    )


def in_bands(df: DataFrame, value: Column, bounds: list[float]) -> DataFrame:
    """For each bound the rows whose value is greater, as one table with `bound`; a null value is in none."""
    rows = F.explode(F.filter(F.array(*(F.lit(float(b)) for b in bounds)), lambda b: value > b)).alias("bound")
    return df.select(*df.columns, rows)


def above(df: DataFrame, value: Column, bound: float) -> DataFrame:
    """Rows whose value, such as a perplexity, is greater than the bound."""
    return df.where(value > bound)


def gap_at_least(df: DataFrame, a: Column, b: Column, gap: float) -> DataFrame:
    """Rows where one loss exceeds the other by more than `gap`; a null on either side keeps nothing."""
    return df.where(a - b > gap)


def named(df: DataFrame, name: Column, pattern: str) -> DataFrame:
    """Rows whose name a regular expression finds (a group of runs); null names have none."""
    return df.where(F.coalesce(name.rlike(pattern), F.lit(False)))


def complete_rows(df: DataFrame, columns: list[str], condition: Column | None = None) -> DataFrame:
    """Rows without a null or an empty string in the columns, and for which the condition holds."""
    kinds = dict(df.dtypes)
    for c in columns:
        df = df.where(F.col(c).isNotNull() & (F.col(c) != "")) if kinds[c] == "string" else df.where(F.col(c).isNotNull())
    return df if condition is None else df.where(condition)


def in_known_path(repository: Column, path: Column, known: str) -> Column:
    return F.contains(F.concat_ws("/", repository, path), F.lit(known))


def run_is_complete(step: Column, planned: Column, share: float = 0.99) -> Column:
    return step >= share * planned
