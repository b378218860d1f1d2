"""Row maps and column housekeeping."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def add_size(df: DataFrame, text_col: str, size_col: str = "size") -> DataFrame:
    """UTF-8 bytes of a text."""
    return df.withColumn(size_col, F.octet_length(text_col).cast("long"))


def add_length(df: DataFrame, text_col: str, length_col: str = "nl_size") -> DataFrame:
    """Code points of a text."""
    return df.withColumn(length_col, F.length(text_col).cast("long"))


def null_to_zero(df: DataFrame, col: str) -> DataFrame:
    return df.withColumn(col, F.coalesce(F.col(col), F.lit(0)))


def expand_struct(df: DataFrame, col: str) -> DataFrame:
    """Replace a struct column by its leaves, named by their path; nested structs are expanded too."""

    def leaves(kind: T.StructType, path: str):
        for f in kind.fields:
            at = f"{path}.`{f.name}`"
            if isinstance(f.dataType, T.StructType):
                yield from ((f"{f.name}.{n}", p) for n, p in leaves(f.dataType, at))
            else:
                yield f.name, at

    new = [F.col(p).alias(n) for n, p in leaves(df.schema[col].dataType, f"`{col}`")]
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c != col), *new)


def select_columns(df: DataFrame, keep: Callable[[str], bool]) -> DataFrame:
    """Columns whose name satisfies keep."""
    return df.select(*(F.col(f"`{c}`") for c in df.columns if keep(c)))


def recode(df: DataFrame, col: str, values: dict) -> DataFrame:
    """Replace values by a lookup; others stay."""
    if not values:
        return df
    lookup = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    return df.withColumn(col, F.coalesce(F.try_element_at(lookup, F.col(col)), F.col(col)))


def first_rows(df: DataFrame, order: str, n: int) -> DataFrame:
    """The n least rows by order (a top-k, not a full sort)."""
    return df.orderBy(order).limit(n)


def hash_shuffle(df: DataFrame, id_col: str, seed: int, n: int | None = None) -> DataFrame:
    """A permutation of the rows that depends on id and seed alone, or its first n rows."""
    out = df.orderBy(F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.lit(str(seed)))), id_col)
    return out.limit(n) if n is not None else out


def key_after(col: Column, before: str, after: str) -> Column:
    """What stands between the first `before` and the next `after`."""
    return F.split_part(F.split_part(col, F.lit(before), F.lit(2)), F.lit(after), F.lit(1))


def label_columns(df: DataFrame, **formats: str) -> DataFrame:
    """Formatted copies of number columns, e.g. c='%e'."""
    return df.withColumns({f"{c}_label": F.format_string(f, F.col(c)) for c, f in formats.items()})
