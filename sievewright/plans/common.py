"""Tables and SQL fragments that several plans share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sievewright.sources.readers import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def sql_lines(text: str) -> str:
    """The lines of a text in DuckDB, as functions.text.lines()."""
    parts = rf"string_split_regex({text}, '\r\n|[\n\r\x0B\f\x1C-\x1E\x{{85}}\x{{2028}}\x{{2029}}]')"
    return f"(CASE WHEN {parts}[-1] = '' THEN {parts}[:-2] ELSE {parts} END)"


def sql_count(text: str, needle: str) -> str:
    return f"CAST((length({text}) - length(replace({text}, '{needle}', ''))) / {len(needle)} AS BIGINT)"


def sql_tokens(text: str) -> str:
    return f"[t FOR t IN string_split_regex({text}, '[^A-Za-z_0-9]') IF t <> '']"


def sql_head(text: str, phrases: tuple[str, ...]) -> str:
    return f"len([l FOR l IN {sql_lines(text)}[:5] IF regexp_matches(lower(l), '{'|'.join(phrases)}')]) > 0"


def sql_config(text: str) -> str:
    low, allowed = f"lower({text})", f"{sql_count(text, chr(10))} // 20"
    head = sql_head(text, ("configuration file", "test file", "unit tests"))
    return f"({head} OR {sql_count(low, 'config')} > {allowed} OR {sql_count(low, 'test')} > {allowed})"


def sql_pass_at_k(n: str, c: str, k: str) -> str:
    product = f"list_reduce(list_prepend(1.0::DOUBLE, [1.0::DOUBLE - {k}::DOUBLE / x FOR x IN range({n} - {c} + 1, {n} + 1)]), lambda a, b: a * b)"
    return f"(CASE WHEN {n} - {c} < {k} THEN 1.0 WHEN {c} = 0 THEN 0.0 ELSE 1.0 - {product} END)"
