"""Threaded conversations: one row holds an array of events (author, text and other fields)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEYWORDS = ("travis", "jenkins", "botmanager", "[bot]", "k8s-", "bors-", "-test-")
ENDINGS = ("bot", "-ci", "-test", "-testing", "-linter", "-cloud", "-build", "-benchmark", "-deployer", "-automation", "-automaton", "-teamcity")
NAMES = ("SparkQA", "PyDocTeur", "CLAassistant", "claassistantio", "AutorestCI", "Apache-HBase", "cmsbuild", "coveralls", "codecov-commenter", "codecov-io")
NAMES += ("probot-stale", "karma-pr-reporter", "msftclas", "dnfclas", "danger-public")


def _with(event: Column, fields: list[str], **new: Column) -> Column:
    return F.struct(*(event[f].alias(f) for f in fields if f not in new), *(c.alias(n) for n, c in new.items()))


def _fields(df: DataFrame, events: str) -> list[str]:
    return df.schema[events].dataType.elementType.fieldNames()


def collect_threads(df: DataFrame, key: str, order: str, author: str, text: str) -> DataFrame:
    """One row for each key with its events (turn, author, text) in order."""
    event = F.struct(F.col(order).alias("turn"), F.col(author).alias("author"), F.col(text).alias("text"))
    return df.groupBy(key).agg(F.sort_array(F.collect_list(event)).alias("events"))


def merge_text(df: DataFrame, events: str = "events") -> DataFrame:
    """comment and description of an event become text: the comment unless it is empty, else the description, else nothing."""
    keep = [f for f in _fields(df, events) if f not in ("comment", "description")]
    text = lambda e: F.coalesce(F.nullif(e["comment"], F.lit("")), e["description"], F.lit(""))
    return df.withColumn(events, F.transform(events, lambda e: _with(e, keep, text=text(e))))


def is_bot(author: Column) -> Column:
    """Whether an author's name is that of an automaton; a null author is nobody's."""
    low = F.lower(author)
    hit = author.isin(*NAMES)
    for k in KEYWORDS:
        hit = hit | F.contains(low, F.lit(k))
    for k in ENDINGS:
        hit = hit | F.endswith(low, F.lit(k))
    return F.coalesce(hit, F.lit(False))


def add_counts(df: DataFrame, events: str = "events", suffix: str = "", users: bool = True) -> DataFrame:
    """event_count and text_size, and user_count, of the events as they are."""
    new = {
        f"event_count{suffix}": F.size(events).cast("long"),
        f"text_size{suffix}": F.aggregate(F.col(events), F.lit(0).cast("long"), lambda a, e: a + F.coalesce(F.length(e["text"]), F.lit(0))),
    }
    if users:
        new[f"user_count{suffix}"] = F.size(F.array_distinct(F.transform(events, lambda e: e["author"]))).cast("long")
    return df.withColumns(new)


def remove_bots(df: DataFrame, events: str = "events") -> DataFrame:
    """Events by people only; bot_issue where none is left, modified_by_bot where one went."""
    kept = df.withColumn("__kept", F.filter(events, lambda e: ~is_bot(e["author"])))
    kept = kept.withColumns({"bot_issue": F.size("__kept") == 0, "modified_by_bot": F.size("__kept") < F.size(events)})
    return kept.withColumn(events, F.col("__kept")).drop("__kept")


def bot_report(df: DataFrame) -> DataFrame:
    """Shares of threads changed and emptied and of events removed; needs event_count and event_count_no_bots."""
    return df.agg(
        F.try_divide(F.count_if("modified_by_bot") * 100.0, F.count("*")).alias("modified_pct"),
        F.try_divide(F.count_if("bot_issue") * 100.0, F.count("*")).alias("removed_pct"),
        F.try_divide((F.sum("event_count") - F.sum("event_count_no_bots")) * 100.0, F.sum("event_count")).alias("events_removed_pct"),
    )


def by_users(low: int = 200, high: int = 700, most_events: int = 10) -> Column:
    """Keep threads of two users or more, and those of one whose text is neither short nor long nor in many events."""
    return (F.col("user_count") >= 2) | (F.col("text_size_no_bots").between(low, high) & (F.col("event_count") <= most_events))


_REPLY, _VIEW, _SENDER = "Reply to this email directly", "view it on GitHub", "notifications@github.com"
_STAMP = r"(?:\d+/){2}\d+ \d\d:\d\d [AP]M"


def strip_mail_text(text: str | None) -> str:
    """A message without what a mail client added to it.

    Three whole-message forms are tried, in which everything from the header to the notice goes (in
    the first two the rest of the message too). Otherwise lines from the last header line to the
    last notice or quoted line go; with a header and no notice the lines before it appear twice.
    """
    import re

    text = (text or "").strip()
    forms = (
        rf"(?P<a>.*)From:.+{_REPLY}.+{_VIEW}.*",
        rf"(?P<a>.*)On.+{_SENDER}.+wrote:.+{_REPLY}.+{_VIEW}.*",
        r"(?P<a>.*)Signed-off-by: .+<.+>\n?(?P<b>.*)",
    )
    for form in forms:
        m = re.match(form, text, re.S)
        if m:
            text = m["a"] + (m.groupdict().get("b") or "")
            break
    else:
        rows, head, tail = text.split("\n"), 0, -1
        for k, row in enumerate(map(str.strip, rows)):
            if _SENDER in row or re.search(rf"{_STAMP}.+wrote", row):
                head = k
            if _REPLY in row:
                tail = k + row.endswith(":")
            if row[:1] == ">":
                tail = k
        text = "\n".join(rows[:head] + rows[tail + 1 :])
    return re.sub("_{20,}", "", text).strip()


@F.pandas_udf(T.ArrayType(T.StringType()))
def _strip_all(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for lists in batches:
        yield lists.map(lambda x: None if x is None else [strip_mail_text(t) for t in x])


def strip_mail(df: DataFrame, events: str = "events") -> DataFrame:
    """strip_mail_text() on the text of every event; threads without a telltale string skip Python."""
    fields = _fields(df, events)
    texts = F.transform(events, lambda e: e["text"])
    marks = rf"{_REPLY}|{_SENDER}|Signed-off-by: |(?m)^\s*>|_{{20,}}|{_STAMP}"
    touched = F.exists(events, lambda e: F.coalesce(e["text"].rlike(marks), F.lit(False)))
    out = df.withColumn("__plain", F.when(touched, _strip_all(F.when(touched, texts))))
    from sievewright.functions.text import strip

    plain = F.coalesce("__plain", F.transform(texts, lambda t: F.coalesce(strip(t), F.lit(""))))
    return out.withColumn("__plain", plain).withColumn(events, F.zip_with(events, "__plain", lambda e, t: _with(e, fields, text=t))).drop("__plain")


def percentile_table(df: DataFrame, percents: list[float], columns: list[str]) -> DataFrame:
    """Exact percentiles of several columns, cut to whole numbers, a row for each percent."""
    wide = df.agg(*(F.percentile(c, F.array(*(F.lit(p / 100.0) for p in percents))).alias(c) for c in columns))
    zipped = F.explode(F.arrays_zip(F.array(*map(F.lit, [float(p) for p in percents])).alias("percent"), *columns))
    return wide.select(zipped.alias("r")).select(F.col("r.percent").alias("percent"), *(F.col(f"r.{c}").cast("long").alias(c) for c in columns))


def render(events: Column, metadata: tuple[str, ...] = ()) -> Column:
    """A conversation as text: for each event its author, its metadata fields, its text and a rule.

    With metadata (action, type, title) the first line is "author: A, ACTION TYPE: TITLE".
    """

    def first_line(e: Column) -> Column:
        author = F.concat(F.lit("author: "), F.coalesce(e["author"], F.lit("")))
        if not metadata:
            return author
        *left, title = (F.coalesce(e[f].cast("string"), F.lit("")) for f in metadata)
        return F.concat(author, F.lit(", "), F.concat_ws(" ", *left), F.lit(": "), title)

    return F.array_join(F.transform(events, lambda e: F.concat_ws("\n", first_line(e), e["text"], F.lit("-" * 75))), "\n")
