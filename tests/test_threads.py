import pytest
from pyspark.sql import functions as F

from sievewright.operators import threads


def test_merge_text(spark):
    df = spark.createDataFrame([(1, [("a", None, "d"), ("b", "", None), ("c", "c", "d")])], "id int, events array<struct<author:string,comment:string,description:string>>")
    events = threads.merge_text(df).first()["events"]
    assert [e.asDict() for e in events] == [{"author": "a", "text": "d"}, {"author": "b", "text": ""}, {"author": "c", "text": "c"}]


@pytest.mark.parametrize("name, bot", [("dependabot[bot]", True), ("SparkQA", True), ("my-ci", True), ("robot", True), ("sparkqa", False), ("X-Service-Account", False), ("alice", False), (None, False)])
def test_bots(spark, name, bot):
    assert spark.createDataFrame([(name,)], "n string").select(threads.is_bot(F.col("n")).alias("b")).first()["b"] is bot


def test_user_filter(spark):
    rows = [(2, 1, 99), (1, 199, 1), (1, 200, 10), (1, 7000, 10), (1, 7001, 1), (1, 300, 11)]
    df = spark.createDataFrame(rows, "user_count int, text_size_no_bots int, event_count int")
    kept = {tuple(r) for r in df.where(threads.by_users(200, 7000)).collect()}
    assert kept == {rows[0], rows[2], rows[3]}


def test_bot_removal_and_report(spark):
    df = spark.createDataFrame([(1, 0, "x[bot]", "a"), (1, 1, "ann", "bb"), (2, 0, "codecov-io", "c"), (3, 0, "bob", None)], "id int, turn int, who string, text string")
    rows = threads.add_counts(threads.collect_threads(df, "id", "turn", "who", "text"))
    clean = threads.add_counts(threads.remove_bots(rows), suffix="_no_bots", users=False)
    got = {r["id"]: (r["event_count"], r["event_count_no_bots"], r["bot_issue"], r["modified_by_bot"], r["text_size_no_bots"]) for r in clean.collect()}
    assert got == {1: (2, 1, False, True, 2), 2: (1, 0, True, True, 0), 3: (1, 1, False, False, 0)}
    report = threads.bot_report(clean).first()
    assert [round(x, 4) for x in report] == [66.6667, 33.3333, 50.0]


CASES = [
    ("hi\nFrom: x\nReply to this email directly, view it on GitHub foo\ntail", "hi"),
    ("hi\nOn Monday a <notifications@github.com> wrote:\n> old\nReply to this email directly or view it on GitHub.\ntail", "hi"),
    ("fix\nSigned-off-by: A <a@b.c>\nrest", "fix\nrest"),
    ("answer\n> quoted\n> more\nafter", "after"),
    ("  plain  ", "plain"),
    ("a" + "_" * 25 + "b", "ab"),
    (None, ""),
]


@pytest.mark.parametrize("text, want", CASES)
def test_mail_text(text, want):
    assert threads.strip_mail_text(text) == want


def test_mail_in_threads_is_the_same(spark):
    df = spark.createDataFrame([(k, 0, "a", t) for k, (t, _) in enumerate(CASES)], "id int, turn int, who string, text string")
    out = threads.strip_mail(threads.collect_threads(df, "id", "turn", "who", "text"))
    assert {r["id"]: r["events"][0]["text"] for r in out.collect()} == {k: w for k, (_, w) in enumerate(CASES)}
