import pytest
from pyspark.sql import functions as F

from sievewright.functions.text import jaccard, lines, raw_tokens, sha1_hash32, shingles, strip, token_set
from sievewright.operators import projection, quality


def values(spark, texts, column):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", column(F.col("t")).alias("v"))
    return [r["v"] for r in df.orderBy("k").collect()]


TEXTS = ["", "a", "a\n", "\n", "a\r\nb\rc\x0bd\x0ce\x1cf\x85g h ", "x\n\ny", "é ü\tz"]


def test_lines_are_those_of_python(spark):
    assert values(spark, TEXTS, lines) == [t.splitlines() for t in TEXTS]


def test_strip_is_that_of_python(spark):
    texts = ["", "  a b \n", " x ", "none", "\t\r\n"]
    assert values(spark, texts, strip) == [t.strip() for t in texts]


def test_shingles_keep_empty_pieces(spark):
    assert values(spark, ["a b  c", "a b", ""], lambda t: shingles(raw_tokens(t), 3)) == [["a b ", "b  c"], [], []]


def test_token_sets_and_similarity(spark):
    assert values(spark, ["a = 1", "x_1-x_1!", ""], token_set) == [["a", "1"], ["x_1"], []]
    df = spark.createDataFrame([(["a", "1"], ["a", "2"]), (["a"], ["a"]), ([], [])], "a array<string>, b array<string>")
    assert [r[0] for r in df.select(jaccard(F.col("a"), F.col("b"))).collect()] == [pytest.approx(1 / 3), 1.0, 0.0]


def test_hash(spark):
    assert values(spark, ["abc"], sha1_hash32) == [910072233]


def test_config_or_test(spark):
    texts = ["a\n# Unit Tests\nb\nc\nd", "x\none test\n", "", "plain text\nof two lines", "\n" * 40 + "test test", "\n" * 40 + "test test test", "1\n2\n3\n4\n5\nunit tests" + "\n" * 60]
    assert values(spark, texts, quality.is_config_or_test) == [True, True, False, False, False, True, False]


def test_other_rules(spark):
    assert values(spark, ["# Auto-Generated by x", "1\n2\n3\n4\n5\nautogenerated"], quality.is_autogenerated) == [True, False]
    assert values(spark, ["====", "=====", ""], quality.has_few_assignments) == [True, False, True]
    assert values(spark, ["DEF x", "define", "for"], quality.has_no_code_words) == [False, True, True]
    assert values(spark, ["a" * 1001, "a" * 101, "a" * 100, "....a", ""], quality.has_odd_lines) == [True, True, False, True, False]
    assert values(spark, ['<?xml version="1.0"?>', "12345", "abc def", ""], quality.content_class) == ["xml", "data", "unknown", "data"]


def test_math_expressions(spark):
    texts = [r"as $$u_1 \le v$$, hence \[v=2u\] follows", "Test $$$$", r"\(1\) \(a\)", "$$a\nb$$", "$$a\rb$$"]
    assert values(spark, texts, quality.math_expressions) == [2, 0, 1, 0, 1]


def test_null_texts_give_null_or_are_kept(spark):
    df = spark.createDataFrame([(1, None), (2, "one test")], "k int, t string")
    kept, removed = quality.split_by(df, quality.is_config_or_test(F.col("t")))
    assert [r["k"] for r in kept.collect()] == [1] and [r["k"] for r in removed.collect()] == [2]
    empty = quality.removal_report(df.limit(0), F.lit(True), "t").first()
    assert empty["rows_before"] == 0 and empty["volume_removed_pct"] is None


def test_projections(spark):
    df = spark.createDataFrame([("é", None, (1, ("x",)))], "t string, stars int, s struct<a:int,b:struct<c:string>>")
    row = projection.null_to_zero(projection.add_length(projection.add_size(df, "t"), "t"), "stars").first()
    assert (row["size"], row["nl_size"], row["stars"]) == (2, 1, 0)
    assert projection.expand_struct(df, "s").columns == ["t", "stars", "a", "b.c"]
    assert projection.select_columns(df, lambda c: not c.startswith("s")).columns == ["t"]
    assert projection.recode(df, "t", {"é": "e"}).first()["t"] == "e" and projection.recode(df, "t", {}) is df
    names = spark.createDataFrame([("run-idx_17-x",)], "n string")
    assert names.select(projection.key_after(F.col("n"), "idx_", "-").alias("k")).first()["k"] == "17"
    assert projection.label_columns(spark.createDataFrame([(1e20,)], "c double"), c="%e").first()["c_label"] == "1.000000e+20"


def test_seeded_order_is_a_permutation(spark):
    df = spark.range(50)
    a, b = ([r["id"] for r in projection.hash_shuffle(df, "id", seed).collect()] for seed in (1, 2))
    assert sorted(a) == sorted(b) == list(range(50)) and a != b
    assert [r["id"] for r in projection.hash_shuffle(df, "id", 1, 5).collect()] == a[:5]
    assert [r["id"] for r in projection.first_rows(df, "id", 3).collect()] == [0, 1, 2]
