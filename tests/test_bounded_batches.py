"""Results that leave a Python task in parts, and joins that read a text once."""

import inspect

import numpy as np
from pyspark.sql import functions as F

from sievewright.operators import decontaminate, extract, minhash, subwords
from sievewright.plans import dedup_plans
from sievewright.plans.model_plans import VOCABULARY


def test_signatures_of_many_sets_at_once():
    a, b = minhash.permutations(16)
    rng = np.random.default_rng(3)
    sets = [rng.integers(0, 1 << 32, n, np.uint64) for n in (0, 3, 700, 0, 1, 128, 5, 0)]
    want = [[min(((int(h) * int(x) + int(y)) % 2**64 % (2**61 - 1) & 0xFFFFFFFF for h in s), default=2**32 - 1) for x, y in zip(a, b)] for s in sets]
    assert minhash.least_values(sets, a, b).tolist() == want
    assert minhash.least_values([], a, b).shape == (0, 16)


def test_signatures_leave_in_parts(spark):
    n = 2 * minhash.SIGNED + 7
    df = spark.range(n).select(F.concat(F.lit("i"), "id").alias("id"), F.concat(F.lit("a b c "), F.col("id") % 5).alias("text")).coalesce(1)
    rows = minhash.signatures(df, "id", "text", 8, 1).collect()
    assert {r["id"] for r in rows} == {f"i{k}" for k in range(n)} and len({tuple(r["signature"]) for r in rows}) <= 5
    sizes = minhash.signatures(df, "id", "text", 8, 1, min_tokens=5).count()
    assert sizes == 0


def test_lexers_take_texts_one_by_one(spark):
    df = spark.createDataFrame([("# a\nx = 1\n", "python"), (None, "python"), ("// b\n", "java"), ("// b\n", "none"), ("", "java"), ("# c", None)], "s string, l string").coalesce(1)
    assert [r[0] for r in df.select(extract.comment_size(F.col("s"), F.col("l"))).collect()] == [3, None, 4, None, 0, None]
    assert "pandas_udf" not in inspect.getsource(extract.comment_size)


def test_pieces_leave_in_parts(spark):
    long = "word, " * (subwords.AT_ONCE // 2 + 10)
    df = spark.createDataFrame([(0, "a b"), (1, None), (2, long), (3, ""), (4, None), (5, "c d")], "id int, t string").coalesce(1)
    rows = {r["id"]: r for r in df.select("id", subwords.bpe_pieces(F.col("t"), VOCABULARY).alias("p")).select("id", F.size("p").alias("n"), F.slice("p", F.lit(1), F.lit(2)).alias("p")).collect()}
    encoder, names = subwords._load(VOCABULARY)
    assert rows[1]["p"] is None and rows[4]["p"] is None and rows[3]["p"] == [] and rows[3]["n"] == 0
    for k, t in ((0, "a b"), (2, long), (5, "c d")):
        found = [names[x] for x in encoder.encode_ordinary(t)]
        assert rows[k]["n"] == len(found) and rows[k]["p"] == found[:2]


def test_contains_join_is_no_nested_loop(spark):
    docs = spark.createDataFrame([(1, "Xabcx"), (2, None), (3, "AB ab É"), (4, "")], "id int, text string")
    items = spark.createDataFrame([(7, "aB"), (8, "ab"), (9, ""), (10, None), (11, "é"), (12, "zz")], "item int, pattern string")
    out = decontaminate.contains_join(docs, items, "text", "pattern")
    assert out.columns == ["id", "text", "item", "pattern"]
    assert sorted((r["id"], r["item"]) for r in out.collect()) == [(1, 7), (1, 8), (3, 7), (3, 8), (3, 11)]
    assert decontaminate.contains_join(docs, items.where("item = 9"), "text", "pattern").collect() == []
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()


def test_neighbours_send_texts(spark):
    plan = dedup_plans.jaccard_neighbours(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Join") :]
    assert "array_distinct" not in below


def test_bands_that_no_item_has_are_left_out(spark):
    docs = spark.createDataFrame([(k, f"a{k % 7} b c d{k % 3}") for k in range(60)], "id long, text string")
    items = spark.createDataFrame([(0, "a1 b c d2"), (1, "none of these")], "id long, text string")
    signed, known = (minhash.signatures(df, "id", "text", 24, 1) for df in (docs, items))
    rows = lambda df: sorted(map(tuple, df.collect()))
    every, few = minhash.bands(signed, 8, 3), minhash.bands(signed, 8, 3, known)
    wanted = minhash.bands(known, 8, 3).select("band", "key").distinct()
    assert rows(few) == rows(every.join(wanted, ["band", "key"], "left_semi").select("id", "band", "key")) and few.count() < every.count()
    assert rows(minhash.bands(signed, 8, 3, known, broadcast_rows=1)) == rows(every)
