import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievewright.functions import evaluation
from sievewright.operators import clustering, mixture, stats


def test_percentiles_interpolate(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 4, 8)], "v double")
    assert {r["percent"]: r["v"] for r in stats.percentiles(df, "v", [0, 25, 50, 90]).collect()} == {p: pytest.approx(float(np.percentile([1, 2, 4, 8], p))) for p in (0, 25, 50, 90)}


def test_histogram_is_that_of_numpy(spark):
    xs = [0.0, 0.5, 1.0, 1.5, 9.99, 10.0, 10.1, -1.0]
    got = {r["bin"]: r["n"] for r in stats.histogram(spark.createDataFrame([(x,) for x in xs], "v double"), "v", 0.0, 10.0, 10).collect()}
    want, _ = np.histogram(xs, 10, (0, 10))
    assert got == {k: n for k, n in enumerate(want) if n}


def test_profile_rows_and_series_ratio(spark):
    kind = "profile map<string,array<struct<batch:int,lengths:array<struct<length:int,parts:array<struct<key:string,total:double>>>>>>>"
    df = spark.createDataFrame([({"a": [(8, [(64, [("x", 4.0)])])], "b": [(8, [(64, [("x", 2.0)])])]},)], kind)
    rows = stats.profile_rows(df)
    assert rows.columns == ["cls", "batch", "length", "key", "total"]
    part = lambda c: rows.where(F.col("cls") == c)
    assert stats.series_ratio(part("a"), part("b"), ["batch", "length", "key"], "total").first()["ratio"] == 2.0


def unimax_plain(sizes, epochs, budget):
    out = {}
    order = sorted(sizes, key=lambda k: (sizes[k], k))
    for i, k in enumerate(order):
        b, u = budget / (len(order) - i), sizes[k] / 4
        out[k] = min(epochs * u, b)
        budget -= out[k]
    return out, budget


@pytest.mark.parametrize("budget", [10.0, 500.0, 1e9])
def test_unimax_against_the_sequential_rule(spark, budget):
    sizes = {"a": 40.0, "b": 400.0, "c": 4000.0, "d": 400.0, "e": 0.0}
    want, left = unimax_plain(sizes, 2, budget)
    got = mixture.unimax(spark.createDataFrame(list(sizes.items()), "k string, size double"), "k", "size", 2.0, budget).collect()
    assert {r["k"]: r["tokens"] for r in got} == {k: pytest.approx(v) for k, v in want.items()}
    assert got[0]["leftover"] == pytest.approx(left, abs=1e-6)


@pytest.mark.parametrize("n, c, k", [(200, 3, 10), (10, 0, 1), (5, 5, 1), (5, 1, 5), (100, 99, 2)])
def test_pass_at_k(spark, n, c, k):
    got = spark.range(1).select(evaluation.pass_at_k(F.lit(n), F.lit(c), F.lit(k)).alias("v")).first()["v"]
    assert got == pytest.approx(1 - math.comb(n - c, k) / math.comb(n, k))


def test_scaling_law_optimum(spark):
    law = evaluation.ScalingLaw()
    df = evaluation.log_grid(spark, 1e20, 1e22, 3).select("c", law.optimal_n(F.col("c")).alias("n"), law.optimal_d(F.col("c")).alias("d"))
    both = df.select("c", "n", "d", law.loss(F.col("n"), F.col("d")).alias("best"), law.loss(F.col("n") * 1.1, F.col("d") / 1.1).alias("other"))
    for r in both.collect():
        assert 6 * r["n"] * r["d"] == pytest.approx(r["c"]) and r["best"] < r["other"]
    same = spark.createDataFrame([(1.0,)], "f double").select(law.data_factor(F.col("f")).alias("a"), law.compute_overhead(F.col("f")).alias("b")).first()
    assert same["a"] == pytest.approx(1) and same["b"] == pytest.approx(0, abs=1e-9)


def test_fit_recovers_a_law(spark):
    true = (6.0, 6.0, 0.5, 0.34, 0.28)
    seen = [(n, d, math.exp(0.5) + math.exp(6.0) / n**0.34 + math.exp(6.0) / d**0.28) for n in (1e7, 1e8, 1e9) for d in (1e9, 1e10, 1e11)]
    starts = spark.createDataFrame([(5.0, 5.0, 0.0, 0.3, 0.3), (0.0, 0.0, 0.0, 0.5, 0.5)], "a double, b double, e double, alpha double, beta double")
    objective = evaluation.scaling_objective(starts, spark.createDataFrame(seen, "n double, d double, loss double"))
    assert objective.count() == 2
    best = evaluation.refine_fit(starts, seen, steps=500).orderBy("objective").first()
    assert best["objective"] < 1e-6 and best["fit_alpha"] == pytest.approx(true[3], abs=0.05)


def test_huber_and_log_sum_exp(spark):
    row = spark.range(1).select(evaluation.huber(F.lit(0.5), 1.0).alias("a"), evaluation.huber(F.lit(-3.0), 1.0).alias("b"), evaluation.log_sum_exp(F.lit(1000.0), F.lit(1000.0)).alias("c")).first()
    assert (row["a"], row["b"], row["c"]) == (0.125, 2.5, pytest.approx(1000 + math.log(2)))


def test_clusters(spark):
    rng = np.random.default_rng(0)
    rows = [(i, (rng.normal(size=3) * 0.1 + 5 * (i % 2)).tolist(), i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, v array<double>, side int")
    pairs = {(r["side"], r["cluster"]) for r in clustering.kmeans(df, "v", 2).collect()}
    assert len(pairs) == 2 and len({c for _, c in pairs}) == 2
    best = max(clustering.silhouette_sweep(df, "v", range(2, 4)).collect(), key=lambda r: r["silhouette"])
    assert best["k"] == 2 and best["silhouette"] > 0.9
    scaled = np.array([r["scaled"] for r in clustering.standardize(df, "v").collect()])
    assert np.allclose(scaled.mean(0), 0) and np.allclose(scaled.std(0), 1)
    assert {len(r["xy"]) for r in clustering.project(df, "v").collect()} == {2}
