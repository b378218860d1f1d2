"""pass@k, compute-optimal scaling and loss expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pass_at_k(n: Column, c: Column, k: Column) -> Column:
    """Unbiased chance that one of k draws out of n completions, c of them right, is right."""
    x = F.sequence(n - c + 1, F.greatest(n, n - c + 1))
    miss = F.aggregate(x, F.lit(1.0), lambda a, v: a * (1.0 - k / v))
    return F.when(n - c < k, F.lit(1.0)).when(c == 0, F.lit(0.0)).otherwise(1.0 - miss)


def pass_rates(results: DataFrame, keys: list[str], n_col: str, c_col: str, ks: list[int]) -> DataFrame:
    """Mean pass@k and its log10 by keys and k; every result row counts once for each k."""
    each = results.withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    rate = each.withColumn("rate", pass_at_k(F.col(n_col).cast("long"), F.col(c_col).cast("long"), F.col("k")))
    out = rate.groupBy(*keys, "k").agg(F.avg("rate").alias("pass_rate"))
    return out.withColumn("log_pass_rate", F.when(F.col("pass_rate") > 0, F.log10("pass_rate")))


class ScalingLaw:
    """loss = e + a / n**alpha + b / d**beta for n parameters and d tokens, with compute c = 6 n d."""

    def __init__(self, a: float = 406.4, b: float = 410.7, e: float = 1.62, alpha: float = 0.336, beta: float = 0.283):
        self.a, self.b, self.e, self.alpha, self.beta = a, b, e, alpha, beta
        self.opt_a, self.opt_b = beta / (alpha + beta), alpha / (alpha + beta)
        self.g = (alpha * a / (beta * b)) ** (1 / (alpha + beta))

    def loss(self, n: Column, d: Column) -> Column:
        return F.lit(self.e) + F.lit(self.a) / F.pow(n, F.lit(self.alpha)) + F.lit(self.b) / F.pow(d, F.lit(self.beta))

    def optimal_n(self, c: Column) -> Column:
        return F.lit(self.g) * F.pow(c / 6, F.lit(self.opt_a))

    def optimal_d(self, c: Column) -> Column:
        return F.pow(c / 6, F.lit(self.opt_b)) / F.lit(self.g)

    def frontier(self, c: Column) -> Column:
        """Least loss for a compute budget."""
        return self.loss(self.optimal_n(c), self.optimal_d(c))

    def data_factor(self, fraction: Column) -> Column:
        """Times the optimal tokens that a model of `fraction` of the optimal size needs for the same loss.

        Null where no amount of data makes up for the size.
        """
        share = self.a * self.g**-self.alpha / (self.b * self.g**self.beta)
        left = 1 + F.lit(share) - F.lit(share) * F.pow(fraction, F.lit(-self.alpha))
        return F.when(left > 0, F.pow(left, F.lit(-1 / self.beta)))

    def compute_overhead(self, fraction: Column) -> Column:
        """Extra compute, in percent, of data_factor()."""
        return (self.data_factor(fraction) * fraction - 1) * 100


def huber(x: Column, delta: float) -> Column:
    return F.when(F.abs(x) <= delta, 0.5 * x * x).otherwise(delta * (F.abs(x) - 0.5 * delta))


def log_sum_exp(*terms: Column) -> Column:
    top = F.greatest(*terms)
    total = F.exp(terms[0] - top)
    for t in terms[1:]:
        total = total + F.exp(t - top)
    return top + F.log(total)


def scaling_objective(grid: DataFrame, observations: DataFrame, delta: float = 1e-3) -> DataFrame:
    """Total Huber loss of log predictions for every grid row (a, b, e, alpha, beta; the first three as logs).

    observations has (n, d, loss). The grid is the large side; observations are few and go to it.
    """
    pairs = grid.crossJoin(observations)
    predicted = log_sum_exp(F.col("a") - F.col("alpha") * F.log("n"), F.col("b") - F.col("beta") * F.log("d"), F.col("e"))
    return pairs.groupBy("a", "b", "e", "alpha", "beta").agg(F.sum(huber(predicted - F.log("loss"), delta)).alias("objective"))


def refine_fit(starts: DataFrame, observations: list[tuple[float, float, float]], steps: int = 50, delta: float = 1e-3) -> DataFrame:
    """Quasi-Newton descent (L-BFGS with a backtracking search) from every start, in parallel; adds the fitted values and objective."""
    import numpy as np
    import pandas as pd

    x = np.array(observations, float)
    ln, ld, ll = np.log(x[:, 0]), np.log(x[:, 1]), np.log(x[:, 2])

    def value_and_slope(p):
        a, b, e, alpha, beta = p
        t = np.stack([a - alpha * ln, b - beta * ld, np.full(len(ln), e)])
        top = t.max(0)
        w = np.exp(t - top)
        r = top + np.log(w.sum(0)) - ll
        w /= w.sum(0)
        small = np.abs(r) <= delta
        f = np.where(small, 0.5 * r * r, delta * (np.abs(r) - 0.5 * delta)).sum()
        g = np.where(small, r, delta * np.sign(r))
        return f, np.array([(g * w[0]).sum(), (g * w[1]).sum(), (g * w[2]).sum(), -(g * w[0] * ln).sum(), -(g * w[1] * ld).sum()])

    def descend(p):
        f, g = value_and_slope(p)
        pairs: list = []
        for _ in range(steps):
            q, stack = g.copy(), []
            for s, y in reversed(pairs):
                k = s @ q / (y @ s)
                q -= k * y
                stack.append(k)
            if pairs:
                s, y = pairs[-1]
                q *= s @ y / (y @ y)
            for (s, y), k in zip(pairs, reversed(stack)):
                q += s * (k - y @ q / (y @ s))
            if q @ g <= 0:
                q = g
            t = 1.0
            while t > 1e-12:
                new = p - t * q
                fn, gn = value_and_slope(new)
                if fn <= f - 1e-4 * t * (q @ g):
                    break
                t /= 2
            else:
                break
            if (gn - g) @ (new - p) > 1e-18:
                pairs = [*pairs[-9:], (new - p, gn - g)]
            p, f, g = new, fn, gn
        return [*p, f]

    def run(frames):
        for pdf in frames:
            fitted = [descend(r) for r in pdf[["a", "b", "e", "alpha", "beta"]].to_numpy(float)]
            names = ["fit_a", "fit_b", "fit_e", "fit_alpha", "fit_beta", "objective"]
            yield pd.concat([pdf.reset_index(drop=True), pd.DataFrame(fitted, columns=names)], axis=1)

    extra = ", ".join(f"{c} double" for c in ("fit_a", "fit_b", "fit_e", "fit_alpha", "fit_beta", "objective"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in starts.schema)
    return starts.mapInPandas(run, f"{kinds}, {extra}")


def inverse_pass_law(loss: Column) -> Column:
    """A pass rate proportional to the inverse of the loss."""
    return 1.0 / loss


def grid2d(spark, xs: tuple[float, float, int], ys: tuple[float, float, int]) -> DataFrame:
    """All (x, y) of two evenly spaced axes, each (from, to, points)."""
    axis = lambda name, a, b, n: spark.range(n).select((F.lit(a) + F.col("id") * F.lit((b - a) / max(1, n - 1))).alias(name))
    return axis("x", *xs).crossJoin(axis("y", *ys))


def log_grid(spark, lo: float, hi: float, points: int) -> DataFrame:
    step = (math.log10(hi) - math.log10(lo)) / max(1, points - 1)
    return spark.range(points).select(F.pow(F.lit(10.0), F.lit(math.log10(lo)) + F.col("id") * F.lit(step)).alias("c"))
