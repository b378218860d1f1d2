"""An n-gram language model whose counts stay in tables: training and scoring are joins.

Interpolated discounting, either absolute (one discount, plain counts on every level) or modified
Kneser-Ney (three discounts for each level, and on the lower levels how many different pieces come
before). Nothing of the model is gathered on the driver or sent to every executor, so it may be as
large as the corpus it was counted on; only the discounts, a few numbers for each level, are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewright.operators.packed_ngrams import Packed
from sievewright.session import materialize

PIECE = r"(?U)\w+|[^\w\s]"
START, END = "<s>", "</s>"
DISCOUNT = 0.75


def pieces(text):
    """Words and single symbols of a text."""
    return F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))


def _bounded(text_col: str, cut) -> Column:
    """The pieces of a text between START and END."""
    return F.concat(F.array(F.lit(START)), cut(F.col(text_col)), F.array(F.lit(END)))


def _steps(docs: DataFrame, text_col: str, order: int, *keep: str, cut=pieces) -> DataFrame:
    """A row for each piece: the order - 1 pieces before it, joined by blanks, and the piece."""
    # shifted copies of the pieces side by side, nulls before the first; joining skips the nulls
    ahead = [F.lit(None).cast("string")] * max(order - 2, 0)
    toks = F.concat(F.array(*ahead, F.lit(START)), cut(F.col(text_col)), F.array(F.lit(END)))
    rows = docs.where(F.col(text_col).isNotNull()).select(*keep, toks.alias("__t"))
    steps = F.size("__t") - max(order - 1, 1)
    shifted = [F.slice("__t", F.lit(k + 1), steps).alias(f"w{k}") for k in range(max(order, 2))]
    out = rows.select(*keep, F.inline(F.arrays_zip(*shifted)))
    history = F.concat_ws(" ", *(f"w{k}" for k in range(order - 1))) if order > 1 else F.lit("")
    return out.select(*keep, history.alias("history"), F.col(f"w{max(order, 2) - 1}").alias("next"))


def _suffix(history, n: int):
    """The last n pieces of a history; null where it has fewer."""
    if n == 0:
        return F.lit("")
    blanks = F.length(history) - F.length(F.replace(history, F.lit(" "), F.lit("")))
    return F.when((history != "") & (blanks >= n - 1), F.substring_index(history, " ", -n))


def train(docs: DataFrame, text_col: str, order: int, cut=pieces) -> DataFrame:
    """(n, history, next, count): counts of every piece after every history of n < order pieces; cut gives the pieces of a text."""
    longest = _steps(docs, text_col, order, cut=cut).groupBy("history", "next").agg(F.count("*").alias("count"))
    longest = materialize(longest, "ngrams")
    # the highest level is counted already; each lower one is an aggregation of it
    out = longest.where(_suffix(F.col("history"), order - 1) == F.col("history")).select(F.lit(order - 1).alias("n"), "history", "next", "count")
    for n in range(order - 1):
        level = longest.select(_suffix(F.col("history"), n).alias("history"), "next", "count").where("history IS NOT NULL")
        out = out.unionAll(level.groupBy("history", "next").agg(F.sum("count").alias("count")).select(F.lit(n).alias("n"), "history", "next", "count"))
    return out


def train_kneser_ney(docs: DataFrame, text_col: str, order: int, cut=pieces) -> DataFrame:
    """train() with Kneser-Ney counts: below the highest level, how many different pieces precede history and piece.

    Histories that begin with the start of a text have nothing before them and keep their counts.
    """
    longest = _steps(docs, text_col, order, cut=cut).groupBy("history", "next").agg(F.count("*").alias("count"))
    longest = materialize(longest.withColumn("n", F.size(F.split("history", " "))), "ngrams")
    level = longest.where(F.col("n") == order - 1).select("n", "history", "next", "count")
    out = level
    for n in range(order - 2, -1, -1):
        before = level.groupBy(_suffix(F.col("history"), n).alias("history"), "next").agg(F.count("*").alias("count")).select(F.lit(n).alias("n"), "history", "next", "count")
        level = materialize(before.unionAll(longest.where(F.col("n") == n).select("n", "history", "next", "count")), "ngrams")
        out = out.unionAll(level)
    return out


def discounts(model: DataFrame, order: int) -> dict[int, tuple[float, float, float]]:
    """The discounts of counts 1, 2 and more for each level, from how many counts of 1 to 4 it has; DISCOUNT where these say nothing."""
    return _discounts({(r["n"], r["count"]): r["k"] for r in model.where("count <= 4").groupBy("n", "count").agg(F.count("*").alias("k")).collect()}, order)


def _discounts(found: dict[tuple[int, int], int], order: int) -> dict[int, tuple[float, float, float]]:
    """By how many counts of 1 to 4 each level has."""
    out = {}
    for n in range(order):
        t = [found.get((n, c), 0) for c in range(1, 5)]
        y = t[0] / (t[0] + 2 * t[1]) if t[0] + 2 * t[1] else 0.0
        each = [min(max(c - (c + 1) * y * t[c] / t[c - 1], 0.0), float(c)) if t[c - 1] else DISCOUNT for c in (1, 2, 3)]
        out[n] = (each[0], each[1], each[2])
    return out


def _taken(count: Column, d: tuple[float, float, float]) -> Column:
    return F.when(count == 1, d[0]).when(count == 2, d[1]).otherwise(d[2])


def _probabilities(asked: DataFrame, model: DataFrame, order: int, cuts: dict[int, tuple[float, float, float]]) -> DataFrame:
    """asked (history, next) with p. Unseen histories leave the estimate of the shorter one."""
    spare = lambda n: F.sum(_taken(F.col("count"), cuts[n])).alias("__spare")
    out = asked
    for n in range(order):
        level = model.where(F.col("n") == n)
        totals = [F.sum("count").alias("__total"), spare(n), F.count("*").alias("__kinds")]
        counts = level.select(F.col("history").alias("__h"), "next", F.col("count").alias("__c"))
        if n == 0:
            # one history, the empty one: its totals are a single row
            out = out.join(counts.drop("__h"), "next", "left").crossJoin(F.broadcast(level.agg(*totals))).withColumn("p", F.lit(1.0) / (F.col("__kinds") + 1))
        else:
            whole = level.groupBy(F.col("history").alias("__h")).agg(*totals)
            out = out.withColumn("__h", _suffix(F.col("history"), n)).join(counts, ["__h", "next"], "left").join(whole, "__h", "left")
        kept = F.when(F.col("__c").isNull(), F.lit(0.0)).otherwise(F.greatest(F.col("__c") - _taken(F.col("__c"), cuts[n]), F.lit(0.0)))
        seen = kept / F.col("__total") + F.col("__spare") / F.col("__total") * F.col("p")
        out = out.withColumn("p", F.when(F.col("__total").isNull(), F.col("p")).otherwise(seen)).select("history", "next", "p")
    return out


def perplexities(
    docs: DataFrame, model: DataFrame, id_col: str, text_col: str, order: int, cuts: dict[int, tuple[float, float, float]] | None = None, cut=pieces
) -> DataFrame:
    """(id_col, n_pieces, perplexity): 10 ** (-log10 score / pieces); null for a text without pieces, no row for a null one.

    cuts are the discounts() of a Kneser-Ney model; without them all are DISCOUNT. The model is written
    down once and the texts are cut once, however many levels there are.
    """
    cuts = cuts or dict.fromkeys(range(order), (DISCOUNT,) * 3)
    model = materialize(model, "model")
    steps = materialize(_steps(docs, text_col, order, id_col, cut=cut), "steps")
    p = _probabilities(steps.select("history", "next").distinct(), model, order, cuts)
    scored = steps.join(p, ["history", "next"]).groupBy(id_col).agg(F.sum(F.log10("p")).alias("score"), (F.count("*") - 1).alias("n_pieces"))
    return scored.select(id_col, "n_pieces", F.when(F.col("n_pieces") > 0, F.pow(F.lit(10.0), -F.col("score") / F.col("n_pieces"))).alias("perplexity"))


def own_model(docs: DataFrame, text_col: str, order: int, kneser_ney: bool = False, cut=pieces, per_bucket: int | None = None) -> DataFrame:
    """The rows of train() or train_kneser_ney(), from packed n-grams; order is 2 at least."""
    return Packed(docs, text_col, order, kneser_ney, _bounded(text_col, cut), None, per_bucket).rows()


def own_perplexities(docs: DataFrame, id_col: str, text_col: str, order: int, kneser_ney: bool = False, cut=pieces, per_bucket: int | None = None) -> DataFrame:
    """perplexities() of documents by the model of these documents themselves, from packed n-grams; order is 2 at least."""
    found = Packed(docs, text_col, order, kneser_ney, _bounded(text_col, cut), id_col, per_bucket)
    cuts = _discounts(found.small, order) if kneser_ney else dict.fromkeys(range(order), (DISCOUNT,) * 3)
    scored = found.scores(cuts).select(F.col("id").alias(id_col), "score", (F.col("n") - 1).alias("n_pieces"))
    return scored.select(id_col, "n_pieces", F.when(F.col("n_pieces") > 0, F.pow(F.lit(10.0), -F.col("score") / F.col("n_pieces"))).alias("perplexity"))
