"""Mixing sources to target weights by iterative proportional fitting.

A cell is a combination of source, language and topic; its weight is its number of tokens (words
between white space). The weights are raked: scaled in turn until their sums by source, by language
and by topic agree with the target shares, and never above what the cell has. Raking ends when a
round changes no weight by more than TOLERANCE of it, or after `rounds`; marginals() says what was
reached. Every document is then drawn with its cell's probability, raked tokens over available
tokens, by a hash of its id, so a draw can be repeated.

One aggregation over the documents gives the cells. Cells are few; up to `driver_cells` of them are
raked on the driver, more by DataFrame aggregations. The two add up in different orders, so their
weights agree to some 1e-12 of them; probabilities are rounded to 6 places before anything is drawn,
which makes the draws equal but for a weight that lies within 1e-12 of a rounding edge. The
probabilities are broadcast only while they are few, else joined by shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievewright.llm import words as W
from sievewright.session import discard, materialize

NONE = "(none)"
AXES = ("source", "lang", "topic")
DRIVER_CELLS, BROADCAST_CELLS = 1_000_000, 50_000
ROUNDS, TOLERANCE = 40, 1e-12
#: Shares are proportional to tokens to this power: below 1, rare values gain weight.
FLATTEN = {"source": 0.5, "lang": 0.7, "topic": 0.7}
BUDGET = 0.5


def topic_of(text: Column) -> Column:
    """A text's topic by its form: licence notices, tables, contacts and credentials, else prose."""
    return (
        F.when(F.contains(text, F.lit("License")) | F.contains(text, F.lit("icensed under")), "licence")
        .when(F.contains(text, F.lit(" | ")), "table")
        .when(F.contains(text, F.lit("@")) | F.contains(text, F.lit(' = "')), "contact")
        .otherwise("prose")
    )


def token_count(text: Column) -> Column:
    """Words between ASCII white space; 0 for a null or blank text."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\x0B\f\r]+")), F.lit(0)).cast("long")


def rake(cells: pd.DataFrame, targets: dict[str, pd.Series], budget: float, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> np.ndarray:
    """The probability of each cell; cells has the axes and tokens, targets the shares by axis (of sum 1)."""
    have = cells["tokens"].to_numpy(float)
    total = budget * have.sum()
    w = have * budget
    axes = []
    for axis, share in targets.items():
        codes, values = pd.factorize(cells[axis])
        axes.append((codes, len(values), share.reindex(values).fillna(0.0).to_numpy(float) * total))
    for _ in range(rounds):
        before = w
        for codes, n, want in axes:
            now = np.bincount(codes, w, minlength=n)
            w = w * np.divide(want, now, out=np.zeros_like(want), where=now > 0)[codes]
        w = np.minimum(w, have)
        if (np.abs(w - before) <= tolerance * before).all():
            break
    return np.divide(w, have, out=np.zeros_like(w), where=have > 0)


def _rake_frames(cells: DataFrame, targets: dict[str, DataFrame], budget: float, rounds: int, tolerance: float = TOLERANCE) -> DataFrame:
    """rake() for cells that don't fit the driver."""
    total = budget * (cells.agg(F.sum("tokens")).first()[0] or 0)
    w = cells.withColumn("w", F.col("tokens") * F.lit(budget))
    last = None
    for _ in range(rounds):
        w = w.withColumn("before", F.col("w"))
        for axis, share in targets.items():
            # sums by the values of an axis are aggregated before they meet the cells, so a value that most cells have is no hot key
            now = w.groupBy(axis).agg(F.sum("w").alias("now")).join(share, axis, "left")
            w = w.join(now, axis).withColumn("w", F.when(F.col("now") > 0, F.col("w") * F.coalesce("share", F.lit(0.0)) * total / F.col("now")).otherwise(0.0)).drop("now", "share")
        w = materialize(w.withColumn("w", F.least("w", F.col("tokens").cast("double"))), "rake")
        moved = w.where(F.abs(F.col("w") - F.col("before")) > F.lit(tolerance) * F.col("before")).limit(1).count()
        if last is not None:
            discard(last)
        last, w = w, w.drop("before")
        if not moved:
            break
    return w.withColumn("probability", F.when(F.col("tokens") > 0, F.col("w") / F.col("tokens")).otherwise(0.0)).drop("w")


def _unit(key: Column, seed: str) -> Column:
    """A number in [0, 1) that depends on key and seed alone."""
    return F.conv(F.substring(F.md5(F.concat(key, F.lit(":" + seed))), 1, 12), 16, 10).cast("double") / float(1 << 48)


def _axes(docs: DataFrame, text_col: str, source_col: str, lang_col: str, topic: Callable[[Column], Column]) -> dict[str, Column]:
    named = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(NONE))
    return {"source": named(source_col), "lang": named(lang_col), "topic": F.coalesce(topic(F.coalesce(F.col(text_col), F.lit(""))), F.lit(NONE))}


def probabilities(
    docs: DataFrame,
    text_col: str = "text",
    source_col: str = "source",
    lang_col: str = "lang",
    topic: Callable[[Column], Column] = topic_of,
    targets: dict[str, dict[str, float]] | None = None,
    budget: float = BUDGET,
    rounds: int = ROUNDS,
    driver_cells: int = DRIVER_CELLS,
) -> tuple[DataFrame, int]:
    """((source, lang, topic, tokens, probability) of every cell, their number); the arguments are those of mix()."""
    names = _axes(docs, text_col, source_col, lang_col, topic)
    cells = docs.select(*(c.alias(a) for a, c in names.items()), token_count(F.col(text_col)).alias("tokens")).groupBy(*AXES).agg(F.sum("tokens").alias("tokens"))
    cells = materialize(cells, "cells")
    spark, n = docs.sparkSession, cells.count()
    if n <= driver_cells:
        table = cells.toPandas().sort_values(list(AXES), ignore_index=True)
        shares = {}
        for axis in AXES:
            own = table.groupby(axis)["tokens"].sum().astype(float)
            want = own ** FLATTEN[axis] if not (targets or {}).get(axis) else pd.Series(targets[axis], dtype=float).reindex(own.index).fillna(0.0)
            shares[axis] = want / want.sum() if want.sum() > 0 else want
        table["probability"] = rake(table, shares, budget, rounds)
        drawn = spark.createDataFrame(table[[*AXES, "tokens", "probability"]], "source string, lang string, topic string, tokens long, probability double")
    else:
        frames = {}
        for axis in AXES:
            own = cells.groupBy(axis).agg(F.sum("tokens").cast("double").alias("t"))
            if (targets or {}).get(axis):
                given = F.create_map(*[F.lit(x) for kv in targets[axis].items() for x in kv])
                want = F.coalesce(given[F.col(axis)].cast("double"), F.lit(0.0))
            else:
                want = F.pow("t", F.lit(FLATTEN[axis]))
            own = own.select(axis, want.alias("share"))
            all_of = own.agg(F.sum("share")).first()[0] or 1.0
            frames[axis] = materialize(own.withColumn("share", F.col("share") / F.lit(all_of)), "shares")
        drawn = _rake_frames(cells, frames, budget, rounds).select(*AXES, "tokens", "probability")
    return drawn.withColumn("probability", F.round("probability", 6)), n


def marginals(cells: DataFrame) -> DataFrame:
    """(axis, value, share_before, share_after): token shares of the corpus and, in expectation, of the draw; cells from probabilities()."""
    each = cells.select(F.explode(F.array(*(F.struct(F.lit(a).alias("axis"), F.col(a).alias("value")) for a in AXES))).alias("m"), "tokens", (F.col("tokens") * F.col("probability")).alias("drawn"))
    sums = each.groupBy("m.axis", "m.value").agg(F.sum("tokens").alias("t"), F.sum("drawn").alias("d"))
    whole = sums.groupBy("axis").agg(F.sum("t").alias("all_t"), F.sum("d").alias("all_d"))
    return sums.join(whole, "axis").select("axis", "value", F.try_divide("t", "all_t").alias("share_before"), F.try_divide("d", "all_d").alias("share_after"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    lang_col: str = "lang",
    topic: Callable[[Column], Column] = topic_of,
    targets: dict[str, dict[str, float]] | None = None,
    budget: float = BUDGET,
    rounds: int = ROUNDS,
    seed: str = "mix",
    driver_cells: int = DRIVER_CELLS,
) -> DataFrame:
    """The drawn documents with topic, n_tokens and probability added.

    budget is the share of the corpus's tokens to draw. targets has the shares by axis (source,
    lang, topic), as {value: weight}; weights are normalised over the values that occur, a value
    without one gets none, and an axis without targets gets shares proportional to tokens to the
    power FLATTEN. Where a cell hasn't the tokens that the targets want, all of it is drawn and
    the others of its row and column make up for it as far as they can. topic is an expression of
    the text, such as a classifier's; by default topic_of().

    A null source, language or topic is the value "(none)". A null or empty text has no tokens; it is
    drawn like the others of its cell, and with probability 0 if the whole cell is empty; very long
    texts are counted whole. A row without an id is drawn by its text. Repeated rows are drawn
    together. Columns of docs named topic, n_tokens or probability are replaced. An empty table gives
    an empty table.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    names = _axes(docs, text_col, source_col, lang_col, topic)
    drawn, n = probabilities(docs, text_col, source_col, lang_col, topic, targets, budget, rounds, driver_cells)
    axes = W.free_names(docs.columns, "__source", "__lang", "__topic")
    (p,) = W.free_names(docs.columns, "__p")
    drawn = drawn.select(*AXES, "probability").toDF(*axes, p)
    drawn = F.broadcast(drawn) if n <= BROADCAST_CELLS else drawn.hint("shuffle_hash")
    own = [c for c in docs.columns if c not in ("topic", "n_tokens", "probability")]
    rows = docs.withColumns(dict(zip(axes, (names[a] for a in AXES))))
    key = F.coalesce(F.col(id_col).cast("string"), F.md5(text))
    return (
        rows.join(drawn, axes)
        .where(_unit(key, seed) < F.col(p))
        .select(*(F.col(f"`{c}`") for c in own), F.col(axes[2]).alias("topic"), token_count(F.col(text_col)).alias("n_tokens"), F.col(p).alias("probability"))
    )
