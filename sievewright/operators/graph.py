"""Connected components over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.session import discard, materialize


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 100) -> DataFrame:
    """Label every vertex that an edge touches with the least vertex of its component.

    Alternating large-star and small-star contractions (Kiveris et al., 2014): the number of
    rounds is logarithmic in the component size, work per round is linear in the edges, and
    a vertex's neighbourhood is only ever reduced to its minimum, never collected. Each
    round's edges are written to the shared folder, so that a lost executor costs a stage and
    not the whole history, and the round before is deleted.

    Returns (id, component). Self loops give a component of one; null ends are ignored; an
    empty table gives an empty table.
    """
    e = (
        edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"))
        .where(F.col(src).isNotNull() & F.col(dst).isNotNull())
        .distinct()
    )
    e = materialize(e, "cc")
    loops = e.where("u = v").select(F.col("u").alias("id"))
    e, last = e.where("u <> v"), None
    before = None
    for _ in range(max_rounds):
        # large-star: every greater neighbour of a vertex is tied to the vertex's least neighbour
        both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("n")).select("u", F.least("u", "n").alias("m"))
        large = (
            both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        )
        # small-star: every lesser neighbour, and the vertex itself, is tied to the least one
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = large.join(low, "u")
        small = (
            tied.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionAll(low.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct()
        )
        e = materialize(small, "cc")
        if last is not None:
            discard(last)
        last = e
        # stable once the edge set repeats: an order-free digest of it is compared
        now = e.agg(
            F.count("*").alias("n"),
            F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"),
        ).first()
        if before == now:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    labelled = e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    roots = e.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    alone = loops.join(labelled.unionAll(roots).select("id"), "id", "left_anti").select("id", F.col("id").alias("component"))
    return labelled.unionAll(roots).unionAll(alone.distinct())
