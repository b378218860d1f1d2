"""Near-duplicate documents by 128-bit SimHash.

A document's features are all its distinct folded words. Every feature votes on 128 bits.

Search: the 128 bits are dealt to parts, each with a radius, such that two fingerprints at most
max_distance apart differ in at most `radius` bits of some part (the sum of radius + 1 is
max_distance + 1). A part of radius r has 2**(r + 1) - 1 tables, each with a mask of some half of its
bits, and whichever r of them differ, one mask has none of these (see covering()). So in one table at
least the two share the cell of the masked bits: no pair within the distance is left out, at any
corpus size. Within a cell every pair is first held to the distance of the first half of the bits,
then to the Manhattan bound, and what is left to the exact Hamming distance. The bound: a fingerprint
is embedded as the bit counts (0 to 2) of its 64 two-bit segments. The Manhattan distance of two
embeddings is at most the Hamming distance of the fingerprints. Written in unary (0 as 00, 1 as 01, 2
as 11) the embedding is 128 bits again, and its Manhattan distance two popcounts.

Fewer parts have more tables of smaller cells; grid_plan takes the number with the least work. For 20
bits that is 44 tables at 236 thousand fingerprints, 156 at 14 million, 381 at 10**9 and 3,070 at
5 * 10**10.

Equal fingerprints are one class before the search, so exact copies cost one row. A pair that shares
several cells counts in one of them, the one of the first table. A cell with many pairs emits a
spanning forest and the number of links of each row, not the pairs. Cells of more than HOT rows are
cut into blocks, and every pair of blocks is a group of its own, so no task holds a whole hot cell
and none is cut off.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.llm import keys as K
from sievewright.llm import words as W
from sievewright.operators.graph import connected_components
from sievewright.session import materialize

BITS, SEGMENTS = 128, 64
MAX_DISTANCE = 20
RECALL = 1.0  # the grid leaves no pair out
STRANGERS = 1000.0  # a row of a table costs as much as comparing it with so many others
HOT = 8192
SCAN = 1 << 16  # pairs looked at in one go: their differences stay in cache
_ODD = np.uint64(0x5555555555555555)
_LOW = np.uint64((1 << 48) - 1)
_ONE = np.uint64(1)


def fingerprint_block(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(f0, f1, number of features) for every text of a block."""
    h, _, _, bound = W.words(data, offs, W.ALNUM, True)
    n = len(offs) - 1
    doc = np.repeat(np.arange(n), np.diff(bound))
    key = (doc.astype(np.uint64) << np.uint64(48)) | (h >> np.uint64(16))
    key.sort()
    if len(key):
        key = key[np.append(True, key[1:] != key[:-1])]
    of = (key >> np.uint64(48)).astype(np.int64)
    feature = key & _LOW
    pair = np.stack([W.mix(feature), W.mix(feature ^ _ODD)], 1)
    counts = np.bincount(of, minlength=n)
    cut = np.concatenate([[0], np.cumsum(counts)])
    votes = np.zeros((n, BITS), np.int64)
    for i in range(n):
        for a in range(cut[i], cut[i + 1], 1 << 16):
            bits = np.unpackbits(pair[a : min(a + (1 << 16), cut[i + 1])].view(np.uint8), axis=1)
            votes[i] += bits.sum(0, dtype=np.uint32)
    on = np.packbits(votes * 2 > counts[:, None], axis=1).view(np.uint64)
    return on[:, 0].copy(), on[:, 1].copy(), counts


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, data, offs in W.blocks(batch, "text"):
            f0, f1, n = fingerprint_block(data, offs)
            some = n > 0
            yield pa.RecordBatch.from_arrays(
                [rows.column(0).filter(pa.array(some)), pa.array(f0[some].view(np.int64)), pa.array(f1[some].view(np.int64))], names=["id", "f0", "f1"]
            )


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, f0, f1) of the documents that have an id and at least one word; the id is keys.key_of()."""
    rows = docs.select(K.key_of(docs, id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text")).where("id is not null")
    return rows.mapInArrow(_fingerprints, "id long, f0 long, f1 long")


@lru_cache
def covering(radius: int, bits: int) -> np.ndarray:
    """Masks (rows) over a part's bits, such that for any `radius` of the bits some mask has none of them.

    Bits and masks are vectors of radius + 1 dimensions over GF(2), masks all but zero; a mask has the
    bits that aren't orthogonal to it, and some vector is orthogonal to any `radius` others. Each bit
    takes the vector that leaves the least rows in the cells.
    """
    v = np.arange(1, 2 << radius)
    odd = (np.bitwise_count(v[:, None] & v) & 1).astype(bool)
    rows, taken = np.ones(len(v)), []
    for _ in range(bits):
        taken.append(int(np.argmax(rows @ odd)))
        rows[odd[:, taken[-1]]] /= 2
    return odd[:, taken]


def part_sizes(radii: tuple[int, ...]) -> list[int]:
    """The bits of each part, shared out such that the cells of all tables are alike."""
    share = np.cumsum([2 - 0.5**r for r in radii])
    return np.diff(np.rint(BITS * share / share[-1]).astype(int), prepend=0).tolist()


def shared_cell(distance: int, radii: tuple[int, ...], tables: int) -> float:
    """The least probability, over any two fingerprints `distance` apart, that they share a cell: beyond the distance of the plan nothing is promised."""
    return float(distance < sum(r + 1 for r in radii))


def grid_plan(n: int, distance: int, recall: float = RECALL, strangers: float = STRANGERS) -> tuple[tuple[int, ...], int]:
    """(radius of each part, tables) for n fingerprints, so that any pair at most `distance` bits apart shares a cell, whatever recall asks for."""
    best, least = None, np.inf
    for parts in range(min(distance + 1, BITS), 0, -1):
        radius, more = divmod(distance + 1, parts)
        radii = (radius,) * more + (radius - 1,) * (parts - more)
        tables = sum((2 << r) - 1 for r in radii)
        if tables * strangers >= least:
            break
        alike = sum((0.5 ** covering(r, b).sum(1)).sum() for r, b in zip(radii, part_sizes(radii)))
        if tables * strangers + n * alike < least:
            best, least = (radii, tables), tables * strangers + n * alike
    return best


def embed(f: np.ndarray) -> np.ndarray:
    """The bit counts of the 32 segments of one half of the fingerprints, in unary: their Manhattan distance is the popcount of a difference."""
    x, y = f & _ODD, (f >> _ONE) & _ODD
    return (x | y) | ((x & y) << _ONE)


class Grid:
    """The tables: for each the mask of its bits in both halves of the fingerprint."""

    def __init__(self, radii: tuple[int, ...], tables: int, seed: int):
        order = np.split(np.random.default_rng(seed).permutation(BITS), np.cumsum(part_sizes(radii))[:-1])
        on = np.zeros((tables, BITS), np.uint8)
        t = 0
        for radius, bits in zip(radii, order):
            masks = covering(radius, len(bits))
            on[t : t + len(masks), bits] = masks
            t += len(masks)
        masks = np.packbits(on, axis=1).view(np.uint64)
        self.m0, self.m1 = masks[:, 0].copy(), masks[:, 1].copy()

    def cell(self, f0: np.ndarray, f1: np.ndarray, t) -> np.ndarray:
        """The cells of fingerprints in table t (or in a table for each)."""
        return W.mix(W.mix((f0 & self.m0[t]) + np.asarray(t, np.uint64) * np.uint64(0x9E3779B97F4A7C15)) + (f1 & self.m1[t]))

    def first(self, x0: np.ndarray, x1: np.ndarray) -> np.ndarray:
        """The first table in which pairs whose fingerprints differ by x0, x1 share a cell; -1 for none."""
        out, left = np.full(len(x0), -1), np.arange(len(x0))
        for t in range(len(self.m0)):
            if not left.size:
                break
            hit = ((x0[left] & self.m0[t]) | (x1[left] & self.m1[t])) == 0
            out[left[hit]] = t
            left = left[~hit]
        return out


def _cells(grid: Grid):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = len(grid.m0)
        for batch in batches:
            step = max(1, (1 << 16) // tables)
            for i in range(0, batch.num_rows, step):
                part = batch.slice(i, step)
                f0, f1 = (part.column(c).to_numpy() for c in (0, 1))
                cells = np.concatenate([grid.cell(f0.view(np.uint64), f1.view(np.uint64), t) for t in range(tables)]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(np.tile(f0, tables)), pa.array(np.tile(f1, tables))], names=["cell", "f0", "f1"])

    return run


def forest(f0: np.ndarray, f1: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the graph that joins fingerprints at most `limit` apart."""
    free, a, b = np.arange(len(f0)), [], []
    while free.size > 1:
        queue, free = [free[0]], free[1:]
        while queue and free.size:
            k = queue.pop()
            ok = np.bitwise_count(f0[free] ^ f0[k]) + np.bitwise_count(f1[free] ^ f1[k]) <= limit
            if ok.any():
                near = free[ok]
                a.append(np.full(len(near), k))
                b.append(near)
                queue += near.tolist()
                free = free[~ok]
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64), np.zeros(0, np.int64))


_FOUND = "kind byte, a0 long, a1 long, b0 long, b1 long"
EDGE, LINKS, REST = 0, 1, 2


def _batch(kind: int, a0, a1, b0, b1) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(a0), kind, np.int8)), *(pa.array(np.ascontiguousarray(x).view(np.int64)) for x in (a0, a1, b0, b1))], names=["kind", "a0", "a1", "b0", "b1"]
    )


class Verifier:
    """Links within the groups of a sorted slice: pairs at most limit apart that count in this cell."""

    def __init__(self, grid: Grid, limit: int):
        self.grid, self.limit = grid, limit

    def _near(self, a, b, f0, f1, t0, t1):
        """Of candidate pairs (places a, b) those within the limit: the bound, then the distance."""
        ok = np.bitwise_count(t0[a] ^ t0[b]) + np.bitwise_count(t1[a] ^ t1[b]) <= self.limit
        a, b = a[ok], b[ok]
        ok = np.bitwise_count(f0[a] ^ f0[b]) + np.bitwise_count(f1[a] ^ f1[b]) <= self.limit
        return a[ok], b[ok]

    def _counted(self, a, b, f0, f1, cell):
        """Of near pairs those whose first cell is this one."""
        t = self.grid.first(f0[a] ^ f0[b], f1[a] ^ f1[b])
        ok = (t >= 0) & (self.grid.cell(f0[a], f1[a], np.maximum(t, 0)) == cell[a])
        return a[ok], b[ok]

    def links(self, cell, f0, f1, start: np.ndarray, side: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        """start has the bounds of the groups; with `side` only rows of different sides are paired."""
        cell, f0, f1 = (x.view(np.uint64) for x in (cell, f0, f1))
        t0, t1 = embed(f0), embed(f1)
        n, size = len(f0), np.diff(start)
        degree = np.zeros(n, np.int64)
        near: list[tuple[np.ndarray, np.ndarray]] = []
        edges: list[tuple[np.ndarray, np.ndarray]] = []
        of = np.repeat(np.where((size <= 64) & (side is None), start[:-1], -1), size)
        for k in range(1, int(size[size <= 64].max(initial=1)) if side is None else 0):
            a = np.flatnonzero((of[k:] == of[:-k]) & (of[k:] >= 0))
            if not a.size:
                break
            a = a[np.bitwise_count(f0[a] ^ f0[a + k]) <= self.limit]
            near.append(self._near(a, a + k, f0, f1, t0, t1))
        for g in range(len(size)) if side is not None else np.flatnonzero(size > 64):
            i, j = int(start[g]), int(start[g + 1])
            found, kept, held, many, lo = [], [], 0, 0, i
            while lo < j:
                hi = min(lo + max(8, SCAN // (j - lo)), j)
                close = np.bitwise_count(f0[lo:hi, None] ^ f0[None, lo:j]) <= self.limit
                if side is not None:
                    close &= side[lo:hi, None] != side[None, lo:j]
                a, b = np.divmod(np.flatnonzero(close), j - lo)
                later = a < b
                found.append(self._near(a[later] + lo, b[later] + lo, f0, f1, t0, t1))
                held += len(found[-1][0])
                if held > 4 * (j - i):
                    a, b = self._counted(*(np.concatenate(x) for x in zip(*found)), f0, f1, cell)
                    degree += np.bincount(a, minlength=n) + np.bincount(b, minlength=n)
                    many += len(a)
                    if many <= 4 * (j - i):
                        kept.append((a, b))
                    found, held = [], 0
                lo = hi
            near += found
            if many > 4 * (j - i):
                # dense: the links are counted, the edges thinned to a forest of all of the group
                a, b = forest(f0[i:j], f1[i:j], self.limit)
                yield _batch(EDGE, f0[i + a], f1[i + a], f0[i + b], f1[i + b])
            else:
                edges += kept
        if near:
            a, b = self._counted(*(np.concatenate(x) for x in zip(*near)), f0, f1, cell)
            degree += np.bincount(a, minlength=n) + np.bincount(b, minlength=n)
            edges.append((a, b))
        if edges:
            a, b = (np.concatenate(x) for x in zip(*edges))
            yield _batch(EDGE, f0[a], f1[a], f0[b], f1[b])
        some = np.flatnonzero(degree)
        yield _batch(LINKS, f0[some], f1[some], degree[some], np.zeros(len(some), np.int64))

    def cells(self, hot: int):
        """Rows come by cell: the links of each cell of at most `hot` rows, and the rows of the others as REST with their number in the cell."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[list[np.ndarray]] = []  # of the cell that isn't complete yet
            passed = 0  # rows of it that have gone on already, once it is hot

            def take(cols):
                nonlocal passed
                held.append(cols)
                if passed or sum(len(c[0]) for c in held) > hot:
                    for c in held:
                        yield _batch(REST, c[1], c[2], c[0], np.arange(passed, passed + len(c[0])))
                        passed += len(c[0])
                    held.clear()

            def close():
                nonlocal passed
                passed = 0
                if held:
                    cols = [np.concatenate(x) for x in zip(*held)]
                    held.clear()
                    yield from self.links(*cols, np.array([0, len(cols[0])]))

            now = None
            for batch in batches:
                cols = [c.to_numpy() for c in batch.columns]
                start = W.runs(cols[0])
                if batch.num_rows == 0:
                    continue
                first = 0
                if now == cols[0][0]:
                    yield from take([c[: start[1]] for c in cols])
                    first = 1
                    if len(start) == 2:
                        continue
                yield from close()
                last = len(start) - 2
                if last > first:
                    size = np.diff(start[first : last + 1])
                    for g in np.flatnonzero(size > hot):
                        yield from take([c[start[first + g] : start[first + g + 1]] for c in cols])
                        passed = 0
                    keep = np.repeat(size <= hot, size)
                    part = [c[start[first] : start[last]][keep] for c in cols]
                    if len(part[0]):
                        yield from self.links(*part, W.runs(part[0]))
                now = cols[0][-1]
                yield from take([c[start[last] :] for c in cols])
            yield from close()

        return run

    def blocks(self):
        """Rows come by (cell, low, high): blocks `low` and `high` of a hot cell; the links between them, or within one."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[list[np.ndarray]] = []

            def close():
                cell, low, high, block, f0, f1 = (np.concatenate(x) for x in zip(*held))
                held.clear()
                yield from self.links(cell, f0, f1, np.array([0, len(cell)]), None if low[0] == high[0] else block)

            for batch in batches:
                cols = [c.to_numpy() for c in batch.columns]
                n = batch.num_rows
                new = np.ones(n, bool)
                for c in cols[:3]:
                    if c is cols[0]:
                        new[1:] = False
                    new[1:] |= c[1:] != c[:-1]
                if n and held and all(h[0] == c[0] for h, c in zip(held[-1][:3], cols[:3])):
                    new[0] = False
                cut = np.append(np.flatnonzero(new), n)
                if n and (not len(cut) or cut[0] > 0):
                    held.append([c[: cut[0]] for c in cols])
                for i, j in zip(cut[:-1], cut[1:]):
                    if held:
                        yield from close()
                    held.append([c[i:j] for c in cols])
            if held:
                yield from close()

        return run


def links(classes: DataFrame, n: int, max_distance: int = MAX_DISTANCE, recall: float = RECALL, seed: int = 11, strangers: float = STRANGERS, hot: int = HOT) -> DataFrame:
    """Table of kinds EDGE (a, b: fingerprints within max_distance, enough of them to join all) and LINKS (a, b0: links of a, in parts).

    classes has the n distinct fingerprints (f0, f1). recall is a floor that the grid meets whatever it is: all pairs are found.
    """
    radii, tables = grid_plan(n, max_distance, recall, strangers)
    grid = Grid(radii, tables, seed)
    verify = Verifier(grid, max_distance)
    spark = classes.sparkSession
    # some 10 bytes of a row are left by compression
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n * tables * 24 // K.PARTITION_BYTES + 1)
    cells = classes.select("f0", "f1").mapInArrow(_cells(grid), "cell long, f0 long, f1 long")
    found = materialize(cells.repartition(parts, "cell").sortWithinPartitions("cell").mapInArrow(verify.cells(hot), _FOUND), "simhash")
    rest = found.where(F.col("kind") == REST).select(F.col("b0").alias("cell"), F.floor(F.col("b1") / (hot // 2)).cast("long").alias("block"), F.col("a0").alias("f0"), F.col("a1").alias("f1"))
    found = found.where(F.col("kind") != REST)
    if not rest.take(1):
        return found
    blocks = rest.groupBy("cell").agg(F.max("block").alias("most"))
    each = rest.join(blocks, "cell").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), "most")))
    each = each.select("cell", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "f0", "f1")
    paired = each.repartition(parts, "cell", "low", "high").sortWithinPartitions("cell", "low", "high").mapInArrow(verify.blocks(), _FOUND)
    return found.unionAll(materialize(paired, "simhash"))


def _groups(docs: DataFrame, id_col: str, text_col: str, options: dict) -> DataFrame:
    """(id, group_id, links) by keys.key_of() ids."""
    prints = materialize(fingerprints(docs, id_col, text_col).distinct(), "simhash")
    classes = materialize(prints.groupBy("f0", "f1").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "simhash")
    found = links(classes, classes.count(), **options)
    end = lambda x, name: classes.select(F.col("f0").alias(f"{x}0"), F.col("f1").alias(f"{x}1"), F.col("rep").alias(name))
    near = found.where(F.col("kind") == EDGE).join(end("a", "src"), ["a0", "a1"]).join(end("b", "dst"), ["b0", "b1"]).select("src", "dst")
    # different texts under one id are joined through it
    several = prints.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")
    tied = prints.join(several, "id").join(classes, ["f0", "f1"]).select("id", "rep")
    tied = tied.join(tied.groupBy("id").agg(F.min("rep").alias("low")), "id").select(F.col("low").alias("src"), F.col("rep").alias("dst"))
    whole = connected_components(near.unionAll(tied)).withColumnRenamed("id", "rep")
    degree = found.where(F.col("kind") == LINKS).groupBy(F.col("a0").alias("f0"), F.col("a1").alias("f1")).agg(F.sum("b0").alias("degree"))
    marked = classes.join(degree, ["f0", "f1"], "left").join(whole, "rep", "left").where("copies > 1 OR component IS NOT NULL")
    marked = marked.select("f0", "f1", F.coalesce("component", "rep").alias("group_id"), (F.col("copies") - 1 + F.coalesce("degree", F.lit(0))).alias("links"))
    return prints.join(marked, ["f0", "f1"]).groupBy("id").agg(F.min("group_id").alias("group_id"), F.sum("links").alias("links"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id_col, group_id, keep, n_links) for every document in a group of two or more; group_id is the least id, the one kept.

    n_links is the number of other documents with the same fingerprint and of other fingerprints at
    most max_distance bits away. options: max_distance, recall, seed, strangers, hot as in links().

    Documents without a word (null, empty or only symbols) and rows without an id belong to no
    group. Repeats of an id are one document; different texts under one id are joined through it.
    Ids may be of any type; of those that aren't whole numbers the one with the least hash counts as
    the least. All words of a very long text vote. An empty table gives an empty table; other columns
    are ignored.
    """
    groups = _groups(docs, id_col, text_col, options)
    out = groups.select("id", "group_id", (F.col("id") == F.col("group_id")).alias("keep"), F.col("links").alias("n_links"))
    return K.restore(out, docs, id_col, "id", "group_id").withColumnRenamed("id", id_col)


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without the documents that near_duplicates() doesn't keep; all columns stay.

    Rows without an id and texts without a word stay, as do all rows that repeat the id that is kept;
    an empty table gives an empty table.
    """
    gone = _groups(docs, id_col, text_col, options).where("id <> group_id")
    (name,) = W.free_names(docs.columns, "__gone")
    gone = gone.select(F.col("id").alias(name))
    return docs.join(gone.hint("shuffle_hash"), K.key_of(docs, id_col) == F.col(name), "left_anti")
