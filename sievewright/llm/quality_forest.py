"""Quality rules: an isolation forest over rule statistics, with a threshold calibrated on labelled rows.

Every text gives a row of rule statistics (FEATURES). A forest of random splits isolates unusual rows
early: the score is 2 ** (-mean path length over the path length that random data would have), near 1
for anomalies. Every tree draws its own GROW_ON documents from the whole corpus, by a hash of the
document and the tree's number; that is the method's sub-sampling and no bound on the corpus. The
threshold is the least score that at most `max_loss` of the rows labelled good reach, found over all
labelled rows.

Scoring is one narrow pass; scores are written once and used for the calibration and for the result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.llm import words as W
from sievewright.llm.line_dedup import line_table
from sievewright.session import materialize

FEATURES = (
    "log_bytes",
    "log_words",
    "word_bytes",
    "upper_share",
    "digit_share",
    "symbol_share",
    "blank_share",
    "break_share",
    "distinct_word_share",
    "top_word_share",
    "distinct_line_share",
    "log_longest_word",
    "log_longest_line",
)
TREES, GROW_ON = 100, 256
MAX_LOSS = 0.01
STEPS = 4096
_CLASS = np.zeros(256, np.int64)  # 0 other letters, 1 lower, 2 upper, 3 digit, 4 symbol, 5 blank, 6 break
_CLASS[33:127] = 4
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 1, 2, 3
_CLASS[:33] = 5
_CLASS[[10, 13]] = 6


def features(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The statistics of every text of a block; all zero for an empty one."""
    n = len(offs) - 1
    size = np.diff(offs)
    of = np.repeat(np.arange(n), size)
    c = np.bincount(of * 7 + _CLASS[data], minlength=7 * n).reshape(n, 7).astype(float)
    h, s, e, bound = W.words(data, offs, W.ALNUM, True)
    count = np.diff(bound)
    doc = np.repeat(np.arange(n), count)
    key = (doc.astype(np.uint64) << np.uint64(48)) | (h >> np.uint64(16))
    key.sort()
    r = W.runs(key)
    first = (key[r[:-1]] >> np.uint64(48)).astype(np.int64)
    distinct, top, longest = np.bincount(first, minlength=n), np.zeros(n), np.zeros(n)
    np.maximum.at(top, first, np.diff(r))
    np.maximum.at(longest, doc, e - s)
    ldoc, _, ls, le = line_table(data, offs)
    some = le > ls
    ldoc, ls, le = ldoc[some], ls[some], le[some]
    lines = np.bincount(ldoc, minlength=n)
    lkey = np.unique((ldoc.astype(np.uint64) << np.uint64(48)) | (W.word_hashes(data, ls, le) >> np.uint64(16)))
    ldistinct = np.bincount((lkey >> np.uint64(48)).astype(np.int64), minlength=n)
    lmost = np.zeros(n)
    np.maximum.at(lmost, ldoc, le - ls)
    div = lambda a, b: np.divide(a, b, out=np.zeros(n), where=b > 0)
    total, letters = size.astype(float), c[:, 1] + c[:, 2]
    return np.stack(
        [
            np.log1p(total),
            np.log1p(count),
            div(np.bincount(doc, e - s, minlength=n), count),
            div(c[:, 2], letters),
            div(c[:, 3], total),
            div(c[:, 4], total),
            div(c[:, 5], total),
            div(c[:, 6], total),
            div(distinct.astype(float), count),
            div(top, count),
            div(ldistinct.astype(float), lines),
            np.log1p(longest),
            np.log1p(lmost),
        ],
        1,
    )


def usual_path(n: int) -> float:
    """Mean path length of an unsuccessful search in a binary tree of n rows."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


@dataclass
class Forest:
    """Trees as flat arrays: feature (-1 for a leaf), cut, left child (right is the next), depth of a leaf with its usual rest; and the usual path of each tree's rows."""

    feature: list[np.ndarray]
    cut: list[np.ndarray]
    left: list[np.ndarray]
    depth: list[np.ndarray]
    usual: list[float]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, cut, left, depth, usual in zip(self.feature, self.cut, self.left, self.depth, self.usual):
            at = np.zeros(len(x), np.int64)
            live = np.arange(len(x))
            while live.size:
                node = at[live]
                f = feature[node]
                live, node, f = live[f >= 0], node[f >= 0], f[f >= 0]
                at[live] = left[node] + (x[live, f] >= cut[node])
            total += depth[at] / max(usual, 1e-9)
        return 2.0 ** (-total / max(1, len(self.feature)))


def grow(samples: list[np.ndarray], seed: int = 17) -> Forest:
    """An isolation forest with a tree for each sample, to a depth of log2 of its rows; empty samples grow none."""
    rng = np.random.default_rng(seed)
    out = Forest([], [], [], [], [])
    for x in samples:
        if not len(x):
            continue
        limit = math.ceil(math.log2(max(len(x), 2)))
        feature, cut, left, depth = [-1], [0.0], [0], [0.0]
        todo = [(0, x, 0)]
        while todo:
            node, rows, d = todo.pop()
            lo, hi = rows.min(0), rows.max(0)
            split = np.flatnonzero(hi > lo)
            if d >= limit or not split.size:
                depth[node] = d + usual_path(len(rows))
                continue
            f = int(rng.choice(split))
            c = float(rng.uniform(lo[f], hi[f]))
            if c <= lo[f]:
                c = float(np.nextafter(lo[f], hi[f]))
            up = rows[:, f] >= c
            feature[node], cut[node], left[node] = f, c, len(feature)
            for part in (rows[~up], rows[up]):
                todo.append((len(feature), part, d + 1))
                feature.append(-1)
                cut.append(0.0)
                left.append(0)
                depth.append(0.0)
        out.feature.append(np.array(feature))
        out.cut.append(np.array(cut))
        out.left.append(np.array(left))
        out.depth.append(np.array(depth))
        out.usual.append(usual_path(len(x)))
    return out


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", trees: int = TREES, grow_on: int = GROW_ON) -> Forest:
    """A forest over docs, each tree grown on about grow_on documents that its own hash draws from all of docs.

    A document is its id and text; repeated rows are drawn once. Null and empty texts can be drawn
    like others, long ones count whole. Without a row there is no tree, and every score is 1. The
    driver gets at most some trees * grow_on rows of statistics.
    """
    rows = docs.count()
    # more are drawn, of which the least hashes stay, so that nearly every tree has its number even where a third of the rows repeat
    share = min(1.0, (grow_on + 8 * math.sqrt(grow_on)) / max(rows, 1))
    text = F.coalesce(F.col(text_col), F.lit(""))
    drawn = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.shiftrightunsigned(F.xxhash64("h", t), 11) < F.lit(int(share * (1 << 53))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offs in W.blocks(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(list(features(data, offs)), pa.list_(pa.float64()))], names=["h", "trees", "x"])

    some = docs.select(F.xxhash64(F.col(id_col).cast("string"), text).alias("h"), text.alias("text")).withColumn("trees", drawn).where(F.size("trees") > 0).dropDuplicates(["h"])
    got = some.select("h", "trees", "text").mapInArrow(run, "h long, trees array<int>, x array<double>")
    each = got.select("h", F.explode("trees").alias("t"), "x")
    by: list[list] = [[] for _ in range(trees)]
    for r in each.select("t", F.shiftrightunsigned(F.xxhash64("h", "t"), 11).alias("u"), "x").collect():
        by[r["t"]].append((r["u"], r["x"]))
    return grow([np.array([x for _, x in sorted(b)[:grow_on]]).reshape(-1, len(FEATURES)) for b in by])


def scores(docs: DataFrame, forest: Forest, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score) of every row, repeated rows and null ids included; a null text counts as an empty one, a long one whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offs in W.blocks(batch, "text"):
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.round(forest.score(features(data, offs)), 6))], names=[id_col, "score"])

    rows = docs.select(F.col(id_col), F.coalesce(text_col, F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, score double")


def calibrate(scored: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", max_loss: float = MAX_LOSS) -> float:
    """The least threshold, in steps of 1 / STEPS, that at most max_loss of the rows labelled 1 reach; above 1 without such rows."""
    good = labels.where(F.col(label_col) == 1).select(id_col).distinct()
    step = F.floor(F.col("score") * STEPS).cast("int")
    counts = {r["s"]: r["n"] for r in scored.join(good, id_col, "left_semi").groupBy(step.alias("s")).agg(F.count("*").alias("n")).collect()}
    total, above = sum(counts.values()), 0
    if not total:
        return 2.0
    for s in range(STEPS, -1, -1):
        if above + counts.get(s, 0) > max_loss * total:
            return (s + 1) / STEPS
        above += counts.get(s, 0)
    return 0.0


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_loss: float = MAX_LOSS) -> DataFrame:
    """(id_col, score, anomalous) for every row of docs, repeated rows and null ids included.

    labels has (id_col, label_col), 1 for a good document; labels that are null, unknown or without
    a document don't count. A null text is an empty one. Without a row labelled good nothing is
    anomalous; an empty table gives an empty table. Other columns are ignored.
    """
    scored = materialize(scores(docs, fit(docs, id_col, text_col), id_col, text_col), "scores")
    return scored.withColumn("anomalous", F.col("score") >= F.lit(calibrate(scored, labels, id_col, label_col, max_loss)))
