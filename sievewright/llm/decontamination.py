"""Benchmark decontamination: BM25 over an inverted index of the test items, every training passage a query.

Scores are normalised per item: the weight of a term in an item is its BM25 impact over the sum
of the item's impacts, so a passage that holds a whole item scores 1 and the threshold is a share
of the item's evidence. Documents are cut into overlapping passages of twice the longest item, so
that every possible occurrence of an item lies within one passage.

Retrieval of all items above the threshold is exact and has two steps. First, for a whole block of
documents at once, each item's rarest terms (those without which it can't reach the threshold) are
added up per passage, and with the sum of the other weights give an upper bound. Passages that may
still reach the threshold are then evaluated by block-max WAND over the full postings. What is
retrieved counts as contamination when both the item's question and its answer overlap with the
passage in enough word 3-grams.

The index is sent to the executors, so its size is checked: beyond `shard_items` items or
`shard_bytes` of their text it is built in shards, one narrow pass over the corpus each. The items
stream past the driver twice, once for the statistics and once for the shards, and it holds one
shard at a time. All shards share the statistics and the stride of the whole benchmark, so rows and
scores don't depend on the bounds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sievewright.llm import words as W
from sievewright.session import materialize

K1, B = 1.2, 0.75
THRESHOLD, OVERLAP = 0.6, 0.5
SHARD_ITEMS, SHARD_BYTES = 50_000, 16 << 20
BLOCK = 64
_BASE = np.uint64(0x9E3779B97F4A7C15)


def hashes_of(texts: list[str]) -> list[np.ndarray]:
    """The word hashes of each text (folded words of letters and digits)."""
    data, offs = W.text_buffers(pa.array(texts, pa.string()))
    h, _, _, bound = W.words(data, offs, W.ALNUM, True)
    return [h[bound[i] : bound[i + 1]] for i in range(len(texts))]


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the word n-grams of a sequence."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out = W.mix(out * _BASE + h[k : len(h) - n + 1 + k])
    return out


def overlap(part: np.ndarray, passage: np.ndarray) -> float:
    """Share of the distinct word 3-grams of part (of fewer words: of its one n-gram) that the passage has."""
    n = min(3, len(part))
    if n == 0:
        return 1.0
    g = np.unique(grams(part, n))
    return float(np.isin(g, grams(passage, n)).mean())


class Statistics:
    """Items, mean and greatest length and document frequencies of the items with a word; add() takes the items part by part."""

    def __init__(self):
        self.n = self.words = 0
        self.longest = 1
        self.terms, self.df = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, whole: list[np.ndarray]) -> Statistics:
        whole = [w for w in whole if len(w)]
        if whole:
            self.n += len(whole)
            self.words += sum(map(len, whole))
            self.longest = max(self.longest, *map(len, whole))
            terms, df = np.unique(np.concatenate([np.unique(w) for w in whole]), return_counts=True)
            self.terms, at = np.unique(np.concatenate([self.terms, terms]), return_inverse=True)
            self.df = np.bincount(at, np.concatenate([self.df, df])).astype(np.int64)
        return self


class Index:
    """Postings of normalised BM25 weights with block maxima; of a shard when given the statistics of all items."""

    def __init__(self, ids: list, questions: list[np.ndarray], answers: list[np.ndarray], threshold: float, stats: Statistics | None = None):
        whole = [np.concatenate([q, a]) for q, a in zip(questions, answers)]
        keep = [i for i, w in enumerate(whole) if len(w)]
        self.ids, self.questions, self.answers = [ids[i] for i in keep], [questions[i] for i in keep], [answers[i] for i in keep]
        whole = [whole[i] for i in keep]
        stats = stats or Statistics().add(whole)
        self.threshold, n = threshold, len(whole)
        self.stride = stats.longest
        tf = [np.unique(w, return_counts=True) for w in whole]
        self.terms = np.unique(np.concatenate([t for t, _ in tf]) if tf else np.zeros(0, np.uint64))
        df = stats.df[np.searchsorted(stats.terms, self.terms)]
        idf = np.log(1 + (stats.n - df + 0.5) / (df + 0.5))
        mean = stats.words / max(1, stats.n)
        self.slack = np.zeros(n)  # the weight of the terms that the first step leaves out
        posted, rare = [], []  # (term, item, weight) of each item
        for i, (t, c) in enumerate(tf):
            k = np.searchsorted(self.terms, t)
            w = idf[k] * c * (K1 + 1) / (c + K1 * (1 - B + B * len(whole[i]) / mean))
            w = w / w.sum()
            posted.append((k, np.full(len(k), i), w))
            order = np.lexsort((k, df[k]))
            # the rarest terms, until the others together are worth less than half the threshold
            rest = 1 - np.cumsum(w[order])
            take = int(np.argmax(rest < threshold / 2)) + 1
            self.slack[i] = max(0.0, float(rest[take - 1]))
            rare.append((k[order[:take]], np.full(take, i), w[order[:take]]))
        of, items, weights = self._by_term(posted)
        cut = np.searchsorted(of, np.arange(1, len(self.terms)))
        self.items, self.weights = np.split(items, cut), np.split(weights, cut)
        self.most = np.array([x.max(initial=0.0) for x in self.weights])
        self.block_most = [np.maximum.reduceat(x, np.arange(0, len(x), BLOCK)) for x in self.weights if len(x)]
        self.block_last = [x[np.minimum(np.arange(BLOCK, len(x) + BLOCK, BLOCK), len(x)) - 1] for x in self.items if len(x)]
        of, self.rare_item, self.rare_weight = self._by_term(rare)
        self.rare_n = np.bincount(of, minlength=len(self.terms))
        self.rare_at = np.concatenate([[0], np.cumsum(self.rare_n)]).astype(np.int64)

    @staticmethod
    def _by_term(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(term, item, weight) of all parts, by term and item."""
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        term, item, weight = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((item, term))
        return term[order], item[order], weight[order]

    def candidates(self, term: np.ndarray, segment: np.ndarray) -> np.ndarray:
        """The segments (of stride words) such that a passage of it and the next may reach the threshold.

        term, segment: of every word of a block that is in the index.
        """
        pick = self.rare_n[term] > 0
        key = np.unique(segment[pick] * len(self.terms) + term[pick])
        seg, t = np.divmod(key, max(1, len(self.terms)))
        n = self.rare_n[t]
        at = np.repeat(self.rare_at[t] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        seg, item, w = np.repeat(seg, n), self.rare_item[at], self.rare_weight[at]
        # a segment counts in the passage that it opens and in the one that it closes
        pair = np.concatenate([seg, seg - 1]) * len(self.ids) + np.concatenate([item, item])
        pair, of = np.unique(pair, return_inverse=True)
        bound = np.bincount(of, np.concatenate([w, w]), minlength=len(pair)) + self.slack[pair % max(1, len(self.ids))]
        return np.unique(pair[bound >= self.threshold - 1e-9] // max(1, len(self.ids)))

    def search(self, terms: np.ndarray) -> list[tuple[int, float]]:
        """Block-max WAND: all (item, score) with a score of at least the threshold; terms: distinct term numbers."""
        goal = self.threshold - 1e-9
        at = {int(t): 0 for t in terms}
        now = {t: int(self.items[t][0]) for t in at}
        found = []
        while now:
            order = sorted(now, key=now.get)
            total, pivot = 0.0, -1
            for k, t in enumerate(order):
                total += self.most[t]
                if total >= goal:
                    pivot = k
                    break
            if pivot < 0:
                break
            doc = now[order[pivot]]
            while pivot + 1 < len(order) and now[order[pivot + 1]] == doc:
                pivot += 1
            head = order[: pivot + 1]
            bound, limit = 0.0, math.inf
            for t in head:
                b = int(np.searchsorted(self.block_last[t], doc))
                if b < len(self.block_last[t]):
                    bound += self.block_most[t][b]
                    limit = min(limit, int(self.block_last[t][b]) + 1)
            if bound >= goal:
                if now[head[0]] == doc:
                    score = sum(self.weights[t][at[t]] for t in head)
                    if score >= goal:
                        found.append((doc, float(score)))
                    self._advance(head, doc + 1, at, now)
                else:
                    self._advance([t for t in head if now[t] < doc], doc, at, now)
            else:
                # no item before the end of these blocks can reach the threshold
                if pivot + 1 < len(order):
                    limit = min(limit, now[order[pivot + 1]])
                self._advance(head, max(doc + 1, limit if limit < math.inf else doc + 1), at, now)
        return found

    def _advance(self, terms, doc, at, now) -> None:
        for t in terms:
            k = at[t] + int(np.searchsorted(self.items[t][at[t] :], doc))
            if k < len(self.items[t]):
                at[t], now[t] = k, int(self.items[t][k])
            else:
                del at[t], now[t]

    def matches(self, data: np.ndarray, offs: np.ndarray, min_overlap: float) -> dict[tuple[int, int], tuple[float, float, float]]:
        """{(text, item): (score, question overlap, answer overlap)} of the contaminated texts of a block."""
        out: dict = {}
        if not len(self.ids):
            return out
        h, _, _, bound = W.words(data, offs, W.ALNUM, True)
        if not len(h):
            return out
        n = len(offs) - 1
        term = np.minimum(np.searchsorted(self.terms, h), len(self.terms) - 1)
        known = np.flatnonzero(self.terms[term] == h)
        # segments are numbered through the block, with one left empty after each text
        count = np.diff(bound)
        segs = -(-count // self.stride) + 1
        base = np.concatenate([[0], np.cumsum(segs)]) + 1
        text = np.searchsorted(bound, known, "right") - 1
        segment = base[text] + (known - bound[text]) // self.stride
        for c in self.candidates(term[known], segment).tolist():
            i = int(np.searchsorted(base, c, "right")) - 1
            if i < 0 or i >= n:
                i = min(max(i, 0), n - 1)
            a = int(bound[i]) + max(0, (c - int(base[i])) * self.stride)
            b = min(int(bound[i]) + (c - int(base[i]) + 2) * self.stride, int(bound[i + 1]))
            if b <= a:
                continue
            x = term[a:b]
            terms = np.unique(x[self.terms[x] == h[a:b]])
            for item, score in self.search(terms):
                q, v = overlap(self.questions[item], h[a:b]), overlap(self.answers[item], h[a:b])
                if q >= min_overlap and v >= min_overlap:
                    out[i, item] = max(out.get((i, item), (0.0, 0.0, 0.0)), (score, q, v))
        return out


def split_item(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Question and answer of an item that is one text: its first three quarters and the rest; under four words it is all question."""
    if len(h) < 4:
        return h, h[:0]
    k = math.ceil(len(h) * 3 / 4)
    return h[:k], h[k:]


def build_indexes(
    benchmark: DataFrame,
    item_col: str = "item_id",
    text_col: str = "text",
    answer_col: str | None = None,
    threshold: float = THRESHOLD,
    shard_items: int = SHARD_ITEMS,
    shard_bytes: int = SHARD_BYTES,
) -> Iterator[Index]:
    """Indexes of at most shard_items items and about shard_bytes of text each. Items without an id or a word are left out; a repeated item counts once."""
    answer = F.coalesce(F.col(answer_col), F.lit("")) if answer_col else F.lit("")
    items = benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).alias("i"), F.coalesce(text_col, F.lit("")).alias("q"), answer.alias("a")).distinct()
    items = materialize(items.orderBy("i", "q", "a"), "items").orderBy("i", "q", "a")

    def shards() -> Iterator[tuple[list, list, list]]:
        rows, size = [], 0

        def hashed():
            qs, ans = hashes_of([r["q"] for r in rows]), hashes_of([r["a"] for r in rows])
            if not answer_col:
                qs, ans = zip(*map(split_item, qs))
            return [r["i"] for r in rows], list(qs), list(ans)

        for r in items.toLocalIterator():
            rows.append(r)
            size += len(r["q"]) + len(r["a"])
            if len(rows) == shard_items or size >= shard_bytes:
                yield hashed()
                rows, size = [], 0
        if rows:
            yield hashed()

    stats = Statistics()
    for _, qs, ans in shards():
        stats.add([np.concatenate([q, a]) for q, a in zip(qs, ans)])
    for shard in shards():
        yield Index(*shard, threshold, stats)


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    answer_col: str | None = None,
    threshold: float = THRESHOLD,
    min_overlap: float = OVERLAP,
    shard_items: int = SHARD_ITEMS,
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """(id_col, item_id, score, question_overlap, answer_overlap) of every contaminated document and item.

    Every passage of every document is a query. A document that repeats counts once; a null id is
    reported as null; a null or empty text has no passage, every passage of a very long one is a
    query. Without documents or items the result is empty. Other columns are ignored.
    """
    spark = docs.sparkSession
    kind, item_kind = docs.schema[id_col].dataType, benchmark.schema[item_col].dataType
    item_type = to_arrow_type(item_kind)
    schema = f"`{id_col}` {kind.simpleString()}, item_id {item_kind.simpleString()}, score double, question_overlap double, answer_overlap double"
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))

    def runner(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                for part, data, offs in W.blocks(batch, "text"):
                    got = index.matches(data, offs, min_overlap)
                    if got:
                        keys = list(got)
                        vals = np.round(np.array([got[k] for k in keys]), 6)
                        yield pa.RecordBatch.from_arrays(
                            [
                                part.column(0).take(pa.array([k[0] for k in keys])),
                                pa.array([index.ids[k[1]] for k in keys], item_type),
                                *(pa.array(vals[:, c].copy()) for c in range(3)),
                            ],
                            names=[id_col, "item_id", "score", "question_overlap", "answer_overlap"],
                        )

        return run

    found = [rows.mapInArrow(runner(spark.sparkContext.broadcast(x)), schema) for x in build_indexes(benchmark, item_col, item_text_col, answer_col, threshold, shard_items, shard_bytes)]
    if not found:
        return spark.createDataFrame([], schema)
    return (
        reduce(DataFrame.unionAll, found)
        .groupBy(id_col, "item_id")
        .agg(F.max(F.struct("score", "question_overlap", "answer_overlap")).alias("best"))
        .select(id_col, "item_id", "best.*")
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", threshold: float = THRESHOLD, min_overlap: float = OVERLAP, shard_items: int = SHARD_ITEMS, shard_bytes: int = SHARD_BYTES, **item_columns) -> DataFrame:
    """docs without the rows that contaminated() reports, in a narrow pass for each index shard; columns stay as they are.

    Every row is judged by its own text: rows without an id as well, repeated rows alike; null and
    empty texts stay. An empty table gives an empty table, an empty benchmark leaves all.
    """
    at = docs.columns.index(text_col)

    def runner(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for rows, data, offs in W.blocks(batch, batch.schema.names[at]):
                    keep = np.ones(rows.num_rows, bool)
                    keep[[k[0] for k in shared.value.matches(data, offs, min_overlap)]] = False
                    yield rows.filter(pa.array(keep))

        return run

    spark = docs.sparkSession
    for index in build_indexes(benchmark, threshold=threshold, shard_items=shard_items, shard_bytes=shard_bytes, **item_columns):
        docs = docs.mapInArrow(runner(spark.sparkContext.broadcast(index)), docs.schema)
    return docs
