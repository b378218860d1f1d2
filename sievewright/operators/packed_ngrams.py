"""The n-gram model of a corpus and the scores of that same corpus, exchanged in packed form.

A row for each piece of a text, with its history as a string, is some hundred times what the piece takes
on disk. Here a task packs the n-grams of some millions of pieces: cut into buckets by the last piece of
the history, sorted, equal ones counted, written as numbers of a word list of their own and compressed,
a few bytes for each. All levels but the lowest, their totals, and the probabilities are then local to a
bucket. What isn't is small: how often each piece follows anything (level 0), and for a piece that is too
frequent for one bucket, how often each piece follows it (level 1). These are summed up in tables and
sent back to the buckets that asked. Nothing depends on where the buckets are cut.
"""

from __future__ import annotations

import gc
import math
import pickle
import time
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.session import discard, materialize

#: n-grams of a bucket, pieces that are packed at once, rows of a batch that leaves a task, and characters read to find frequent pieces.
PER_BUCKET, CHUNK, BATCH, LOOKED_AT = 2_000_000, 3_000_000, 50_000, 32_000_000


class Layout(NamedTuple):
    """order; buckets by hash; for a frequent piece its first own bucket, and how many it has; all buckets."""

    order: int
    by_hash: int
    hot: dict[str, tuple[int, int]]
    total: int


class Totals(NamedTuple):
    """Of a history: its counts, how many, and how many of 1, 2 and more."""

    total: float
    kinds: int
    each: tuple[int, int, int]


def layout(toks: DataFrame, chars: int, order: int, per_bucket: int | None = None) -> Layout:
    """Buckets for a table of pieces; which pieces are frequent is judged by a sample, which only moves the cuts."""
    per_bucket = per_bucket or PER_BUCKET
    about = max(1, chars // 5)
    share = min(1.0, LOOKED_AT / max(1, chars))
    some = toks.select("toks") if share == 1.0 else toks.select("toks").where(F.rand(7) < share)
    counted = some.select(F.explode("toks").alias("w")).groupBy("w").agg((F.count("*") / share).alias("n"))
    frequent = counted.where(F.col("n") > per_bucket / 2).orderBy("w").collect()
    cores = toks.sparkSession.sparkContext.defaultParallelism
    by_hash = max(1, min(about // 200_000, 2 * cores), math.ceil(about / per_bucket))
    hot, at = {}, by_hash
    for r in frequent:
        parts = math.ceil(2 * r["n"] / per_bucket)
        hot[r["w"]] = (at, parts)
        at += parts
    return Layout(order, by_hash, hot, at)


def _small(x: np.ndarray) -> np.ndarray:
    top = int(x.max()) if len(x) else 0
    return x.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32)


def _planes(x: np.ndarray) -> tuple[str, bytes]:
    """First bytes, then second bytes: these compress better than numbers."""
    x = _small(x)
    return x.dtype.str, x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def _numbers_of(kind: str, planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _joined(words: pa.Array) -> pa.Array | str:
    text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), "\n")[0].as_py()
    return text if text.count("\n") == len(words) - 1 else words


def _words_of(kept: pa.Array | str) -> pa.Array:
    return pc.split_pattern(pa.array([kept]), "\n").values if isinstance(kept, str) else kept


def _packed(at: Layout, ids: pa.Array | None, toks: pa.Array, turn: tuple[int, int] = (0, 1)) -> Iterator[tuple[int, int, bytes]]:
    """(bucket, size, blob) of texts, of the buckets whose turn it is: words in order, columns of histories (the nearest piece first) and pieces from 1 on, counts, and with ids whose they are."""
    lens = pc.fill_null(pc.list_value_length(toks), 0).to_numpy().astype(np.int64)
    coded = toks.flatten().dictionary_encode()
    sort = pc.sort_indices(coded.dictionary)
    words, rank = coded.dictionary.take(sort), np.empty(len(sort), np.int32)
    rank[sort.to_numpy()] = np.arange(len(sort), dtype=np.int32)
    codes = rank[coded.indices.to_numpy()]
    del coded
    place = np.arange(len(codes)) - np.repeat(np.cumsum(lens) - lens, lens)
    rows = np.flatnonzero(place)
    place = place[rows]
    cols = []
    for k in range(1, at.order):
        back = codes[np.maximum(rows - k, 0)] + 1
        back[place < k] = 0
        cols.append(back)
    cols.append(codes[rows] + 1)
    doc = np.repeat(np.arange(len(lens), dtype=np.int32), lens)[rows] if ids is not None else None
    del place, codes
    hashes = pd.util.hash_array(words.to_numpy(zero_copy_only=False).astype(object), categorize=False)
    bucket = (hashes % np.uint64(at.by_hash)).astype(np.int32)[cols[0] - 1]
    salt = np.concatenate([[np.uint64(0)], hashes >> np.uint64(20)])
    of_word = dict(zip(pc.index_in(pa.array(list(at.hot), pa.string()), words).to_pylist(), at.hot.values()))
    for w, (first, parts) in of_word.items():
        if w is not None:
            own = np.flatnonzero(cols[0] == w + 1)
            bucket[own] = first + (salt[cols[1][own]] % np.uint64(parts)).astype(np.int32)
    bucket = _small(bucket)
    by_bucket = np.argsort(bucket, kind="stable")
    bucket = bucket[by_bucket]
    edges = np.flatnonzero(np.diff(bucket, prepend=np.array([-1])))
    place_of = np.zeros(len(words) + 1, np.int32)
    bits = (len(words) + 1).bit_length()
    per_key = max(1, 63 // bits)
    for lo, hi in zip(edges, [*edges[1:], len(bucket)]):
        if bucket[lo] % turn[1] != turn[0]:
            continue
        rows = by_bucket[lo:hi]
        own = [c[rows] for c in cols]
        keys = []
        for k in range(0, len(own), per_key):
            key = np.zeros(len(rows), np.int64)
            for c in own[k : k + per_key]:
                key = key << bits | c
            keys.append(key)
        sort = np.lexsort(keys[::-1])
        new = np.zeros(len(rows), bool)
        new[0] = True
        for key in keys:
            key = key[sort]
            new[1:] |= key[1:] != key[:-1]
        starts = np.flatnonzero(new)
        own = [c[sort[starts]] for c in own]
        used = np.unique(np.concatenate(own))
        used = used[used > 0]
        place_of[used] = np.arange(1, len(used) + 1)
        whose = None
        if ids is not None:
            docs, back = np.unique(doc[rows[sort]], return_inverse=True)
            whose = _planes(back), ids.take(pa.array(docs))
        counts = np.diff(np.append(starts, len(rows)))
        blob = pickle.dumps((_joined(words.take(pa.array(used - 1))), [_planes(place_of[c]) for c in own], _planes(counts), whose), protocol=5)
        yield int(bucket[lo]), len(blob), pa.Codec("zstd", 3).compress(blob, asbytes=True)


def _blobs(toks: DataFrame, at: Layout, with_ids: bool, turn: tuple[int, int] = (0, 1)) -> DataFrame:
    """(bucket, size, blob) of (id, toks)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[pa.Array, pa.Array]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            ids = pa.concat_arrays([i for i, _ in kept]) if with_ids else None
            found = _packed(at, ids, pa.concat_arrays([t for _, t in kept]), turn)
            rows, held = [], 0
            for row in found:
                rows.append(row)
                held += len(row[2])
                if held > 8 << 20:
                    yield batch_of(rows)
                    rows, held = [], 0
            if rows:
                yield batch_of(rows)

        def batch_of(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
            b, s, x = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(s, pa.int64()), pa.array(x, pa.binary())], names=["bucket", "size", "blob"])

        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            ends = np.cumsum(pc.fill_null(pc.list_value_length(texts), 0).to_numpy().astype(np.int64))
            lo = 0
            while lo < len(ends):
                done = int(ends[lo - 1]) if lo else 0
                hi = max(lo + 1, int(np.searchsorted(ends, done + CHUNK - size, "right")))
                kept.append((ids.slice(lo, hi - lo), texts.slice(lo, hi - lo)))
                size += int(ends[hi - 1]) - done
                lo = hi
                if size >= CHUNK or lo < len(ends):
                    yield from flush()
                    kept, size = [], 0
        if size:
            yield from flush()

    return toks.mapInArrow(run, "bucket int, size long, blob binary")


def _numbers(x: np.ndarray) -> tuple[np.ndarray, int]:
    codes, found = pd.factorize(x)
    return codes.astype(np.int32), len(found)


class _Bucket:
    """The n-grams of a bucket by level: for level k the rows with k pieces of history, history and n-gram of each, and counts."""

    def __init__(self, blobs: list[tuple[int, bytes]], kneser_ney: bool):
        read = [pickle.loads(pa.decompress(b, size, codec="zstd", asbytes=True)) for size, b in blobs]
        lists = [_words_of(r[0]) for r in read]
        coded = pa.concat_arrays(lists).dictionary_encode()
        self.words, codes = coded.dictionary, coded.indices.to_numpy().astype(np.int32) + 1
        cols, done = [], 0
        for words, (_, own, _, _) in zip(lists, read):
            place = np.concatenate([np.zeros(1, np.int32), codes[done : done + len(words)]])
            cols.append([place[_numbers_of(*c)] for c in own])
            done += len(words)
        self.cols = [np.concatenate(c) for c in zip(*cols)]
        counts = [_numbers_of(*r[2]) for r in read]
        self.counts = np.concatenate(counts).astype(np.int64)
        self.whose = [(c, *r[3]) if r[3] else None for c, r in zip(counts, read)]
        del read, cols, counts, lists, coded
        n, top, many = len(self.counts), len(self.cols) - 1, len(self.words) + 1
        self.levels: dict[int, tuple] = {}
        before = np.zeros(n, np.int32)
        for k in range(1, top + 1):
            rows = np.flatnonzero(self.cols[k - 1]).astype(np.int32)
            history, histories = _numbers(before[rows].astype(np.int64) * many + self.cols[k - 1][rows])
            gram, grams = _numbers(history.astype(np.int64) * many + self.cols[-1][rows])
            before[rows] = history
            first, of = np.empty(grams, np.int32), np.empty(grams, np.int32)
            first[gram], of[gram] = rows, history
            self.levels[k] = rows, history, gram, histories, first, of
        self.count: dict[int, np.ndarray] = {}
        for k in range(top, 0, -1):
            rows, _, gram, _, first, _ = self.levels[k]
            own = self.counts[rows]
            if kneser_ney and k < top:
                own = np.where(self.cols[k][rows] == 0, own, 0)
            c = np.bincount(gram, weights=own, minlength=len(first))
            if kneser_ney and k < top:
                at = np.empty(n, np.int32)
                at[rows] = gram
                c += np.bincount(at[self.levels[k + 1][4]], minlength=len(first))
            self.count[k] = c.astype(np.int64)


def _gathered(batches: Iterator[pa.RecordBatch]) -> tuple[int | None, list[tuple[int, bytes]], list[pa.RecordBatch]]:
    """The bucket of a partition, its blobs, and the other rows."""
    bucket, blobs, rest = None, [], []
    for batch in batches:
        if batch.num_rows:
            bucket = batch.column("bucket")[0].as_py()
        there = batch.column("blob").is_valid()
        with_blob = batch.filter(there)
        blobs += zip(with_blob.column("size").to_pylist(), with_blob.column("blob").to_pylist())
        if with_blob.num_rows < batch.num_rows:
            rest.append(batch.filter(pc.invert(there)))
    return bucket, blobs, rest


_LOW = "bucket int, h string, next string, n int, c long"


def _low(toks: DataFrame, at: Layout, kneser_ney: bool) -> DataFrame:
    """Counts that a bucket can't have alone: (bucket, null, next) of level 0, (bucket, h, next) of frequent pieces h; and as (n, c) without next how many counts of 1 to 4 (n % 10) level n // 10 has."""
    names = {b: w for w, (first, parts) in at.hot.items() for b in range(first, first + parts)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, blobs, _ = _gathered(batches)
        if not blobs:
            return
        b = _Bucket(blobs, kneser_ney)
        del blobs
        hot = names.get(bucket)

        def rows(h, following: pa.Array, n: list, c) -> pa.RecordBatch:
            size = len(c)
            return pa.RecordBatch.from_arrays([pa.array([bucket] * size, pa.int32()), pa.array([h] * size, pa.string()), following, pa.array(n, pa.int32()), pa.array(c, pa.int64())], names=["bucket", "h", "next", "n", "c"])

        of_counts = [(k * 10 + c, int((b.count[k] == c).sum())) for k in b.levels if not (hot is not None and k == 1) for c in range(1, 5)]
        if of_counts:
            yield rows(None, pa.nulls(len(of_counts), pa.string()), [n for n, _ in of_counts], [c for _, c in of_counts])
        following, c = b.cols[-1][b.levels[1][4]], b.count[1]
        if hot is None:
            sums = np.bincount(following, weights=None if kneser_ney and at.order > 1 else c, minlength=len(b.words) + 1)
            following = np.flatnonzero(sums)
            c = sums[following].astype(np.int64)
        for lo in range(0, len(c), BATCH):
            part = following[lo : lo + BATCH]
            yield rows(hot, b.words.take(pa.array(part - 1)), [0] * len(part), c[lo : lo + BATCH])

    return _blobs(toks, at, False).repartitionById(at.total, F.col("bucket")).mapInArrow(run, _LOW)


def _settle(spark) -> None:
    """What an exchange left on disk goes as soon as the driver finds that nothing holds it."""
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.5)


class Packed:
    """What is counted of (id, toks): the low levels as tables, of the rest only how many small counts there are."""

    def __init__(self, docs: DataFrame, text_col: str, order: int, kneser_ney: bool, toks, id_col: str | None = None, per_bucket: int | None = None):
        spark = docs.sparkSession
        self.kind = docs.schema[id_col].dataType.simpleString() if id_col else "int"
        rows = docs.where(F.col(text_col).isNotNull())
        self.toks = rows.select((F.col(id_col) if id_col else F.lit(0)).alias("id"), toks.alias("toks"))
        self.kneser_ney = kneser_ney
        chars = rows.agg(F.sum(F.length(text_col))).first()[0] or 0
        self.at = layout(self.toks, chars, order, per_bucket)
        self.low = materialize(_low(self.toks, self.at, kneser_ney), "low")
        parts = self.low.where(F.col("next").isNotNull())
        # the one history "" of level 0, and the frequent histories of level 1
        self.hot = materialize(parts.where(F.col("h").isNotNull()).groupBy("h", "next").agg(F.sum("c").alias("c")), "hot") if self.at.hot else None
        single = parts.where(F.col("h").isNull()).select("next", "c")
        if self.hot is not None:
            single = single.unionAll(self.hot.select("next", F.lit(1).cast("long") if kneser_ney else F.col("c")))
        self.single = materialize(single.groupBy("next").agg(F.sum("c").alias("c")), "single")
        self.small: dict[tuple[int, int], int] = {}
        for r in self.low.where(F.col("next").isNull()).groupBy("n").agg(F.sum("c").alias("c")).collect():
            self.small[r["n"] // 10, r["n"] % 10] = r["c"]
        sums = [F.sum("c").alias("total"), F.count("*").alias("kinds"), *(F.count_if(F.col("c") == k).alias(f"n{k}") for k in range(1, 5))]
        of = lambda r: Totals(float(r["total"] or 0), r["kinds"], (r["n1"], r["n2"], r["kinds"] - r["n1"] - r["n2"]))
        lowest = self.single.agg(*sums).first()
        self.lowest, self.of_hot = of(lowest), {}
        frequent = self.hot.groupBy("h").agg(*sums).collect() if self.hot is not None else []
        for k in range(1, 5):
            self.small[0, k] = lowest[f"n{k}"]
            self.small[1, k] = self.small.get((1, k), 0) + sum(r[f"n{k}"] for r in frequent)
        for r in frequent:
            self.of_hot |= dict.fromkeys(range(self.at.hot[r["h"]][0], sum(self.at.hot[r["h"]])), of(r))
        _settle(spark)

    def rows(self) -> DataFrame:
        """(n, history, next, count) of all levels; nothing else can be asked for after that."""
        at, kneser_ney = self.at, self.kneser_ney
        discard(self.low)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bucket, blobs, _ = _gathered(batches)
            if not blobs:
                return
            b = _Bucket(blobs, kneser_ney)
            del blobs
            for k, (_, _, _, _, first, _) in b.levels.items():
                if k == 1 and bucket >= at.by_hash:
                    continue
                for lo in range(0, len(first), BATCH):
                    rows = first[lo : lo + BATCH]
                    word = lambda c: b.words.take(pa.array(c[rows] - 1))  # noqa: B023, E731
                    history = [word(b.cols[j]) for j in range(k - 1, -1, -1)]
                    history = pc.binary_join_element_wise(*history, " ") if k > 1 else history[0]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), k, np.int32)), history, word(b.cols[-1]), pa.array(b.count[k][lo : lo + BATCH])], names=["n", "history", "next", "count"])

        out = _blobs(self.toks, at, False).repartitionById(at.total, F.col("bucket")).mapInArrow(run, "n int, history string, next string, count long")
        out = out.unionAll(self.single.select(F.lit(0).alias("n"), F.lit("").alias("history"), "next", F.col("c").alias("count")))
        return out if self.hot is None else out.unionAll(self.hot.select(F.lit(1).alias("n"), F.col("h").alias("history"), "next", F.col("c").alias("count")))

    def scores(self, cuts: dict[int, tuple[float, float, float]]) -> DataFrame:
        """(id, score, n): of every id the sum of log10 p and the number of its steps. Long n-grams go in two turns, each with half of the buckets, so that half of them is on disk at once."""
        turns = 1 if self.at.order == 2 else 2
        if turns == 1:
            return self._scores(cuts, (0, 1))
        out = None
        for k in range(turns):
            part = materialize(self._scores(cuts, (k, turns)), "scores")
            out = part if out is None else out.unionAll(part)
            _settle(self.toks.sparkSession)
        return out.groupBy("id").agg(F.sum("score").alias("score"), F.sum("n").alias("n"))

    def _scores(self, cuts: dict[int, tuple[float, float, float]], turn: tuple[int, int]) -> DataFrame:
        at, kneser_ney, lowest, of_hot = self.at, self.kneser_ney, self.lowest, self.of_hot
        parts = self.low.where(F.col("next").isNotNull() & (F.col("bucket") % turn[1] == turn[0]))
        asked = parts.select("bucket", "h", "next").join(self.single.withColumnRenamed("c", "c0"), "next")
        if self.hot is not None:
            plain = asked.where(F.col("h").isNull()).withColumn("c1", F.lit(None).cast("long"))
            own = asked.where(F.col("h").isNotNull()).join(self.hot.withColumnRenamed("c", "c1"), ["h", "next"])
            asked = plain.select("bucket", "next", "c0", "c1").unionAll(own.select("bucket", "next", "c0", "c1"))
        else:
            asked = asked.select("bucket", "next", "c0", F.lit(None).cast("long").alias("c1"))
        blobs = _blobs(self.toks, at, True, turn).select("bucket", "size", "blob", F.lit(None).cast("string").alias("next"), F.lit(None).cast("long").alias("c0"), F.lit(None).cast("long").alias("c1"))
        both = blobs.unionAll(asked.select("bucket", F.lit(0).cast("long"), F.lit(None).cast("binary"), "next", "c0", "c1"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bucket, blobs, rest = _gathered(batches)
            if not blobs:
                return
            b = _Bucket(blobs, kneser_ney)
            del blobs
            known = pa.Table.from_batches(rest).combine_chunks()
            place = pc.index_in(known.column("next"), b.words).to_numpy().astype(np.int64) + 1
            low = np.zeros((2, len(b.words) + 1), np.int64)
            low[0, place] = known.column("c0").to_numpy()
            if bucket in of_hot:
                low[1, place] = known.column("c1").to_numpy()
            del known, rest
            following = b.cols[-1]

            def discounted(count, total, spare, rest_p, d):
                return np.maximum(count - d[np.minimum(count, 3) - 1], 0.0) / total + spare / total * rest_p

            d = np.array(cuts[0])
            p = discounted(low[0][following], lowest.total, d @ lowest.each, 1.0 / (lowest.kinds + 1), d)
            for k, (rows, history, gram, histories, _, of) in b.levels.items():
                d, count = np.array(cuts[k]), b.count[k]
                if k == 1 and bucket in of_hot:
                    t = of_hot[bucket]
                    p = discounted(low[1][following], t.total, d @ t.each, p, d)
                    continue
                total = np.bincount(of, weights=count, minlength=histories)
                spare = np.bincount(of, weights=d[np.minimum(count, 3) - 1], minlength=histories)
                p[rows] = discounted(count[gram], total[history], spare[history], p[rows], d)
            logs, done = np.log10(p), 0
            for counts, docs, ids in b.whose:
                each, docs = np.repeat(logs[done : done + len(counts)], counts), _numbers_of(*docs)
                done += len(counts)
                out = [ids, pa.array(np.bincount(docs, weights=each, minlength=len(ids))), pa.array(np.bincount(docs, minlength=len(ids)).astype(np.int64))]
                yield pa.RecordBatch.from_arrays(out, names=["id", "score", "n"])

        out = both.repartitionById(at.total, F.col("bucket")).mapInArrow(run, f"id {self.kind}, score double, n long")
        return out.groupBy("id").agg(F.sum("score").alias("score"), F.sum("n").alias("n"))
