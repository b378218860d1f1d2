"""Removal of passages that occur earlier in the corpus, by suffix automata of reference shards.

A word is a run of visible bytes. A window is `min_words` consecutive words; it is a repeat if an
equal window starts earlier in the order of (document id, text digest, word). All words of repeats
go, as maximal spans; the first occurrence of everything stays.

Sending automata of the whole corpus to every executor would make each document stream past every
shard: quadratic work. Here the shards are aligned with the text that can match them:

1. Every window elects an anchor, the k-gram of its words with the least hash (winnowing), so equal
   windows elect equal anchors. Only (hash, place) is shuffled.
2. Anchors that occur once are dropped; the places of the others go back to their documents, and
   only the words that a window around such a place can hold are cut out.
3. Those contexts are sharded by anchor. For each anchor the earlier contexts form the reference: a
   generalised suffix automaton, extended as they stream by, whose matching statistic at a word is
   the longest passage that ends there and occurred earlier. Statistics of at least min_words give
   the spans. Contexts equal to an earlier one repeat its statistics and aren't streamed.

An anchor that repeats within a task is known to be repeated: it is sent to its shard once by a task,
the other places go straight back to their documents. Within a block of rows, equal contexts are sent
to their shard once. So of a passage that a large part of the corpus shares a shard gets a row for each
task or block and not for each document.

spans_in() is the plain form of the method, for a given reference table of bounded size: its
automata are broadcast shard by shard and every document streams past each of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sievewright.llm import keys as K
from sievewright.llm import words as W

MIN_WORDS, GRAM = 50, 16
REMEMBERED = 1 << 18  # repeated anchors that a task remembers; more are only sent more often
SHARD_BYTES, REFERENCE_BYTES = 4 << 20, 256 << 20
_B = 0x9E3779B97F4A7C15
_BI = pow(_B, -1, 1 << 64)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of them."""
    size = 1 << max(16, int(n).bit_length())
    if size not in _POWERS:
        both = []
        for b in (_B, _BI):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _POWERS.clear()
        _POWERS[size] = (both[0], both[1])
    return _POWERS[size]


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k consecutive words."""
    n = len(h)
    if n < k:
        return np.zeros(0, np.uint64)
    up, down = _powers(n + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(W.mix(h) * up[:n], dtype=np.uint64)])
    return np.maximum(W.mix((total[k:] - total[:-k]) * down[: n - k + 1]), np.uint64(1))


def _sliding(x: np.ndarray, w: int, op) -> np.ndarray:
    """op over every w consecutive values."""
    span = 1
    while span * 2 <= w:
        x = op(x[:-span], x[span:])
        span *= 2
    return op(x[: len(x) - (w - span)], x[w - span :]) if w > span else x


def anchors(h: np.ndarray, bound: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(word, hash) of the elected k-grams of a block; bound delimits its texts."""
    n, w = len(h), length - k + 1
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    g = gram_hashes(h, k)
    least = _sliding(g, w, np.minimum)  # of the window that starts at each word
    end = np.repeat(bound[1:], np.diff(bound))  # where each word's text ends
    least[np.arange(len(least)) + length > end[: len(least)]] = 0
    pad = np.zeros(w - 1, np.uint64)
    best = _sliding(np.concatenate([pad, least, pad]), w, np.maximum)
    at = np.flatnonzero(best[: len(g)] == g)
    return at, g[at]


class Automaton:
    """A suffix automaton of several sequences; add() also gives each position's matching statistic."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length, self.owner = [-1], [0], [None]

    def add(self, sequence: list, owner) -> list[tuple[int, object]]:
        """For each position the length of the longest passage ending there that ended earlier, and its first owner."""
        nxt, link, length, owners = self.next, self.link, self.length, self.owner
        last, out = 0, []
        for i, c in enumerate(sequence):
            p = last
            q = nxt[p].get(c)
            if q is not None and length[q] == length[p] + 1:
                last = q
                out.append((i + 1, owners[q]))
                continue
            cur = None
            if q is None:
                cur = len(nxt)
                nxt.append({})
                link.append(0)
                length.append(length[p] + 1)
                owners.append(owner)
                while p != -1 and c not in nxt[p]:
                    nxt[p][c] = cur
                    p = link[p]
            if p == -1:
                last = cur
                out.append((0, None))
                continue
            q = nxt[p][c]
            if length[q] != length[p] + 1:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                owners.append(owners[q])
                link[q] = clone
                while p != -1 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                q = clone
            if cur is None:
                last = q
                out.append((i + 1, owners[q]))
            else:
                link[cur] = q
                last = cur
                out.append((length[q], owners[q]))
        return out


    def match(self, sequence: list) -> list[tuple[int, object]]:
        """For each position the length of the longest passage ending there that the automaton has, and its first owner."""
        nxt, link, length, owners = self.next, self.link, self.length, self.owner
        at = n = 0
        out = []
        for c in sequence:
            while at and c not in nxt[at]:
                at = link[at]
                n = length[at]
            if c in nxt[at]:
                at = nxt[at][c]
                n += 1
            out.append((n, owners[at]))
        return out


def spans_of(stats: list[tuple[int, object]], least: int) -> list[tuple[int, int, object]]:
    """Maximal (start, end, owner) that statistics of at least `least` cover."""
    out: list = []
    for i, (n, owner) in enumerate(stats):
        if n >= least:
            a = i - n + 1
            if out and a <= out[-1][1]:
                while len(out) > 1 and a <= out[-2][1]:
                    out.pop()
                out[-1] = (min(a, out[-1][0]), i + 1, out[-1][2])
            else:
                out.append((a, i + 1, owner))
    return out


def _anchor_rows(parts: int, least: int, k: int):
    """Rows of (part, anchor, id, digest, pos, known); known where the anchor has occurred before in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = np.zeros(0, np.uint64)  # repeated anchors whose shard knows of them, sorted
        for batch in batches:
            for rows, data, offs in W.blocks(batch, "text"):
                h, _, _, bound = W.words(data, offs, W.VISIBLE, False)
                at, g = anchors(h, bound, least, k)
                g = W.mix(g)  # elected hashes are small ones; the shards need uniform numbers
                doc = np.searchsorted(bound, at, "right") - 1
                shard = (g >> np.uint64(33)).astype(np.int64) * parts >> 31
                order = np.argsort(g, kind="stable")
                run_at = W.runs(g[order])
                nth = np.arange(len(g)) - np.repeat(run_at[:-1], np.diff(run_at))
                before = np.isin(g[order], sent) if len(sent) else np.zeros(len(g), bool)
                more = np.repeat(np.diff(run_at) > 1, np.diff(run_at))
                known = np.zeros(len(g), bool)
                known[order] = before | more
                direct = np.zeros(len(g), bool)
                direct[order] = before | (nth > 0)
                own = W.mix(rows.column(0).to_numpy().view(np.uint64)[doc]) % np.uint64(parts)
                if len(sent) < REMEMBERED:
                    sent = np.union1d(sent, g[order][more & (nth == 0)])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.where(direct, own.astype(np.int64), shard).astype(np.int32)),
                        pa.array(g.view(np.int64)),
                        pa.array(rows.column(0).to_numpy()[doc]),
                        pa.array(rows.column(1).to_numpy()[doc]),
                        pa.array((at - bound[doc]).astype(np.int32)),
                        pa.array(known),
                    ],
                    names=["part", "anchor", "id", "digest", "pos", "known"],
                )

    return run


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor: those whose anchor occurs more than once here, or is known to."""
    rest: pa.Table | None = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        t = pa.Table.from_batches([batch])
        if rest is not None:
            t = pa.concat_tables([rest, t]).combine_chunks()
        a = t.column("anchor").to_numpy()
        # of the last anchor, the last row waits for the next batch
        again = t.column("known").to_numpy().copy()
        same = a[1:] == a[:-1]
        again[1:] |= same
        again[:-1] |= same
        if rest is not None and rest.num_rows and rest_known:
            again[0] = True
        rest, rest_known = t.slice(len(a) - 1), bool(again[-1])
        yield from t.slice(0, len(a) - 1).filter(pa.array(again[:-1])).select(["id", "digest", "pos"]).to_batches()
    if rest is not None and rest_known:
        yield from rest.select(["id", "digest", "pos"]).to_batches()


_CONTEXT = "part int, anchor long, id long, digest long, first int, words binary, last int, ref long"


def _contexts(parts: int, least: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offs in W.blocks(batch, "text"):
                h, _, _, bound = W.words(data, offs, W.VISIBLE, False)
                g = W.mix(gram_hashes(h, k))
                small = h.astype(np.uint32)
                ids, digests = rows.column(0).to_numpy(), rows.column(1).to_numpy()
                place = rows.column(3)
                found = []  # anchor, id, digest, first word, words, whether the anchor occurs in it more than once
                for i in range(rows.num_rows):
                    a, b = int(bound[i]), int(bound[i + 1])
                    pos = np.unique(np.asarray(place[i].values.to_numpy(), np.int64))
                    lo, hi = np.maximum(pos - (least - k), 0), np.minimum(pos + least, b - a)
                    open_: dict = {}
                    for key, x, y in zip(g[pos + a].tolist(), lo.tolist(), hi.tolist()):
                        was = open_.get(key)
                        if was is not None and x < was[1]:
                            was[1:] = y, True
                            continue
                        if was is not None:
                            found.append((key, int(ids[i]), int(digests[i]), was[0], small[a + was[0] : a + was[1]].tobytes(), was[2]))
                        open_[key] = [x, y, False]
                    for key, (x, y, joined) in open_.items():
                        found.append((key, int(ids[i]), int(digests[i]), x, small[a + x : a + y].tobytes(), joined))
                found.sort()
                cols: list[list] = [[] for _ in range(8)]
                seen: dict = {}
                for key, i, d, x, w, joined in found:
                    first = seen.setdefault((key, w), (i, d, x))
                    span = first != (i, d, x)
                    if span and len(w) < 4 * least:
                        continue
                    signed = key - (1 << 64) if key >> 63 else key
                    part = (i ^ d) % parts if span else (key >> 33) * parts >> 31
                    for c, v in zip(cols, (part, signed, i, d, x, None if span else w, x + len(w) // 4, first[0] if span else int(joined))):
                        c.append(v)
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["part", "anchor", "id", "digest", "first", "words", "last", "ref"])

    return run


def _match(least: int):
    """Rows by (anchor, id, digest, first): the spans of each context that occur in an earlier one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, before, seen, waiting, auto = None, None, {}, None, None
        for batch in batches:
            out: list[tuple] = []
            anchor, ids, dg, first, words, last, ref = (batch.column(c).to_pylist() for c in range(1, 8))
            for a, i, d, x, w, y, r in zip(anchor, ids, dg, first, words, last, ref):
                if w is None:
                    out.append((i, d, x, y, r))
                    continue
                if a != now:
                    now, before, seen, waiting, auto = a, None, {}, None, None
                if (i, d, x) == before:
                    continue
                before = (i, d, x)
                owner = seen.get(w)
                if owner is not None:
                    if len(w) >= 4 * least:
                        out.append((i, d, x, x + len(w) // 4, owner))
                    continue
                seen[w] = i
                s = np.frombuffer(w, np.uint32).tolist()
                if auto is None:
                    if waiting is None and not r:
                        waiting = (s, i)  # alone and without a repeat of its own, a context needs no automaton
                        continue
                    auto = Automaton()
                    if waiting is not None:
                        auto.add(*waiting)
                out += [(i, d, x + p, x + q, o) for p, q, o in spans_of(auto.add(s, i), least)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[c] for o in out], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()))], names=["id", "digest", "s", "e", "ref"]
            )

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by (id, digest, s, e): overlapping and touching spans of a document become one."""
    key, s, e, ref = None, 0, 0, None
    for batch in batches:
        out = []
        for i, d, a, b, r in zip(*(c.to_pylist() for c in batch.columns)):
            if key == (i, d) and a <= e:
                e = max(e, b)
                continue
            if key is not None:
                out.append((*key, s, e, ref))
            key, s, e, ref = (i, d), a, b, r
        yield _span_batch(out)
    if key is not None:
        yield _span_batch([(*key, s, e, ref)])


def _span_batch(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([o[c] for o in out], pa.int64()) for c in range(5)], names=["id", "digest", "start_word", "end_word", "first_id"]
    )


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, gram: int = GRAM, partitions: int | None = None) -> DataFrame:
    """(id_col, digest, start_word, end_word, first_id): the maximal spans of words to remove.

    end_word is exclusive; first_id is a document that holds the start of the span earlier (it may
    be the same one). digest is xxhash64 of the text; repeated rows are one document, different
    texts under one id are told apart by it. Ids may be of any type; those that aren't whole numbers
    are ordered by a hash. Rows without an id take no part; null, empty and short texts have no
    window, very long ones are read whole. Other columns are ignored, and an empty table gives an
    empty table. partitions is the number of shards; by default it follows the size of docs.
    """
    parts = partitions or K.partitions_for(docs, 1.5)
    rows = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(
        K.key_of(docs, id_col).alias("id"), F.xxhash64(text_col).alias("digest"), F.col(text_col).alias("text")
    )
    elected = rows.mapInArrow(_anchor_rows(parts, min_words, gram), "part int, anchor long, id long, digest long, pos int, known boolean")
    ranged = elected.repartitionById(parts, F.col("part")).sortWithinPartitions("anchor")
    places = ranged.mapInArrow(_repeated, "id long, digest long, pos int").groupBy("id", "digest").agg(F.collect_list("pos").alias("places"))
    hit = rows.join(places.hint("shuffle_hash"), ["id", "digest"]).select("id", "digest", "text", "places")
    contexts = hit.mapInArrow(_contexts(parts, min_words, gram), _CONTEXT)
    shards = contexts.repartitionById(parts, F.col("part")).sortWithinPartitions("anchor", "id", "digest", "first")
    spans = shards.mapInArrow(_match(min_words), "id long, digest long, s int, e int, ref long")
    merged = spans.repartition(parts, "id", "digest").sortWithinPartitions("id", "digest", "s", "e")
    out = merged.mapInArrow(_merge, "id long, digest long, start_word long, end_word long, first_id long")
    return K.restore(out, docs, id_col, "id", "first_id").withColumnRenamed("id", id_col)


def reference_shards(reference: DataFrame, id_col: str, text_col: str, shard_bytes: int = SHARD_BYTES) -> Iterator[list[tuple[object, bytes]]]:
    """The texts of a reference table, some shard_bytes at a time, in the order of their ids."""
    rows = reference.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).distinct().orderBy("i", "t")
    shard, size = [], 0
    for r in rows.toLocalIterator():
        shard.append((r["i"], r["t"].encode()))
        size += len(shard[-1][1])
        if size >= shard_bytes:
            yield shard
            shard, size = [], 0
    if shard:
        yield shard


def spans_in(
    docs: DataFrame,
    reference: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    ref_id_col: str = "doc_id",
    ref_text_col: str = "text",
    min_words: int = MIN_WORDS,
    shard_bytes: int = SHARD_BYTES,
    reference_bytes: int = REFERENCE_BYTES,
) -> DataFrame:
    """(id_col, digest, start_word, end_word, first_id): the maximal spans of docs that a text of reference holds.

    The suffix automaton of each shard of the reference is broadcast and every document streams past
    it, so the work is that of docs times the shards: for references of a known size. One of more than
    reference_bytes raises ValueError; repeated_spans() is the way for those. Nulls, repeats and other
    columns are treated as by repeated_spans(); first_id is the first text of the first shard that
    holds the start of a span.
    """
    size = reference.where(F.col(ref_id_col).isNotNull()).agg(F.sum(F.octet_length(ref_text_col))).first()[0] or 0
    if size > reference_bytes:
        raise ValueError(f"the reference has {size} bytes, more than {reference_bytes}")
    kind, ref_kind = docs.schema[id_col].dataType.simpleString(), reference.schema[ref_id_col].dataType.simpleString()
    ref_type = to_arrow_type(reference.schema[ref_id_col].dataType)
    schema = f"`{id_col}` {kind}, digest long, s long, e long, shard int, first_id {ref_kind}"
    rows = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col), F.xxhash64(text_col).alias("digest"), F.col(text_col).alias("text")).distinct()

    def runner(shared, number):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            auto = Automaton()
            for owner, raw in shared.value:
                auto.add(W.words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), W.VISIBLE, False)[0].tolist(), owner)
            for batch in batches:
                for part, data, offs in W.blocks(batch, "text"):
                    h, _, _, bound = W.words(data, offs, W.VISIBLE, False)
                    found = [(i, *span) for i in range(part.num_rows) if bound[i + 1] - bound[i] >= min_words for span in spans_of(auto.match(h[bound[i] : bound[i + 1]].tolist()), min_words)]
                    at = pa.array([f[0] for f in found], pa.int64())
                    columns = [part.column(0).take(at), part.column(1).take(at), *(pa.array([f[c] for f in found], pa.int64()) for c in (1, 2))]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array([number] * len(found), pa.int32()), pa.array([f[3] for f in found], ref_type)], names=[id_col, "digest", "s", "e", "shard", "first_id"])

        return run

    found = None
    for number, shard in enumerate(reference_shards(reference, ref_id_col, ref_text_col, shard_bytes)):
        part = rows.mapInArrow(runner(docs.sparkSession.sparkContext.broadcast(shard), number), schema)
        found = part if found is None else found.unionAll(part)
    if found is None:
        found = docs.sparkSession.createDataFrame([], schema)
    # spans of several shards that overlap or touch become one
    by = Window.partitionBy(id_col, "digest").orderBy("s", "e", "shard")
    new = F.coalesce((F.col("s") > F.max("e").over(by.rowsBetween(Window.unboundedPreceding, -1))).cast("int"), F.lit(1))
    merged = found.withColumn("new", new).withColumn("span", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    out = merged.groupBy(id_col, "digest", "span").agg(F.min("s").alias("start_word"), F.max("e").alias("end_word"), F.min(F.struct("s", "shard", "first_id")).alias("m"))
    return out.select(id_col, "digest", "start_word", "end_word", F.col("m.first_id").alias("first_id"))


def remove_spans(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the words of spans, and the white space after them, cut from text_col; columns stay.

    spans is a table of repeated_spans() or spans_in(). Rows that repeat are cut alike; rows without
    an id, null texts and texts without a span stay as they are; a text may become empty; an empty
    table gives an empty table.
    """
    key, digest, found, new = W.free_names(docs.columns, "__id", "__digest", "__spans", "__text")
    cut = spans.groupBy(K.key_of(spans, id_col).alias(key), F.col("digest").alias(digest)).agg(F.sort_array(F.collect_list(F.struct("start_word", "end_word"))).alias(found))
    left = docs.withColumns({key: K.key_of(docs, id_col), digest: F.xxhash64(text_col)})
    joined = left.join(cut.hint("shuffle_hash"), [key, digest], "left")

    @F.pandas_udf("string")
    def thin(texts, lists):
        out = []
        for t, spans_ in zip(texts, lists):
            if spans_ is None:
                out.append(t)
                continue
            raw = t.encode()
            data, offs = np.frombuffer(raw, np.uint8), np.array([0, len(raw)])
            s, _ = W.word_spans(data, offs, W.VISIBLE)
            s = np.append(s, len(raw))
            keep, at = [], 0
            for span in spans_:
                keep.append(raw[at : s[span["start_word"]]])
                at = s[span["end_word"]]
            out.append((b"".join(keep) + raw[at:]).decode())
        return texts.__class__(out, dtype=object)

    text = F.when(F.col(found).isNotNull(), thin(F.col(text_col), F.col(found))).otherwise(F.col(text_col))
    return joined.withColumn(new, text).select([F.col(new).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
