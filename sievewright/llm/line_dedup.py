"""Exact line deduplication across a corpus, answered with one compressed bitmap per document.

Lines are compared byte for byte after ASCII white space is stripped from both ends. Of equal
lines the first by (document id, text digest, position) is kept. Blank lines are always kept.

Plan: hash the lines where they are read; range-partition the 128-bit hashes (they are uniform,
so the splitters are known without sampling); sort each range by hash, document and position;
stream it and mark first occurrences; shuffle the marks, never the text, back to their documents.
A line that an equal line precedes within the same block of rows can't be a first occurrence: it
goes straight to its document's partition. Lines that repeat within a block are remembered for the
rest of the task, so that of a line that half the corpus shares a task sends some rows to the range
of its hash (each earlier than the one before), not one for each document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.llm import keys as K
from sievewright.llm import words as W

NO_ID = -(1 << 63)
_MARKS = "part int, id long, digest long, pos int, state byte, h0 long, h1 long"
CANDIDATE, KEPT, DROPPED = 0, 1, 2
REMEMBERED = 1 << 18  # repeated lines that a task remembers; more are only sent more often


def line_table(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, position, start, end) of every line of a block, stripped; start = end for a blank one."""
    nl = np.flatnonzero(data == 10)
    of = np.searchsorted(offs, nl, "right") - 1
    n = len(offs) - 1
    doc = np.concatenate([np.arange(n), of])
    start = np.concatenate([offs[:-1], nl + 1])
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    last = np.append(doc[1:] != doc[:-1], True) if n else np.zeros(0, bool)
    end = np.where(last, offs[doc + 1], np.append(start[1:] - 1, 0)) if n else start
    first_of = np.searchsorted(doc, np.arange(n))
    pos = np.arange(len(doc)) - first_of[doc]
    s, e = W.word_spans(data, offs, W.VISIBLE)
    i, j = np.searchsorted(s, start), np.searchsorted(s, end)
    some = j > i
    lo, hi = start.copy(), start.copy()
    lo[some], hi[some] = s[i[some]], e[j[some] - 1]
    return doc, pos, lo, hi


def _hash_lines(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot: dict[tuple[int, int], tuple[int, int, int]] = {}  # repeated line -> the earliest place sent so far
        for batch in batches:
            for rows, data, offs in W.blocks(batch, "text"):
                ids = rows.column(0).to_numpy()
                digests = rows.column(1).to_numpy()
                doc, pos, s, e = line_table(data, offs)
                h0 = W.word_hashes(data, s, e, 1).view(np.int64)
                h1 = W.word_hashes(data, s, e, 2).view(np.int64)
                state = np.where(s == e, KEPT, CANDIDATE).astype(np.int8)
                of, dg = ids[doc], digests[doc]
                order = np.lexsort((pos, dg, of, h1, h0))
                a, b = order[1:], order[:-1]
                again = (h0[a] == h0[b]) & (h1[a] == h1[b]) & (state[a] == CANDIDATE)
                # a row repeated as a whole is the same occurrence, not a later one
                same = again & (of[a] == of[b]) & (dg[a] == dg[b]) & (pos[a] == pos[b])
                lead = np.ones(len(order), np.int64)
                lead[1:] = ~(again & same)
                fresh = np.append(True, ~again) if len(order) else np.zeros(0, bool)
                # within a run of equal hashes everything after the first distinct occurrence goes
                run_id = np.cumsum(fresh)
                nth = np.cumsum(lead)
                first_nth = nth[np.flatnonzero(fresh)][run_id - 1] if len(order) else nth
                late = order[nth > first_nth]
                repeated = np.bincount(run_id - 1, nth > first_nth)[run_id - 1] > 0 if len(order) else nth > 0
                state[late] = np.where(state[late] == CANDIDATE, DROPPED, state[late])
                sent = order[(nth == first_nth) & (state[order] == CANDIDATE)] if len(order) else order
                ask = np.isin(h0[sent], np.fromiter((k[0] for k in hot), np.int64, len(hot))) if hot else np.zeros(len(sent), bool)
                for k in sent[ask].tolist():
                    key, place = (int(h0[k]), int(h1[k])), (int(of[k]), int(dg[k]), int(pos[k]))
                    if key in hot and hot[key] < place:
                        state[k] = DROPPED
                    elif key in hot:
                        hot[key] = place
                if len(hot) < REMEMBERED:
                    for k in order[repeated & (nth == first_nth) & (state[order] == CANDIDATE)].tolist():
                        hot[int(h0[k]), int(h1[k])] = (int(of[k]), int(dg[k]), int(pos[k]))
                sure = state != CANDIDATE
                span = ((h0.view(np.uint64) >> np.uint64(33)).astype(np.int64) * parts) >> 31
                part = np.where(sure, (W.mix(of.astype(np.uint64)) % np.uint64(parts)).astype(np.int64), span)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(part.astype(np.int32)),
                        pa.array(of),
                        pa.array(dg),
                        pa.array(pos.astype(np.int32)),
                        pa.array(state),
                        pa.array(np.where(sure, 0, h0)),
                        pa.array(np.where(sure, 0, h1)),
                    ],
                    names=["part", "id", "digest", "pos", "state", "h0", "h1"],
                )

    return run


def _stream_firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by (state, h0, h1, id, digest, pos): a hash's first occurrence is kept, with its whole-row repeats."""
    seen = None  # the key and the place of the last hash's first occurrence
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, ids, dg, pos, state, h0, h1 = (c.to_numpy() for c in batch.columns)
        key = np.stack([h0, h1, ids, dg, pos.astype(np.int64)], 1)
        cand = state == CANDIDATE
        new = np.ones(len(key), bool)
        new[1:] = (key[1:, :2] != key[:-1, :2]).any(1)
        if seen is not None:
            new[0] = not np.array_equal(key[0, :2], seen[:2])
        at = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
        first = key[np.maximum(at, 0)]
        if seen is not None:
            first[at < 0] = seen
        kept = np.where(cand, (key == first).all(1), state == KEPT)
        if cand[-1]:
            seen = first[-1]
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(dg), pa.array(pos), pa.array(kept)], names=["id", "digest", "pos", "kept"])


def encode_runs(kept: np.ndarray) -> str:
    """Run lengths of a bitmap, first those kept, in turn kept and dropped: 1110110 is 3,1,2,1."""
    if len(kept) == 0:
        return ""
    r = np.diff(W.runs(kept)).tolist()
    return ",".join(map(str, r if kept[0] else [0, *r]))


def decode_runs(text: str) -> np.ndarray:
    lengths = np.array([int(x) for x in text.split(",")] if text else [], np.int64)
    return np.repeat(np.arange(len(lengths)) % 2 == 0, lengths)


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by (id, digest, pos); a document may go on in the next batch."""
    rest = None

    def emit(ids, dg, pos, kept):
        key = np.flatnonzero((ids[1:] != ids[:-1]) | (dg[1:] != dg[:-1])) + 1
        cut = np.concatenate([[0], key, [len(ids)]])
        out = []
        for a, b in zip(cut[:-1], cut[1:]):
            bits = np.zeros(int(pos[b - 1]) + 1, bool)
            bits[pos[a:b][kept[a:b]]] = True
            out.append((int(ids[a]), int(dg[a]), len(bits), int(bits.sum()), encode_runs(bits)))
        cols = list(zip(*out))
        return pa.RecordBatch.from_arrays(
            [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.string())],
            names=["id", "digest", "n_lines", "n_kept", "keep_bitmap"],
        )

    for batch in batches:
        if batch.num_rows == 0:
            continue
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if rest is not None:
            cols = [np.concatenate([a, b]) for a, b in zip(rest, cols)]
        ids, dg = cols[0], cols[1]
        last = (ids == ids[-1]) & (dg == dg[-1])
        k = int(np.argmax(last))
        rest = [c[k:] for c in cols]
        if k:
            yield emit(*(c[:k] for c in cols))
    if rest is not None:
        yield emit(*rest)


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """(id_col, digest, n_lines, n_kept, keep_bitmap): one row for each distinct (id, text).

    keep_bitmap is run-length coded (encode_runs); digest is xxhash64 of the text, which tells
    apart different texts under one id. A null text counts as an empty one: a single blank line,
    kept. A null id counts as the least id. Ids may be of any type; those that aren't whole numbers
    are ordered by a hash. Rows repeated as a whole count once. Very long texts are read whole. Other
    columns are ignored. An empty table gives an empty table.

    partitions is the number of hash ranges; by default it follows the size of docs.
    """
    parts = partitions or K.partitions_for(docs, 0.5)
    rows = docs.select(
        F.coalesce(K.key_of(docs, id_col), F.lit(NO_ID)).alias("id"),
        F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("digest"),
        F.coalesce(text_col, F.lit("")).alias("text"),
    )
    marks = rows.mapInArrow(_hash_lines(parts), _MARKS)
    ranged = marks.repartitionById(parts, F.col("part")).sortWithinPartitions("state", "h0", "h1", "id", "digest", "pos")
    firsts = ranged.mapInArrow(_stream_firsts, "id long, digest long, pos int, kept boolean")
    per_doc = firsts.repartition(parts, "id", "digest").sortWithinPartitions("id", "digest", "pos")
    out = per_doc.mapInArrow(_bitmaps, "id long, digest long, n_lines long, n_kept long, keep_bitmap string")
    out = out.select(F.nullif("id", F.lit(NO_ID)).alias("id"), "digest", "n_lines", "n_kept", "keep_bitmap")
    return K.restore(out, docs, id_col, "id").withColumnRenamed("id", id_col)


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with only the kept lines in text_col; a document of which no visible line is left goes.

    Columns and their order stay. A text that was null or blank already stays as it is. Rows that
    repeat are all cut alike, rows without a bitmap stay; an empty table gives an empty table.
    """
    key, digest, bitmap, new = W.free_names(docs.columns, "__id", "__digest", "__bitmap", "__text")
    drop = bitmaps.where("n_kept < n_lines").select(
        F.coalesce(K.key_of(bitmaps, id_col), F.lit(NO_ID)).alias(key), F.col("digest").alias(digest), F.col("keep_bitmap").alias(bitmap)
    )
    left = docs.withColumns({key: F.coalesce(K.key_of(docs, id_col), F.lit(NO_ID)), digest: F.xxhash64(F.coalesce(text_col, F.lit("")))})
    joined = left.join(drop.hint("shuffle_hash"), [key, digest], "left")

    @F.pandas_udf("string")
    def thin(texts, maps):
        out = []
        for t, m in zip(texts, maps):
            if m is None:
                out.append(t)
                continue
            kept = decode_runs(m)
            out.append("\n".join(line for line, k in zip(t.split("\n"), kept) if k))
        return texts.__class__(out, dtype=object)

    changed = F.col(bitmap).isNotNull()
    text = F.when(changed, thin(F.col(text_col), F.col(bitmap))).otherwise(F.col(text_col))
    # white space of these kinds alone is what the line hashes call blank
    return (
        joined.withColumn(new, text)
        .where(~changed | F.col(new).rlike(r"[^ \t\n\x0B\f\r]"))
        .select([F.col(new).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
    )
