"""Vectorised tokenisation of Arrow string columns: no Python object per word or per text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)
_LONG = 512

FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32

#: Letters and digits of ASCII and every byte of a longer UTF-8 sequence.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True

#: Everything but ASCII white space.
VISIBLE = np.ones(256, bool)
VISIBLE[[9, 10, 11, 12, 13, 32]] = False


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    n = len(column)
    if n == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    o = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[o[0] : o[-1]], o - o[0]


def blocks(batch: pa.RecordBatch, text: str, size: int = 2 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Split a batch into runs of rows of about `size` bytes (one row at least), so that work stays in cache."""
    data, offs = text_buffers(batch.column(batch.schema.get_field_index(text)))
    i, n = 0, batch.num_rows
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + size, "right")) - 1)
        j = min(j, n, i + 60_000)
        yield batch.slice(i, j - i), data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def word_spans(data: np.ndarray, offs: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the maximal runs of kept bytes; a run never crosses from one text to the next."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    m = np.zeros(n + 2, bool)
    m[1:-1] = keep[data]
    start, end = m[1:-1] & ~m[:-2], m[1:-1] & ~m[2:]
    cut = offs[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    start[cut] = m[cut + 1]
    end[cut - 1] = m[cut]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _C2
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of every span's bytes, eight bytes a step over all words at once."""
    if len(s) == 0:
        return np.zeros(0, np.uint64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    view = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    length = e - s
    h = length.astype(np.uint64) * _C1 + np.uint64(seed)
    h = mix(h ^ (view[s] & _MASK[np.minimum(length, 8)]))
    rest, k = np.flatnonzero(length > 8), 8
    while rest.size and k < _LONG:
        left = length[rest] - k
        h[rest] = mix(h[rest] * _C1 ^ (view[s[rest] + k] & _MASK[np.minimum(left, 8)]))
        k += 8
        rest = rest[left > 8]
    for i in rest:
        h[i] = xxhash.xxh64_intdigest(data[s[i] : e[i]].tobytes(), seed)
    return h


def doc_bounds(starts: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Index of each text's first word, and the number of words at the end."""
    return np.searchsorted(starts, offs, "left")


def words(data: np.ndarray, offs: np.ndarray, keep: np.ndarray, folded: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end, bounds) of the words of a block; bounds[i]:bounds[i+1] are text i's."""
    if folded:
        data = fold(data)
    s, e = word_spans(data, offs, keep)
    return word_hashes(data, s, e), s, e, doc_bounds(s, offs)


def fold(data: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and of the Latin-1 letters (two-byte sequences that begin with C3)."""
    x = FOLD[data]
    i = np.flatnonzero(data[:-1] == 0xC3) + 1
    v = x[i]
    x[i] = np.where((v >= 0x80) & (v <= 0x9E) & (v != 0x97), v + 0x20, v)
    return x


def runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Start of every run of equal keys, and the length at the end."""
    n = len(sorted_keys)
    if n == 0:
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1]) + 1, [n]])


def free_names(columns: list[str], *names: str) -> list[str]:
    """The names, each with underscores added until no column is called so in any case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
