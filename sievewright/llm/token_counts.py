"""Token counts of documents of any length by a byte-level BPE, exact although long texts are encoded in chunks.

A text longer than `chunk` bytes is encoded in chunks that overlap. The token boundaries of two
neighbouring chunks are compared within their overlap, and the texts' encodings are spliced at a
boundary that both have and that is proven stable: the pre-tokenising pattern can't match across it
whatever stands around it, so the encoding before it and the one after it don't depend on each
other. When an overlap holds no such boundary it is doubled, in the end to the whole of what isn't
yet spliced, which is then encoded at once with twice its length.

A boundary is stable between a letter and anything but a letter, between a digit and anything but a
digit, and between a visible character and white space: no alternative of PATTERN has a letter, a
digit or a visible character followed by one of another kind.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CHUNK, OVERLAP = 1 << 16, 256
_LOADED: dict = {}


def load(path: str) -> tuple[Callable[[str], list[int]], np.ndarray]:
    """(encode, bytes of each token) of a vocabulary file of ranks; once per process."""
    if path not in _LOADED:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        size = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, k in ranks.items():
            size[k] = len(token)
        _LOADED[path] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary, size
    return _LOADED[path]


def _kind(c: str) -> str:
    if c.isspace():
        return "s"
    k = unicodedata.category(c)[0]
    return k if k in "LN" else "o"


def stable(raw: bytes, p: int) -> bool:
    """Whether a pre-token always ends at byte p of a text."""
    if not 0 < p < len(raw) or raw[p] & 0xC0 == 0x80:
        return False
    a = p - 1
    while a > 0 and raw[a] & 0xC0 == 0x80:
        a -= 1
    before, after = _kind(raw[a:p].decode()), _kind(raw[p : p + 4].decode(errors="ignore")[:1])
    # separators of the C category are white space to some regex engines and not to others
    if unicodedata.category(raw[a:p].decode()) == "Cc" or (after == "s" and raw[p] in range(0x1C, 0x20)):
        return False
    return before in "LN" and after != before or before == "o" and after == "s"


def _char(raw: bytes, p: int) -> int:
    """The first start of a character at or before p."""
    while 0 < p < len(raw) and raw[p] & 0xC0 == 0x80:
        p -= 1
    return p


def encode_long(raw: bytes, encode: Callable[[str], list[int]], size: np.ndarray, chunk: int = CHUNK, overlap: int = OVERLAP) -> Iterator[np.ndarray]:
    """The tokens of a text, in spliced pieces; size has the bytes of each token."""

    def tokens(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        ids = np.array(encode(raw[a:b].decode()), np.int64)
        return ids, a + np.cumsum(size[ids])

    n = len(raw)
    start, end = 0, _char(raw, min(n, chunk))  # of the part that isn't spliced
    ids, ends = tokens(start, end)
    while end < n:
        wide = overlap
        while True:
            a = _char(raw, max(end - wide, 0))
            if a <= start:
                # nothing stable in all of it: once more in one piece, twice as long
                end = _char(raw, min(n, max(start + 2 * (end - start), end + 4)))
                ids, ends = tokens(start, end)
                break
            b = _char(raw, min(n, end + chunk))
            more, more_ends = tokens(a, b)
            common = np.intersect1d(ends, more_ends)
            p = next((int(p) for p in common[::-1] if a < p < end and stable(raw, int(p))), None)
            if p is not None:
                yield ids[ends <= p]
                keep = more_ends > p
                ids, ends, start, end = more[keep], more_ends[keep], p, b
                break
            wide *= 2
    yield ids


def count_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(id_col, n_tokens, n_pieces) for every row of docs, repeated rows and null ids included.

    vocabulary is the path of a rank file that every executor can read. A null or empty text has 0
    tokens in 0 pieces. Strings that name special tokens are ordinary text. An empty table gives an
    empty table; other columns are ignored. One narrow pass, no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, size = load(vocabulary)
        for batch in batches:
            n, pieces = [], []
            for t in batch.column(1):
                t = t.as_py()
                if 4 * len(t) <= chunk or len(t.encode()) <= chunk:
                    n.append(len(encode(t)))
                    pieces.append(int(t != ""))
                else:
                    parts = [len(x) for x in encode_long(t.encode(), encode, size, chunk, overlap)]
                    n.append(sum(parts))
                    pieces.append(len(parts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(pieces, pa.int64())], names=[id_col, "n_tokens", "n_pieces"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col), F.coalesce(text_col, F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, n_pieces long")
