"""Byte-level BPE: sub-word pieces and their numbers by a vocabulary file of ranks."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LOADED: dict = {}
AT_ONCE = 500_000


def printable() -> list[str]:
    """A visible character for each byte: itself where it is one, else the next free one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def _load(path: str):
    if path not in _LOADED:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        signs = printable()
        names = {rank: "".join(signs[b] for b in token) for token, rank in ranks.items()}
        _LOADED[path] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), names
    return _LOADED[path]


def bpe_ids(text: Column, vocabulary: str) -> Column:
    """The numbers of a text's pieces; null for a null text. The vocabulary's path must be readable on every executor."""

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder, _ = _load(vocabulary)
        for s in batches:
            yield pd.Series([None if t is None else encoder.encode_ordinary(t) for t in s], dtype=object)

    return run(text)


def bpe_pieces(text: Column, vocabulary: str) -> Column:
    """The pieces of a text, each of visible characters, as a language model's training text has them; null for a null text."""

    @F.arrow_udf("array<string>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder, names = _load(vocabulary)
        shown = pa.array([names.get(k, "") for k in range(max(names) + 1)], pa.string())
        for texts in batches:
            # pieces leave in parts of some AT_ONCE and never are Python strings
            ranks, sizes, total = [], [], 0
            for t in texts:
                found = encoder.encode_ordinary(t.as_py()) if t.is_valid else None
                sizes.append(None if found is None else len(found))
                if found:
                    ranks.append(np.array(found, np.int32))
                    total += len(found)
                if total >= AT_ONCE:
                    yield _lists(shown, ranks, sizes)
                    ranks, sizes, total = [], [], 0
            if sizes or not len(texts):
                yield _lists(shown, ranks, sizes)

    return run(text)


def _lists(shown: pa.Array, ranks: list[np.ndarray], sizes: list[int | None]) -> pa.Array:
    flat = shown.take(pa.array(np.concatenate(ranks) if ranks else [], pa.int32()))
    ends = np.cumsum([0, *(n or 0 for n in sizes)])
    starts = [None if n is None else int(e) for n, e in zip(sizes, ends)]
    return pa.ListArray.from_arrays(pa.array([*starts, int(ends[-1])], pa.int32()), flat)
