"""MinHash signatures, LSH bands and the joins on them.

The hash family: a token's hash is the first four bytes of its SHA-1, and permutation (a, b) maps it
to ((hash * a + b) mod 2**64) mod (2**61 - 1), low 32 bits. Signatures are computed by NumPy over
Arrow batches; everything after them is an equi-join or aggregation on (band, key).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.functions.text import NOT_WORD

try:  # for a few bytes the interpreter's own SHA-1 takes a fraction of what OpenSSL's does
    from _sha1 import sha1
except ImportError:
    from hashlib import sha1

PRIME = np.uint64((1 << 61) - 1)
TOP = np.uint64((1 << 32) - 1)
_SPLIT = re.compile(NOT_WORD)
#: Hashes of a block, token hashes that a task remembers, signatures of a batch, and hashes from which one leaves.
BLOCK, KNOWN, SIGNED, HASHED = 128, 100_000, 1000, 500_000


def permutations(n: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """n pairs, drawn in turn from one generator."""
    rng = np.random.RandomState(seed)
    pairs = np.array([(rng.randint(1, int(PRIME), dtype=np.uint64), rng.randint(0, int(PRIME), dtype=np.uint64)) for _ in range(n)], np.uint64)
    return pairs[:, 0].copy(), pairs[:, 1].copy()


def signature(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least value of each permutation over a token set; all 2**32 - 1 for an empty one."""
    return least_values([hashes], a, b)[0]


def least_values(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """signature() of each set. Blocks of BLOCK hashes, of one long set or of many short ones, stay in the processor's cache."""
    best = np.full((len(sets), len(a)), TOP, np.uint64)
    if not sets:
        return best
    sizes = np.array([len(s) for s in sets])
    hashes, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    x, high = np.empty((2, BLOCK, len(a)), np.uint64)
    for k in range(0, len(hashes), BLOCK):
        h = hashes[k : k + BLOCK, None]
        x, high = x[: len(h)], high[: len(h)]
        np.multiply(h, a, out=x)
        x += b
        np.right_shift(x, np.uint64(61), out=high)
        x &= PRIME
        x += high
        if (x >= PRIME).any():
            x -= np.where(x >= PRIME, PRIME, np.uint64(0))
        x &= TOP
        whose = of[k : k + BLOCK]
        if whose[0] == whose[-1]:
            np.minimum(best[whose[0]], x.min(0), out=best[whose[0]])
        else:
            starts = np.flatnonzero(np.diff(whose, prepend=-1))
            there = whose[starts]
            best[there] = np.minimum(best[there], np.minimum.reduceat(x, starts, axis=0))
    return best


def best_banding(threshold: float, num_perm: int, fp_weight: float = 0.5, fn_weight: float = 0.5) -> tuple[int, int]:
    """(bands, rows) with the least weighted area of false positives below and false negatives above the threshold."""
    x, w = np.polynomial.legendre.leggauss(64)
    below, above = threshold * (x + 1) / 2, threshold + (1 - threshold) * (x + 1) / 2
    best, choice = np.inf, (1, 1)
    for bands in range(1, num_perm + 1):
        for rows in range(1, num_perm // bands + 1):
            fp = (w * (1 - (1 - below**rows) ** bands)).sum() * threshold / 2
            fn = (w * (1 - above**rows) ** bands).sum() * (1 - threshold) / 2
            if fp_weight * fp + fn_weight * fn < best - 1e-12:
                best, choice = fp_weight * fp + fn_weight * fn, (bands, rows)
    return choice


def token_hashes(text: str, ngram: int, known: dict[str, bytes] | None = None) -> np.ndarray:
    """SHA-1 hashes of the distinct tokens (ngram 1, empty ones dropped) or of the distinct word n-grams (empty tokens kept).

    Single tokens come back again and again, so `known` may hold their hashes.
    """
    words = _SPLIT.split(text)
    if ngram == 1:
        known = {} if known is None else known
        if len(known) > KNOWN:
            known.clear()
        return np.frombuffer(b"".join(known.get(w) or known.setdefault(w, sha1(w.encode()).digest()[:4]) for w in {w for w in words if w}), "<u4").astype(np.uint64)
    grams = {" ".join(words[i : i + ngram]) for i in range(len(words) - ngram + 1)}
    return np.frombuffer(b"".join([sha1(g.encode()).digest()[:4] for g in grams]), "<u4").astype(np.uint64)


def signatures(docs: DataFrame, id_col: str, text_col: str, num_perm: int = 256, ngram: int = 5, min_tokens: int = 0, seed: int = 42) -> DataFrame:
    """(id, signature) of every document with at least min_tokens tokens, repeats counted. Null texts and ids have none.

    Texts leave their Arrow batch one by one, and signatures leave by some SIGNED, or as soon as there are HASHED hashes.
    """
    a, b = permutations(num_perm, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, bytes] = {}

        def signed(ids: pa.Array, sets: list[np.ndarray]) -> pa.RecordBatch:
            values = pa.array(least_values(sets, a, b).astype(np.int64).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * num_perm), values)
            return pa.RecordBatch.from_arrays([ids, lists], names=["id", "signature"])

        for batch in batches:
            rows, sets, size = [], [], 0
            for i, t in enumerate(batch.column(1)):
                t = t.as_py()
                if min_tokens and sum(1 for w in _SPLIT.split(t) if w) < min_tokens:
                    continue
                rows.append(i)
                sets.append(token_hashes(t, ngram, known))
                size += len(sets[-1])
                if len(sets) >= SIGNED or size >= HASHED:
                    yield signed(batch.column(0).take(pa.array(rows)), sets)
                    rows, sets, size = [], [], 0
            if sets:
                yield signed(batch.column(0).take(pa.array(rows)), sets)

    rows = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, signature array<bigint>")


def _slices(signed: DataFrame, n_bands: int, rows: int) -> DataFrame:
    """(id, band, values)"""
    parts = F.transform(F.sequence(F.lit(0), F.lit(n_bands - 1)), lambda k: F.slice("signature", k * rows + 1, F.lit(rows)))
    return signed.select("id", F.posexplode(parts).alias("band", "values"))


def bands(signed: DataFrame, n_bands: int, rows: int, among: DataFrame | None = None, broadcast_rows: int = 200_000) -> DataFrame:
    """(id, band, key): a row for each band of every signature; the key is a 128-bit digest of the band.

    With `among`, other signatures, bands that none of them has may be left out: a 64-bit hash, which takes a
    fraction of the digest's time, tells most of them. Beyond broadcast_rows bands of `among` all stay.
    """
    if among is not None:
        quick = F.xxhash64("band", "values").alias("quick")
        asked = _slices(among, n_bands, rows).select(quick).distinct()
        if asked.count() <= broadcast_rows:
            close = _slices(signed, n_bands, rows).withColumn("quick", quick).join(F.broadcast(asked), "quick", "left_semi")
            return close.select("id", "band", F.md5(F.array_join("values", ",")).alias("key"))
    pieces = F.transform(F.sequence(F.lit(0), F.lit(n_bands - 1)), lambda k: F.md5(F.array_join(F.slice("signature", k * rows + 1, F.lit(rows)), ",")))
    return signed.select("id", F.posexplode(pieces).alias("band", "key"))


def star_edges(banded: DataFrame) -> DataFrame:
    """(src, dst): every member of a bucket tied to the bucket's least id.

    A bucket of n documents gives n - 1 edges and not n * n pairs. The least ids are an aggregation
    with map-side combine and come back by an equi-join, which AQE can split where a bucket is hot.
    """
    least = banded.groupBy("band", "key").agg(F.min("id").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    return banded.join(least, ["band", "key"]).where("id <> least").select(F.col("least").alias("src"), F.col("id").alias("dst")).distinct()


def candidate_pairs(banded: DataFrame) -> DataFrame:
    """All (a, b), a < b, that share a bucket."""
    left, right = banded.withColumnRenamed("id", "a"), banded.withColumnRenamed("id", "b")
    return left.join(right, ["band", "key"]).where("a < b").select("a", "b").distinct()


def benchmark_candidates(corpus: DataFrame, benchmark: DataFrame, broadcast_rows: int = 200_000) -> DataFrame:
    """(id, item): documents and benchmark items that share a bucket. The benchmark side is broadcast up to broadcast_rows rows of some 100 bytes each."""
    items = benchmark.select(F.col("id").alias("item"), "band", "key")
    items = F.broadcast(items) if items.count() <= broadcast_rows else items
    return corpus.join(items, ["band", "key"]).select("id", "item").distinct()
