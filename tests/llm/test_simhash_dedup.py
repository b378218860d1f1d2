import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from sievewright.llm import simhash_dedup as S
from sievewright.llm import words as W


def corpus(n=300, seed=1):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 11))) for _ in range(6000)]
    texts = [[rng.choice(vocabulary) for _ in range(rng.randrange(40, 220))] for _ in range(n)]
    out = [" ".join(t) for t in texts]
    planted = []
    for k in range(0, min(n, 120), 3):
        copy = [w if rng.random() > 0.02 else rng.choice(vocabulary) for w in texts[k]]
        planted.append((k, len(out)))
        out.append(" ".join(copy))
    for k in range(1, min(n, 31), 3):
        planted.append((k, len(out)))
        out.append(out[k])
    return out, planted


def test_fingerprints_do_not_depend_on_the_block():
    texts, _ = corpus(40)
    data, offs = W.text_buffers(pa.array(texts))
    f0, f1, n = S.fingerprint_block(data, offs)
    for i, t in enumerate(texts):
        g0, g1, m = S.fingerprint_block(*W.text_buffers(pa.array([t])))
        assert (f0[i], f1[i], n[i]) == (g0[0], g1[0], m[0])


def test_segment_counts_bound_the_distance():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << 63, (200, 2), dtype=np.int64)
    b = a ^ (rng.integers(0, 1 << 63, (200, 2), dtype=np.int64) & rng.integers(0, 1 << 63, (200, 2), dtype=np.int64))
    hamming = np.bitwise_count((a ^ b).view(np.uint64)).sum(1)
    pairs = lambda x: np.unpackbits(x.view(np.uint8), axis=1, bitorder="little").reshape(200, 64, 2).sum(2).astype(int)
    manhattan = np.abs(pairs(a) - pairs(b)).sum(1)
    assert (manhattan <= hamming).all() and (manhattan < hamming).any()
    unary = sum(np.bitwise_count(S.embed(a[:, c].view(np.uint64)) ^ S.embed(b[:, c].view(np.uint64))) for c in (0, 1))
    assert unary.tolist() == manhattan.tolist()


def test_forest_joins_what_all_pairs_join():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 62, (6, 2), dtype=np.int64)
    f = np.repeat(base, 30, 0) ^ np.stack([np.int64(1) << rng.integers(0, 62, 180), np.int64(1) << rng.integers(0, 62, 180)], 1)
    edges = list(zip(*S.forest(f[:, 0].copy().view(np.uint64), f[:, 1].copy().view(np.uint64), 3)))
    root = list(range(180))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        assert np.bitwise_count((f[a] ^ f[b]).view(np.uint64)).sum() <= 3
        root[find(a)] = find(b)
    got = {frozenset(i for i in range(180) if find(i) == r) for r in map(find, range(180))}
    d = np.bitwise_count((f[:, None] ^ f[None]).view(np.uint64)).sum(2) <= 3
    want = set()
    for i in range(180):
        seen, todo = {i}, [i]
        while todo:
            for j in np.flatnonzero(d[todo.pop()]):
                if j not in seen:
                    seen.add(int(j))
                    todo.append(int(j))
        want.add(frozenset(seen))
    assert got == want


def test_recall_against_brute_force_and_clean_left_alone(docs_of):
    texts, planted = corpus()
    groups = {r["doc_id"]: r["group_id"] for r in S.near_duplicates(docs_of(list(enumerate(texts)))).collect()}
    f0, f1, _ = S.fingerprint_block(*W.text_buffers(pa.array(texts)))
    d = np.bitwise_count(f0[:, None] ^ f0[None]).astype(int) + np.bitwise_count(f1[:, None] ^ f1[None])
    pairs = [(i, j) for i, j in zip(*np.nonzero(np.triu(d <= S.MAX_DISTANCE, 1)))]
    found = [groups.get(i) is not None and groups.get(i) == groups.get(j) for i, j in pairs]
    assert np.mean(found) >= 0.99
    assert np.mean([groups.get(a) is not None and groups.get(a) == groups.get(b) for a, b in planted]) >= 0.95
    assert set(groups) <= {x for p in planted for x in p}


def test_edge_cases(docs_of):
    rows = [(1, None), (2, ""), (3, "?!"), (4, "one two"), (5, "one two"), (5, "one two"), (None, "one two"), (6, "word " * 50_000), (7, "word " * 3)]
    df = docs_of(rows).selectExpr("*", "1 AS id", "2 AS f0", "'a' AS component")
    out = sorted((r["doc_id"], r["group_id"], r["keep"]) for r in S.near_duplicates(df).collect())
    assert out == [(4, 4, True), (5, 4, False), (6, 6, True), (7, 6, False)]
    kept = S.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "3", "4", "6", "None"]
    assert S.near_duplicates(docs_of([])).count() == 0


def test_hot_group(docs_of):
    texts, _ = corpus(5)
    rng = random.Random(9)
    copies = []
    for i in range(400):
        w = texts[0].split()
        w[rng.randrange(len(w))] = f"changed{i}"
        copies.append((1000 + i, " ".join(w)))
    rows = list(enumerate(texts[:5])) + copies
    out = S.near_duplicates(docs_of(rows)).collect()
    assert {r["group_id"] for r in out} == {0} and len(out) == 401


@pytest.mark.parametrize("n", [10**5, 10**6, 10**7])
def test_pairs_up_to_the_greatest_distance_share_a_cell(n):
    s, tables = S.grid_plan(n, S.MAX_DISTANCE, S.RECALL)
    grid = S.Grid(s, tables, 11)
    rng = np.random.default_rng(n)
    for distance in (12, 16, 18, 20):
        bits = rng.integers(0, 2, (1500, 128), dtype=np.uint8)
        flips = np.argsort(rng.random((1500, 128)), 1)[:, :distance]
        other = bits.copy()
        np.put_along_axis(other, flips, 1 - np.take_along_axis(bits, flips, 1), 1)
        f = np.packbits(np.concatenate([bits, other]), axis=1).view(np.uint64)
        t = [S.embed(f[:, c].copy()) for c in (0, 1)]
        found = grid.first(t[0][:1500] ^ t[0][1500:], t[1][:1500] ^ t[1][1500:]) >= 0
        k = rng.integers(0, 1500, 50)
        cells = [[grid.cell(t[0][k + side], t[1][k + side], j) for j in range(tables)] for side in (0, 1500)]
        assert (np.equal(*cells).any(0) == found[k]).all()
        assert found.mean() >= 0.98, (distance, found.mean())
        assert abs(found.mean() - S.shared_cell(distance, s, tables)) < 0.03


def brute_links(texts, limit):
    """(groups as sets, links) of all pairs."""
    f0, f1, _ = S.fingerprint_block(*W.text_buffers(pa.array(texts)))
    d = np.bitwise_count(f0[:, None] ^ f0[None]).astype(int) + np.bitwise_count(f1[:, None] ^ f1[None])
    near = d <= limit
    classes = {}
    for i, f in enumerate(zip(f0, f1)):
        classes.setdefault(f, []).append(i)
    links = [len(classes[f0[i], f1[i]]) - 1 + sum(near[i, c[0]] for f, c in classes.items() if i not in c) for i in range(len(texts))]
    return near, links


@pytest.mark.parametrize("hot", [S.HOT, 40])
def test_links_and_hot_cells_against_all_pairs(docs_of, hot):
    """A group of near copies that shares every cell, in one piece and cut into blocks."""
    texts, _ = corpus(60)
    rng = random.Random(9)
    for i in range(150):
        w = texts[0].split()
        for _ in range(rng.randrange(1, 4)):
            w[rng.randrange(len(w))] = f"changed{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    texts += texts[:3] * 2
    near, links = brute_links(texts, S.MAX_DISTANCE)
    got = {r["doc_id"]: r for r in S.near_duplicates(docs_of(list(enumerate(texts))), hot=hot, recall=0.9999).collect()}
    assert {i: r["n_links"] for i, r in got.items()} == {i: k for i, k in enumerate(links) if k}
    assert all(r["group_id"] == got[j]["group_id"] for i, r in got.items() for j in np.flatnonzero(near[i]) if j != i)
    assert sum(r["keep"] for r in got.values()) == len({r["group_id"] for r in got.values()})


def test_ids_of_any_type(docs_of):
    rows = [(k, t) for k, t in enumerate(["a b c", "a b c", "something else here", "a b c"])]
    df = docs_of(rows).withColumn("doc_id", S.F.concat(S.F.lit("doc-"), "doc_id"))
    out = S.near_duplicates(df).collect()
    assert {r["doc_id"] for r in out} == {"doc-0", "doc-1", "doc-3"} and len({r["group_id"] for r in out}) == 1 and [r["n_links"] for r in out] == [2, 2, 2]
    assert [r["doc_id"] for r in out if r["keep"]] == [out[0]["group_id"]]
    assert sorted(r["doc_id"] for r in S.drop_near_duplicates(df).collect()) == sorted([out[0]["group_id"], "doc-2"])


def test_texts_that_differ_only_in_short_words_stay_apart(docs_of):
    rng = random.Random(5)
    labels = "invoice number customer address quantity delivery payment reference".split()
    short = lambda: " ".join("".join(rng.choice("0123456789abc") for _ in range(rng.randrange(2, 5))) for _ in range(8))
    rows = [(k, "\n".join(f"{label}: {short()}" for label in labels)) for k in range(20)]
    assert S.near_duplicates(docs_of(rows)).count() == 0


@pytest.mark.parametrize("n", [10**3, 10**5, 236_000, 10**7, 10**9, 5 * 10**10])
def test_no_pair_within_the_distance_misses_every_cell(n):
    """Random differences at the limit, and differences packed into neighbouring bits or few parts."""
    rng = np.random.default_rng(3)
    for distance in (1, 3, S.MAX_DISTANCE):
        grid = S.Grid(*S.grid_plan(n, distance), 11)
        flips = np.argsort(rng.random((20_000, 128)), 1)[:, :distance]
        flips[:5000] = (rng.integers(0, 128, (5000, 1)) + np.arange(distance)) % 128
        order = np.argsort(np.unpackbits(np.stack([grid.m0, grid.m1], 1).view(np.uint8), axis=1), axis=1)
        flips[5000:10_000] = order[rng.integers(0, len(order), 5000), -distance:]  # all in one mask
        bits = np.zeros((20_000, 128), np.uint8)
        np.put_along_axis(bits, flips, 1, 1)
        x = np.packbits(bits, axis=1).view(np.uint64)
        assert (grid.first(x[:, 0].copy(), x[:, 1].copy()) >= 0).all(), (n, distance)


@pytest.mark.parametrize("radius, bits", [(0, 6), (1, 14), (2, 17), (2, 3), (3, 12)])
def test_some_mask_misses_any_bits_that_differ(radius, bits):
    masks = S.covering(radius, bits)
    assert len(masks) == 2 ** (radius + 1) - 1
    for differ in combinations(range(bits), radius):
        assert (~masks[:, list(differ)].any(1)).any(), differ


def least_of_group(joined):
    """The least row that each row of a symmetric matrix is joined with, over any number of steps."""
    label, before = np.arange(len(joined)), None
    while before is None or (label != before).any():
        before, label = label, np.minimum(label, np.where(joined, label, len(joined)).min(1))
    return label


@pytest.mark.parametrize("hot", [S.HOT, 64])
def test_every_link_at_the_limit_is_counted(spark, hot):
    """Pairs of fingerprints exactly at the limit and one beyond it, and dense and loose groups: the same links as all pairs."""
    rng = np.random.default_rng(8)
    flipped = lambda bits, k: np.logical_xor(bits, np.argsort(np.argsort(rng.random(bits.shape), 1), 1) < k)
    lone = rng.integers(0, 2, (1500, 128)).astype(bool)
    sparse = np.repeat(rng.integers(0, 2, (40, 128)).astype(bool), 12, 0)
    dense = np.repeat(rng.integers(0, 2, (2, 128)).astype(bool), 120, 0)
    bits = np.concatenate([lone, flipped(lone, 20), flipped(lone[:500], 21), flipped(sparse, 10), flipped(dense, 6)])
    f = np.unique(np.packbits(bits, axis=1).view(np.uint64), axis=0)
    near = sum(np.bitwise_count(f[:, None, c] ^ f[None, :, c]).astype(int) for c in (0, 1)) <= 20
    np.fill_diagonal(near, False)
    key = lambda f0, f1: (int(np.int64(f0)), int(np.int64(f1)))
    want = {key(*f[i].view(np.int64)): int(k) for i, k in enumerate(near.sum(1)) if k}
    classes = spark.createDataFrame([key(*r) for r in f.view(np.int64)], "f0 long, f1 long")
    rows = S.links(classes, len(f), hot=hot).collect()
    got = {}
    for r in rows:
        if r["kind"] == S.LINKS:
            got[r["a0"], r["a1"]] = got.get((r["a0"], r["a1"]), 0) + r["b0"]
    assert got == want
    place = {key(*r): i for i, r in enumerate(f.view(np.int64))}
    edges = np.zeros_like(near)
    for r in rows:
        if r["kind"] == S.EDGE:
            edges[place[r["a0"], r["a1"]], place[r["b0"], r["b1"]]] = True
    assert not (edges & ~near).any()
    assert (least_of_group(edges | edges.T) == least_of_group(near)).all()
