import random
from itertools import combinations

import numpy as np
import pytest

from sievewright.operators import decontaminate, dedup, minhash

SCHEMA = "id long, text string, path string"


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    texts = [" ".join(word() for _ in range(60)) for _ in range(40)]
    for k in range(12):
        w = texts[k % 4].split()
        for _ in range(k % 3):
            w[rng.randrange(len(w))] = word()
        texts.append(" ".join(w))
    texts += ["too short", "also short", ""]
    return texts, spark.createDataFrame([(i, t, f"p{i}") for i, t in enumerate(texts)], SCHEMA)


def test_signature_against_big_integers():
    a, b = minhash.permutations(8)
    assert int(a[0]) == 2297359619001564596 and int(b[0]) == 1396682528897996046
    h = minhash.token_hashes("one two three two", 1)
    want = [min(((int(x) * int(p) + int(q)) % 2**64) % (2**61 - 1) % 2**32 for x in h) for p, q in zip(a, b)]
    assert minhash.signature(h, a, b).tolist() == want
    assert minhash.signature(np.zeros(0, np.uint64), a, b).tolist() == [2**32 - 1] * 8


@pytest.mark.parametrize("threshold, perms, want", [(0.7, 256, (25, 10)), (0.85, 256, (13, 19)), (0.58, 128, (21, 6))])
def test_banding(threshold, perms, want):
    assert minhash.best_banding(threshold, perms) == want


def test_collision_clusters_against_brute_force(spark, corpus):
    texts, df = corpus
    a, b = minhash.permutations(256)
    sigs = [minhash.signature(minhash.token_hashes(t, 5), a, b) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in combinations(range(len(texts)), 2):
        if any((sigs[i][k : k + 10] == sigs[j][k : k + 10]).all() for k in range(0, 250, 10)):
            x, y = sorted((find(i), find(j)))
            parent[y] = x
    want = {i: find(i) for i in range(len(texts)) if sum(find(j) == find(i) for j in range(len(texts))) > 1}
    got = {r["id"]: r["component"] for r in dedup.collision_clusters(df, "id", "text").collect()}
    assert got == want and got[len(texts) - 1] == got[len(texts) - 2]
    kept = {r["id"] for r in dedup.drop_collisions(df, "id", "text").collect()}
    assert kept == set(range(len(texts))) - {i for i, c in want.items() if i != c}


def test_greedy_clusters_reduce_to_extremes(spark, corpus):
    texts, df = corpus
    clusters = dedup.greedy_clusters(df, "id", "text", "path")
    rows = clusters.collect()
    sets = [set(t.split()) for t in texts]
    for base in {r["cluster"] for r in rows}:
        members = sorted((r for r in rows if r["cluster"] == base), key=lambda r: r["id"])
        assert members[0]["id"] == base and members[0]["is_extreme"]
        for r in members:
            if not r["is_extreme"]:
                assert any(len(sets[r["id"]] & sets[e["id"]]) >= 0.85 * len(sets[r["id"]] | sets[e["id"]]) for e in members if e["is_extreme"])
    # exact copies never both stay
    kept = [texts[r["id"]] for r in dedup.drop_greedy(df, clusters, "id").collect()]
    assert len(kept) == len(set(kept)) and {"too short", "also short", ""} <= set(kept)
    counts = dedup.dedup_counts(df, clusters, "id").first()
    assert counts["rows"] == len(texts) and counts["rows_left"] == len(kept)
    assert sum(len(r["members"]) for r in dedup.nested_clusters(clusters).collect()) == len(rows)


def plain_replay(texts, threshold=0.85, least=10):
    """The sequential rule: look up, open or join a cluster, insert; then the extremes of each cluster."""
    import hashlib
    import re

    a, b = (list(map(int, x)) for x in minhash.permutations(256))
    n_bands, rows = minhash.best_banding(threshold, 256)
    table, clusters = [{} for _ in range(n_bands)], {}
    words = {}
    for i, t in enumerate(texts):
        w = [x for x in re.split("[^A-Za-z_0-9]", t) if x]
        if len(w) < least:
            continue
        words[i] = set(w)
        hashes = [int.from_bytes(hashlib.sha1(x.encode()).digest()[:4], "little") for x in words[i]]
        signature = [min(((h * p + q) % 2**64) % (2**61 - 1) & (2**32 - 1) for h in hashes) for p, q in zip(a, b)]
        keys = [tuple(signature[k * rows : (k + 1) * rows]) for k in range(n_bands)]
        close = sorted({j for k, key in enumerate(keys) for j in table[k].get(key, [])})
        for k, key in enumerate(keys):
            table[k].setdefault(key, []).append(i)
        if close:
            base = next((j for j in close if j in clusters), close[0])
            clusters.setdefault(base, set()).add(i)
    out, extreme = set(), {}
    for base, rest in clusters.items():
        extremes = []
        for i in [base, *sorted(rest)]:
            for e in extremes:
                if len(words[i] & words[e[0]]) / len(words[i] | words[e[0]]) >= threshold:
                    e[1] += 1
                    break
            else:
                extremes.append([i, 1])
        extreme.update({i: n for i, n in extremes})
    for base, rest in clusters.items():
        out |= {(base, i, extreme.get(i), i in extreme) for i in [base, *rest]}
    return out


def test_greedy_clusters_against_a_plain_replay(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    bases = [[word() for _ in range(50)] for _ in range(5)]
    texts = []
    for k in range(70):
        w = list(rng.choice(bases)) if k % 4 else [word() for _ in range(40)]
        for _ in range(rng.randrange(0, 9)):
            w[rng.randrange(len(w))] = word()
        texts.append(" ".join(w))
    texts += ["too few words", texts[0], texts[0]]
    df = spark.createDataFrame([(i, t, f"p{i}") for i, t in enumerate(texts)], SCHEMA)
    got = {(r["cluster"], r["id"], r["copies"], r["is_extreme"]) for r in dedup.greedy_clusters(df, "id", "text", "path").collect()}
    want = plain_replay(texts)
    assert got == want and len(want) > 20 and any(not r[3] for r in want)


def test_exact_dedup(spark):
    df = spark.createDataFrame([(3, "a", "x"), (1, "a", "x"), (2, "b", "x"), (4, None, "x"), (5, None, "x")], SCHEMA)
    assert {r["id"] for r in dedup.drop_exact(df, "id", "text").collect()} == {1, 2, 4, 5}
    assert dedup.drop_exact(df.limit(0), "id", "text").count() == 0


def test_exact_matches_first_priority_wins(spark):
    docs = spark.createDataFrame([(1, "xx Needle yy hay", ""), (2, "hay", ""), (3, "none", ""), (4, None, "")], SCHEMA)
    patterns = spark.createDataFrame([(1, "late", "HAY"), (0, "early", "needle"), (2, "empty", "")], "priority int, name string, pattern string")
    hits = decontaminate.exact_matches(docs, patterns, "id", "text")
    assert {(r["id"], r["reason"]) for r in hits.collect()} == {(1, "early_match"), (2, "late_match")}
    clean, dirty = decontaminate.split_contaminated(docs, hits, "id")
    assert {r["id"] for r in clean.collect()} == {3, 4} and {r["id"] for r in dirty.collect()} == {1, 2}
    assert decontaminate.exact_matches(docs, patterns.limit(0), "id", "text").count() == 0


def test_near_matches_are_verified(spark, corpus):
    texts, df = corpus
    changed = texts[3].split()
    changed[:4] = ["q", "r", "s", "t"]
    items = spark.createDataFrame([(0, " ".join(changed), ""), (1, "nothing of the kind is here", "")], SCHEMA)
    got = {r["id"]: (r["neighbours"], r["best"]) for r in decontaminate.near_matches(df, items, "id", "text", "id", "text").collect()}
    sets, item = [set(t.split()) for t in texts], set(changed)
    sim = [len(s & item) / max(1, len(s | item)) for s in sets]
    assert set(got) == {i for i, s in enumerate(sim) if s >= 0.58}
    assert all(n == [0] and b == pytest.approx(sim[i]) for i, (n, b) in got.items())
