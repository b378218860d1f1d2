import math
import random

import numpy as np
import pyarrow as pa
import pytest

from sievewright.llm import quality_forest as Q
from sievewright.llm import words as W


@pytest.fixture(scope="module")
def case():
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9)))
    good = [" ".join(word() for _ in range(rng.randrange(60, 160))) + ".\n" + word() for _ in range(400)]
    bad = ["$$$ ### " * 80, "BUY NOW!! " * 60, "9 1 7 3 " * 90, "\n\n\n\n".join("x" * 3 for _ in range(50))] * 5
    rows = list(enumerate(good + bad))
    labels = [(i, int(i < 400), 0) for i in range(0, 420, 2)]
    return rows, labels


def test_anomalies_found_and_good_kept(spark, docs_of, case):
    rows, labels = case
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = Q.judge(docs_of(rows), lab).toPandas()
    flagged = set(out[out.anomalous].doc_id)
    assert len(out) == len(rows)
    assert len(flagged & set(range(400))) <= 12 and len(flagged & set(range(400, 420))) >= 18


def test_features_by_hand():
    t = "Ab ab cd\nab 12!\n\nlonger é"
    x = dict(zip(Q.FEATURES, Q.features(*W.text_buffers(pa.array([t, ""])))[0]))
    n = len(t.encode())
    assert x["log_bytes"] == np.log1p(n) and x["log_words"] == np.log1p(7)
    assert np.isclose(x["upper_share"], 1 / 14) and np.isclose(x["digit_share"], 2 / n) and np.isclose(x["symbol_share"], 1 / n)
    assert np.isclose(x["distinct_word_share"], 5 / 7) and np.isclose(x["top_word_share"], 3 / 7) and x["distinct_line_share"] == 1
    assert x["log_longest_word"] == np.log1p(6) and x["log_longest_line"] == np.log1p(9)
    assert not Q.features(*W.text_buffers(pa.array([""]))).any()


def test_path_lengths_against_a_plain_walk():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 13))
    forest = Q.grow([x[rng.choice(500, 64, replace=False)] for _ in range(20)])

    def walk(row):
        total = 0.0
        for f, c, left, d in zip(forest.feature, forest.cut, forest.left, forest.depth):
            at = 0
            while f[at] >= 0:
                at = left[at] + int(row[f[at]] >= c[at])
            total += d[at]
        return 2 ** (-total / 20 / Q.usual_path(64))

    assert np.allclose(forest.score(x[:40]), [walk(r) for r in x[:40]])
    assert forest.score(np.full((1, 13), 9.0))[0] > forest.score(x).mean()


def test_edge_cases(spark, docs_of):
    rows = [(1, None), (2, ""), (3, "a"), (3, "a"), (None, "b c"), (4, "w " * 100_000)]
    df = docs_of(rows).selectExpr("*", "1 AS score", "2 AS quality")
    labels = spark.createDataFrame([(1, None, 0), (3, 0, 0), (None, 1, 0), (77, 1, 1)], "doc_id long, quality int, toxic int")
    out = Q.judge(df, labels).collect()
    assert len(out) == 6 and not any(r["anomalous"] for r in out)
    assert Q.judge(docs_of([]), labels).count() == 0
    assert Q.judge(df, labels.limit(0)).count() == 6


def plain_tree(rows, depth, limit, rng):
    """An isolation tree by its definition: nested tuples (feature, cut, left, right), or the depth of a leaf."""
    usual = lambda n: 0.0 if n < 2 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n
    lo, hi = [min(c) for c in zip(*rows)], [max(c) for c in zip(*rows)]
    free = [f for f in range(len(lo)) if hi[f] > lo[f]]
    if depth >= limit or not free:
        return depth + usual(len(rows))
    f = int(rng.choice(np.array(free)))
    c = float(rng.uniform(lo[f], hi[f]))
    c = float(np.nextafter(lo[f], hi[f])) if c <= lo[f] else c
    low, high = [r for r in rows if r[f] < c], [r for r in rows if r[f] >= c]
    # the greater side is grown first
    right = plain_tree(high, depth + 1, limit, rng)
    return f, c, plain_tree(low, depth + 1, limit, rng), right


def test_whole_query_against_a_plain_version(spark, docs_of, case):
    """Draws, trees, scores, threshold and verdicts, each once more without the operator's code."""
    rows, labels = case
    rows = rows + [rows[5], (None, "no id"), (900, None)]
    df = docs_of(rows)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    share = min(1.0, (Q.GROW_ON + 8 * math.sqrt(Q.GROW_ON)) / len(rows))
    keyed = df.selectExpr("CAST(doc_id AS STRING) AS i", "coalesce(text, '') AS text").selectExpr("xxhash64(i, text) AS h", "text").distinct()
    spread = keyed.selectExpr("text", "h", "explode(sequence(0, 99)) AS t").selectExpr("t", "shiftrightunsigned(xxhash64(h, t), 11) AS u", "text")
    by = {}
    for r in spread.collect():
        if r["u"] < int(share * 2**53):
            by.setdefault(r["t"], []).append((r["u"], r["text"]))
    stats = lambda t: tuple(Q.features(*W.text_buffers(pa.array([t])))[0].tolist())
    of = {t: stats(t or "") for t in {t for _, t in rows}}
    of[""] = stats("")
    rng = np.random.default_rng(17)
    trees = []
    for t in range(100):
        sample = [of[x] for _, x in sorted(by[t])[: Q.GROW_ON]]
        trees.append((plain_tree(sample, 0, math.ceil(math.log2(len(sample))), rng), Q.usual_path(len(sample))))

    def path(tree, x):
        while isinstance(tree, tuple):
            tree = tree[3] if x[tree[0]] >= tree[1] else tree[2]
        return tree

    score = {t: round(2 ** (-sum(path(tree, x) / usual for tree, usual in trees) / 100), 6) for t, x in of.items()}
    good = {i for i, q, _ in labels if q == 1}
    marks = sorted((math.floor(score[t or ""] * Q.STEPS) for i, t in rows if i in good), reverse=True)
    limit = next(s for s in range(Q.STEPS + 1) if sum(m >= s for m in marks) <= Q.MAX_LOSS * len(marks)) / Q.STEPS
    got = sorted(map(repr, ((r["doc_id"], r["score"], r["anomalous"]) for r in Q.judge(df, lab).collect())))
    want = sorted(repr((i, score[t or ""], score[t or ""] >= limit)) for i, t in rows)
    assert got == want and any("True" in g for g in got)


def test_draws_come_from_the_whole_corpus(docs_of):
    df = docs_of([(i, "x" * (i + 1)) for i in range(3000)] + [(7, "x" * 8)] * 500)
    forest = Q.fit(df, trees=40, grow_on=16)
    cuts = np.concatenate([c[f == 0] for c, f in zip(forest.cut, forest.feature)])
    assert len(forest.cut) == 40 and np.expm1(cuts.max()) > 2500 and len({round(float(x), 9) for x in cuts}) == len(cuts)
    assert forest.usual == [Q.usual_path(16)] * 40
