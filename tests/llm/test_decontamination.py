import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from sievewright.llm import decontamination as D

ITEMS = "item_id long, text string"


def words(t):
    return re.findall(r"[a-z0-9]+", t.lower())


def brute(rows, items, threshold, least):
    """Every passage against every item by the BM25 formula."""
    docs = {i: words(t) for i, t in items if i is not None and words(t or "")}
    n, mean = len(docs), sum(map(len, docs.values())) / len(docs)
    df = Counter(w for d in docs.values() for w in set(d))
    weight = {}
    for i, d in docs.items():
        c = Counter(d)
        w = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * k * 2.2 / (k + 1.2 * (0.25 + 0.75 * len(d) / mean)) for t, k in c.items()}
        weight[i] = {t: v / sum(w.values()) for t, v in w.items()}
    stride = max(map(len, docs.values()))
    grams = lambda w, k: {tuple(w[x : x + k]) for x in range(len(w) - k + 1)}

    def share(part, passage):
        k = min(3, len(part))
        return 1.0 if not k else np.mean([g in grams(passage, k) for g in grams(part, k)])

    out = set()
    for doc, t in rows:
        w = words(t or "")
        for a in range(0, max(len(w), 1), stride):
            passage = w[a : a + 2 * stride]
            for i, d in docs.items():
                if sum(v for x, v in weight[i].items() if x in set(passage)) < threshold - 1e-9:
                    continue
                cut = math.ceil(len(d) * 3 / 4) if len(d) >= 4 else len(d)
                if share(d[:cut], passage) >= least and share(d[cut:], passage) >= least:
                    out.add((doc, i))
    return out


@pytest.fixture(scope="module")
def case():
    rng = random.Random(8)
    vocabulary = ["the", "of", "and"] * 60 + [f"v{k}" for k in range(500)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, text(rng.randrange(5, 40))) for k in range(70)] + [(100, "One."), (101, "Two words"), (102, None), (103, "!!"), (None, "no id here at all")]
    rows = []
    for k in range(120):
        t = text(rng.randrange(0, 200))
        if k % 2:
            piece = words(rng.choice(items[:70])[1])
            if k % 4 == 1:
                piece = [w if rng.random() > 0.15 else "zzz" for w in piece]
            t = f"{text(30)} {' '.join(piece).upper()} {t}"
        rows.append((k, t))
    return rows + [(500, None), (501, ""), (502, "one"), (503, "two words")], items


def test_matches_brute_force(spark, docs_of, case):
    rows, items = case
    bench = spark.createDataFrame(items + items[:3], ITEMS)
    for threshold, least in ((0.6, 0.5), (0.4, 0.3)):
        got = D.contaminated(docs_of(rows), bench, threshold=threshold, min_overlap=least).collect()
        assert {(r["doc_id"], r["item_id"]) for r in got} == brute(rows, items, threshold, least)
        assert len(got) == len({(r["doc_id"], r["item_id"]) for r in got})


def test_wand_finds_all_above_the_threshold(case):
    _, items = case
    hashed = D.hashes_of([t or "" for _, t in items])
    q, a = zip(*map(D.split_item, hashed))
    index = D.Index([i for i, _ in items], list(q), list(a), 0.3)
    rng = np.random.default_rng(1)
    for _ in range(60):
        terms = rng.choice(len(index.terms), rng.integers(1, 200), replace=False)
        score = np.zeros(len(index.ids))
        for t in terms:
            score[index.items[t]] += index.weights[t]
        got = dict(index.search(terms))
        assert set(got) == set(np.flatnonzero(score >= 0.3 - 1e-9))
        assert all(abs(got[i] - score[i]) < 1e-9 for i in got)


def test_shards_of_the_index_and_dropping(spark, docs_of, case):
    rows, items = case
    whole = [(k, f"before {t} after") for k, t in items[:20]] + [(99, "nothing to see")]
    bench = spark.createDataFrame(items[:20], ITEMS)
    df = docs_of(whole).selectExpr("*", "1 AS item_id", "'q' AS question", "2.5 AS score")
    got = [sorted(map(tuple, D.contaminated(df, bench, **bound).collect())) for bound in ({}, {"shard_items": 6}, {"shard_items": 1}, {"shard_bytes": 300})]
    assert {(k, k) for k in range(20)} <= {r[:2] for r in got[0]} and got[0] == got[1] == got[2] == got[3]
    kept = D.drop_contaminated(df, bench, shard_items=6)
    assert kept.columns == df.columns and [r["doc_id"] for r in kept.collect()] == [99]


def test_separate_answers(spark, docs_of):
    bench = spark.createDataFrame([(1, "what is the capital of the moon", "green cheese city")], "item_id long, text string, answer string")
    df = docs_of([(1, "So: what is the capital of the moon? Green cheese city."), (2, "what is the capital of the moon nobody knows")])
    got = D.contaminated(df, bench, answer_col="answer", threshold=0.5).collect()
    assert [r["doc_id"] for r in got] == [1]


def test_ids_of_narrow_and_other_types(spark, docs_of):
    text = "a question of some words and its answer too"
    for kind, one in (("int", 1), ("smallint", 1), ("string", "a"), ("decimal(9,0)", 1)):
        bench = spark.createDataFrame([(str(one), text)], "item_id string, text string").withColumn("item_id", D.F.col("item_id").cast(kind))
        got = D.contaminated(docs_of([(5, f"x {text} y"), (6, "nothing")]), bench).collect()
        assert [(r["doc_id"], r["item_id"]) for r in got] == [(5, one)]


def test_empty_tables(spark, docs_of):
    bench = spark.createDataFrame([(1, "some item text")], ITEMS)
    assert D.contaminated(docs_of([]), bench).count() == 0
    assert D.contaminated(docs_of([(1, "some item text")]), bench.limit(0)).count() == 0
    null_id = D.contaminated(docs_of([(None, "some item text"), (None, "some item text")]), bench).collect()
    assert [(r["doc_id"], r["item_id"]) for r in null_id] == [(None, 1)]


def test_rows_and_scores_do_not_depend_on_the_shards(spark, docs_of, case):
    rows, items = case
    bench = spark.createDataFrame(items, ITEMS)
    got = [sorted(map(tuple, D.contaminated(docs_of(rows), bench, threshold=0.4, min_overlap=0.3, shard_items=n).collect())) for n in (50_000, 40, 4, 1)]
    assert got[0] and all(g == got[0] for g in got)
    kept = [sorted(r["doc_id"] for r in D.drop_contaminated(docs_of(rows), bench, shard_items=n).collect()) for n in (50_000, 17)]
    assert kept[0] == kept[1]
