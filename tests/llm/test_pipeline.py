import random

import corpus_pipeline
import duckdb
import numpy as np
import pyarrow as pa
import pytest
import test_decontamination
import test_language_id
import test_line_dedup
import test_simhash_dedup

from sievewright.llm import decontamination, language_id, line_dedup, queries, simhash_dedup


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("ka ro mi tu sen dal fo".split()) for _ in range(rng.randrange(1, 5)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(k, text(20)) for k in range(10)]
    rows = [(i, f"{text(60)}\n{text(40)}", "en", f"s{i % 3}", 1) for i in range(160)]
    near = rows[0][1].split()
    near[5] = "changed"
    rows += [(1000, " ".join(near), "en", "s0", 1), (1001, f"{text(40)} {items[3][1]} {text(30)}", "en", "s1", 1)]
    rows += [(1002, rows[1][1], "en", "s1", 1), (1003, None, "en", "s1", None), (1004, "", None, None, 0), (None, text(50), "en", "s2", 1), (1005, "Сегодня хорошая погода " * 30, None, "s1", 1)]
    base = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    return str(base), rows


def test_stages(spark, tables, tmp_path):
    base, rows = tables
    docs = spark.read.parquet(f"{base}/documents.parquet")
    left = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, base)
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        left[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "near_dedup", "decontamination", "mixing"]
    clean = set(range(160)) | {None}
    assert clean <= set(left["language_id"]) and not {1003, 1004, 1005} & set(left["language_id"])
    assert 1002 not in left["line_dedup"] and clean <= set(left["line_dedup"])
    assert 1000 not in left["near_dedup"] and clean <= set(left["near_dedup"])
    assert 1001 in left["near_dedup"] and 1001 not in left["decontamination"] and clean <= set(left["decontamination"])
    assert 0 < len(left["mixing"]) < len(left["decontamination"])


def test_run_is_the_stages(spark, tables):
    base, _ = tables
    out = corpus_pipeline.run(spark, base)
    assert {"doc_id", "text", "topic", "n_tokens", "probability"} <= set(out.columns) and out.count() > 0


def test_empty_documents(spark, tables, tmp_path):
    base, _ = tables
    spark.read.parquet(f"{base}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{base}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_every_operator_is_registered():
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 11))
    assert set(queries.ORACLES) <= set(queries.QUERIES)


def test_run_against_a_brute_force_version(spark, tables):
    """Every stage once more in plain Python (the fitted language model and the fingerprints are given), the draw in SQL."""
    base, rows = tables
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{base}/benchmark.parquet").collect()]
    model = language_id.fit(spark.read.parquet(f"{base}/documents.parquet"))
    left = []
    for r in rows:
        counts = test_language_id.plain_counts((r[1] or "").encode())
        n = int(counts.sum())
        if n and float((model.centroids @ test_language_id.plain_vector((r[1] or "").encode(), model.idf)).max()) >= model.floors[n.bit_length() - 1]:
            left.append(r)
    bitmaps = test_line_dedup.brute([r[:2] for r in left])
    thin = []
    for r in left:
        kept = line_dedup.decode_runs(bitmaps[r[0]][2])
        text = "\n".join(line for line, k in zip(r[1].split("\n"), kept) if k)
        if text.strip(" \t\n\x0b\f\r"):
            thin.append((r[0], text, *r[2:]))
    near, _ = test_simhash_dedup.brute_links([r[1] for r in thin], simhash_dedup.MAX_DISTANCE)
    gone, seen = set(), set()
    for k in sorted((k for k, r in enumerate(thin) if r[0] is not None), key=lambda k: thin[k][0]):
        group, todo = {k}, [k]
        while todo:
            for j in np.flatnonzero(near[todo.pop()]):
                if thin[j][0] is not None and j not in group:
                    group.add(int(j))
                    todo.append(int(j))
        if k not in seen:
            gone |= group - {k}
        seen |= group
    thin = [r for k, r in enumerate(thin) if k not in gone]
    leaks = {d for d, _ in test_decontamination.brute([(k, r[1]) for k, r in enumerate(thin)], items, decontamination.THRESHOLD, decontamination.OVERLAP)}
    thin = [r for k, r in enumerate(thin) if k not in leaks]
    con = duckdb.connect()
    table = pa.table({c: pa.array([r[k] for r in thin], t) for k, (c, t) in enumerate({"doc_id": pa.int64(), "text": pa.string(), "lang": pa.string(), "source": pa.string(), "n_chars": pa.int64()}.items())})
    con.register("documents", table)
    want = con.execute(f"SELECT doc_id, topic, n_tokens, probability FROM ({queries.ORACLES['op9_mixing']}) WHERE doc_id IS NOT NULL").fetchall()
    out = corpus_pipeline.run(spark, base)
    got = [tuple(r) for r in out.where("doc_id IS NOT NULL").select("doc_id", "topic", "n_tokens", "probability").collect()]
    assert sorted(got) == sorted(want) and len(want) > 30
    assert {r["doc_id"]: r["text"] for r in out.collect() if r["doc_id"] is not None} == {r[0]: r[1] for r in thin if r[0] in {w[0] for w in want}}
