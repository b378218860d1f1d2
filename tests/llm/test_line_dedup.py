import random

import numpy as np

from sievewright.llm import line_dedup as L


def brute(rows):
    seen, out = set(), {}
    rows = sorted({(-(1 << 63) if i is None else i, t or "") for i, t in rows})
    for i, t in rows:
        bits = []
        for line in t.split("\n"):
            bare = line.strip(" \t\r\x0b\x0c")
            bits.append(not bare or bare not in seen)
            if bare:
                seen.add(bare)
        out[None if i == -(1 << 63) else i] = (len(bits), sum(bits), L.encode_runs(np.array(bits)))
    return out


def run(df):
    return {r["doc_id"]: (r["n_lines"], r["n_kept"], r["keep_bitmap"]) for r in L.keep_bitmaps(df).collect()}


def test_matches_brute_force(docs_of):
    rng = random.Random(3)
    pool = ["alpha", " alpha ", "beta gamma", "", "  ", "été", "x" * 700, "x" * 700 + "y", "long " * 90, "long " * 90 + "!"] + [f"line {k}" for k in range(30)]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 9)))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, "\n\n"), (None, "beta gamma\nonly here"), (503, "z\n" * 3000)]
    assert run(docs_of(rows)) == brute(rows)


def test_many_batches_and_partitions(spark, docs_of):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(i, f"shared\nown {i}\nhalf {i // 2}") for i in range(100)]
        assert run(docs_of(rows).repartition(5)) == brute(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")


def test_repeated_rows_count_once(docs_of):
    rows = [(1, "a\nb\na"), (1, "a\nb\na"), (2, "b\nc"), (2, "b\nc")]
    assert run(docs_of(rows)) == {1: (3, 2, "2,1"), 2: (2, 1, "0,1,1")}


def test_empty_table(docs_of):
    assert run(docs_of([])) == {}


def test_apply_keeps_columns_and_drops_emptied(spark, docs_of):
    rows = [(1, "a\nb"), (2, "b\na"), (3, "c\na\n\nd"), (4, None), (5, "")]
    df = docs_of(rows).selectExpr("*", "1 AS digest", "'x' AS keep_bitmap", "2 AS id")
    out = L.apply_bitmaps(df, L.keep_bitmaps(df))
    assert out.columns == df.columns
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {1: "a\nb", 3: "c\n\nd", 4: None, 5: ""}


def test_run_length_coding():
    for bits in ([], [True], [False], [True, True, False], [False, True, True]):
        assert L.decode_runs(L.encode_runs(np.array(bits, bool))).tolist() == bits


def test_ids_of_other_types_and_unsorted_hot_lines(spark, docs_of):
    rng = random.Random(5)
    rows = [(i, f"hot\nown {i}\nhot too\nhot") for i in range(400)]
    rng.shuffle(rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "9")
    try:
        df = docs_of(rows)
        assert run(df) == brute(rows)
        named = df.withColumn("doc_id", L.F.concat(L.F.lit("doc-"), "doc_id")).unionByName(docs_of([(None, "hot\nlast")]).withColumn("doc_id", L.F.lit(None).cast("string")))
        got = {r["doc_id"]: (r["n_lines"], r["n_kept"]) for r in L.keep_bitmaps(named).collect()}
        assert set(got) == {f"doc-{i}" for i in range(400)} | {None}
        # the null id comes first, then one document has the other repeated line
        assert got[None] == (2, 2) and sorted(v[1] for k, v in got.items() if k) == [1] * 399 + [2]
        left = L.apply_bitmaps(named, L.keep_bitmaps(named))
        assert left.columns == named.columns and sum(r["text"].count("hot") for r in left.collect()) == 2
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
