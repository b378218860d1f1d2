import json

import pytest
from pyspark.sql import functions as F

from sievewright.sources import readers, writers


def test_dense_ids_in_order(spark):
    df = spark.createDataFrame([(f"k{x:03}",) for x in range(100)], "k string").repartition(7)
    got = {r["k"]: r["__id__"] for r in readers.with_row_id(df, ["k"]).collect()}
    assert got == {f"k{x:03}": x for x in range(100)}
    assert readers.with_row_id(df.limit(0), ["k"]).count() == 0


def test_json_lines(spark, tmp_path):
    lines = ['{"b": 1,  "a": "x"}', '{"a": null}', "not json"]
    (tmp_path / "data_1.jsonl").write_text("\n".join(lines))
    raw = readers.read_jsonl_raw(spark, f"{tmp_path}/data_*.jsonl", "a string, b int").collect()
    assert [r["raw"] for r in raw] == lines and [r["a"] for r in raw] == ["x", None, None]
    assert readers.read_jsonl(spark, f"{tmp_path}/data_*.jsonl", "a string, b int").count() == 3
    (tmp_path / "data_1.jsonl").write_text("\n".join(lines[:2]))
    first = readers.read_source(spark, f"{tmp_path}/data_*.jsonl", "jsonl", ["b"], f"{tmp_path}/cache")
    again = readers.read_source(spark, f"{tmp_path}/cache", "cached", [])
    assert sorted(first.collect(), key=str) == sorted(again.collect(), key=str) and {r["__id__"] for r in again.collect()} == {0, 1}


def test_partitions_and_csv(spark, tmp_path):
    spark.createDataFrame([("a", 1), ("b", 2)], "lang string, n int").write.partitionBy("lang").parquet(f"{tmp_path}/c")
    assert [r["n"] for r in readers.read_corpus(spark, f"{tmp_path}/c", {"lang": "b"}, ["n"]).collect()] == [2]
    (tmp_path / "t.csv").write_text("name,include\nx,1\ny,\ntotal,\n")
    assert readers.read_csv(spark, f"{tmp_path}/t.csv").count() == 3
    assert [r["name"] for r in readers.read_csv(spark, f"{tmp_path}/t.csv", "include").collect()] == ["x"]


def test_benchmarks(spark):
    split = spark.createDataFrame([(11, "q", ["t1", "t2"]), (511, "r", [])], "task_id int, text string, tests array<string>")
    assert [r["__content__"] for r in readers.load_benchmark([split, split], ["text", "tests"]).collect()] == ["q t1 t2", "r "] * 2
    assert readers.task_range(split, 11, 510, 1).count() == 1
    with pytest.raises(Exception, match="rows: 1"):
        readers.task_range(split, 11, 510, 500).collect()


def test_docstring_of_prompts(spark):
    doc = lambda p: spark.createDataFrame([(p,)], "p string").select(readers.docstring_of(F.col("p")).alias("d")).first()["d"]
    assert doc('def f():\n  """ one """') == "one" and doc('"""a"""\ndef f():\n """b"""') == "b" and doc("x '''c '''") == "c"
    with pytest.raises(Exception, match="no docstring"):
        doc("none")


def test_settings(spark):
    df = spark.createDataFrame([({"_x": "1", "y": "2"},)], "config map<string,string>")
    assert readers.public_settings(df).first()["config"] == {"y": "2"}


def test_shards_keep_order(spark, tmp_path):
    df = spark.range(100).repartition(5)
    assert writers.shard_count(2500, 1000) == 3 and writers.shard_count(2500, 1000, 0.1) == 1
    assert writers.write_shards(df, f"{tmp_path}/s", "id", 3500, 1000) == 4
    parts = [[r["id"] for r in spark.read.parquet(str(p)).collect()] for p in sorted((tmp_path / "s").glob("train-*.parquet"))]
    assert [x for p in parts for x in p] == list(range(100)) and len(parts) == 4


def test_other_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b"], None), (2, ["c"], True), (3, [], False)], "id int, t array<string>, flag boolean")
    writers.write_token_text(df, f"{tmp_path}/t", "t")
    assert sorted(r["value"] for r in spark.read.text(f"{tmp_path}/t").collect()) == ["", "a b", "c"]
    writers.write_json(df, f"{tmp_path}/j")
    assert {json.loads(x)["id"] for p in (tmp_path / "j").glob("part-*") for x in p.read_text().splitlines()} == {1, 2, 3}
    writers.write_split(df, F.col("flag"), f"{tmp_path}/kept", f"{tmp_path}/gone")
    assert {r["id"] for r in spark.read.parquet(f"{tmp_path}/kept").collect()} == {1, 3} and {r["id"] for r in spark.read.parquet(f"{tmp_path}/gone").collect()} == {2}
    assert {tuple(r) for r in writers.merge_counters(spark.createDataFrame([("a", 1), ("a", 2)], "k string, n int"), "k", "n").collect()} == {("a", 3)}
