"""Small operators by hand-made cases; models against plain versions."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievewright.operators import clustering, extract, quality, subwords, threads
from sievewright.plans import model_plans as M
from sievewright.sources import readers, writers

VOCABULARY = M.VOCABULARY


@pytest.mark.parametrize(
    "source, version",
    [
        ("x = 1\n", 3),
        ("print 'a', b\n", 2),
        ("if x: print 'y'\n", 2),
        ("try:\n  pass\nexcept ValueError, e:\n  raise IOError, 'x'\n", 2),
        ("x = 0777L <> `y`\nexec 'x'\n", 2),
        ("x = ur'abc'\n", 2),
        ("s = 'print 1'  # print 2\nprint s\n", 2),
        ("s = '''\nprint it\n'''\nprint \"%s\" % s\n", 2),
        ('print("ok")\n', 3),
        ("y = = 2", 0),
        ("def f(:\n", 0),
        ("prints 1\n", 0),
        ("", 3),
        ("x\0y", 0),
    ],
)
def test_python_versions(source, version):
    assert extract.python_version(source) == version


def test_strings_and_comments_are_not_rewritten():
    code = "s = 'a <> b, 10L'  # `x` <> 0777\nprint s\n"
    assert extract.as_python3(code) == "s = 'a <> b, 10L'  # `x` <> 0777\nprint(s)\n"


AWKWARD = ["plain words", "def f(x):\n    return x", 'quotes " and \"\"\" and \\ end\\', "# a comment */ in\n\nlines\n", None, "", "long line " * 20_000, "    indented\n\n  less", "é \U0001f600 ''' x"]


def test_awkward_texts_within_code(spark, tmp_path):
    spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(AWKWARD * 2)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    flags = {r["doc_id"]: (r["version"], r["compiles"]) for r in M.compile_flags(spark, str(tmp_path)).collect()}
    assert flags == {i: ((3, True), (3, True), (3, True), (0, False), (2, True), (0, False))[i % 6] for i in range(len(AWKWARD) * 2)}
    comments = {r["doc_id"]: r["comments"] for r in M.python_comments(spark, str(tmp_path)).collect()}
    told = {r["doc_id"]: r["docstrings"] for r in M.python_docstrings(spark, str(tmp_path)).collect()}
    for i, t in enumerate(AWKWARD * 2):
        note = "".join(" " + x for x in (t or "").replace("#", "").split("\n"))
        assert comments[i] == (note + " first deep", " wait" + note, " real" + note, note, note + " old", "")[i % 6]
        words = " ".join((t or "").split())
        assert told[i] == ("|".join(["Holds en.", "Inner.", "Outer.", *([words] if words else [])]), f"Plain {i}.", "", "", "", "")[i % 6]


def test_nested_counters(spark):
    df = spark.createDataFrame([({"a": {"x": 1, "y": 2}},), ({"a": {"x": 5}, "b": {"z": None}},), (None,)], "c map<string, map<string, long>>")
    assert {tuple(r["path"]): r["n"] for r in writers.merge_nested(df, "c").collect()} == {("a", "x"): 6, ("a", "y"): 2}
    flat = spark.createDataFrame([({"a": 1},), ({"a": 2, "b": 3},)], "c map<string, long>")
    assert {tuple(r["path"]): r["n"] for r in writers.merge_nested(flat, "c").collect()} == {("a",): 3, ("b",): 3}
    assert writers.merge_nested(flat.limit(0), "c").count() == 0


def test_parameters_and_named_shards(spark, tmp_path):
    params = {"weights": [1.5, 2.0], "names": {"a": "b"}, "none": None}
    writers.write_params(spark, f"{tmp_path}/p", params)
    assert readers.read_params(spark, f"{tmp_path}/p") == params == json.loads(json.dumps(params))
    n = writers.write_shards(spark.range(1000).toDF("i"), f"{tmp_path}/s", "i", 7000, 1000)
    files = sorted(f for f in os.listdir(f"{tmp_path}/s") if f.endswith(".parquet") and not f.startswith("."))
    assert n == 8 and files == [f"train-{k:05d}-of-00008.parquet" for k in range(8)]
    firsts = [spark.read.parquet(f"{tmp_path}/s/{f}").agg(F.min("i")).first()[0] for f in files]
    assert firsts == sorted(firsts) and spark.read.parquet(f"{tmp_path}/s").count() == 1000


def test_row_filters(spark):
    df = spark.createDataFrame([(1, 5.0, 1.0, "run-a"), (2, 8.0, 7.5, "x"), (3, 30.0, None, None), (4, None, 1.0, "")], "i int, a double, b double, n string")
    ids = lambda out: sorted(r["i"] for r in out.collect())
    assert sorted((r["i"], r["bound"]) for r in quality.in_bands(df, F.col("a"), [7, 20]).collect()) == [(2, 7.0), (3, 7.0), (3, 20.0)]
    assert ids(quality.above(df, F.col("a"), 7)) == [2, 3] and ids(quality.gap_at_least(df, F.col("a"), F.col("b"), 1.0)) == [1]
    assert ids(quality.named(df, F.col("n"), "^run-")) == [1] and ids(quality.complete_rows(df, ["a", "n"])) == [1, 2]
    assert ids(quality.complete_rows(df, ["b"], F.col("a") > 6)) == [2]


def test_rendered_metadata(spark):
    df = spark.sql("SELECT array(named_struct('author', 'ann', 'text', 'hello', 'action', 'opened', 'type', 'issue', 'title', cast(null as string))) AS e")
    rule = "-" * 75
    got = df.select(threads.render(F.col("e")), threads.render(F.col("e"), ("action", "type", "title"))).first()
    assert tuple(got) == (f"author: ann\nhello\n{rule}", f"author: ann, opened issue: \nhello\n{rule}")


def test_sub_words(spark):
    tiktoken = pytest.importorskip("tiktoken")
    texts = ["Hello wörld, it's 2024!", "", None, "  \n x" * 50]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", subwords.bpe_ids(F.col("t"), VOCABULARY).alias("ids"), subwords.bpe_pieces(F.col("t"), VOCABULARY).alias("p"))
    encoder, _ = subwords._load(VOCABULARY)
    assert isinstance(encoder, tiktoken.Encoding)
    back = {s: b for b, s in enumerate(subwords.printable())}
    assert len(back) == 256
    for t, ids, pieces in df.collect():
        if t is None:
            assert ids is None and pieces is None
            continue
        assert encoder.decode(ids) == t and len(ids) == len(pieces)
        assert bytes(back[c] for c in "".join(pieces)).decode() == t and not any(c.isspace() for c in "".join(pieces))


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(c, 0.3, (40, 5)) for c in (0.0, 3.0, -4.0)])
    x[:, 4] *= 9
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i int, v array<double>")


def test_projection_is_the_plain_one(points):
    x, df = points
    got = np.array([r["xy"] for r in clustering.project(df, "v").orderBy("i").collect()])
    values, axes = np.linalg.eigh(np.cov(x.T))
    want = x @ axes[:, np.argsort(-values)[:2]]
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-6)


def test_clusters_and_silhouettes_are_the_plain_ones(points):
    x, df = points
    labelled = {r["i"]: r["cluster"] for r in clustering.kmeans(df, "v", 3).collect()}
    label = np.array([labelled[i] for i in range(len(x))])
    centres = np.array([x[label == k].mean(0) for k in range(3)])
    # a fixed point: every row is nearest to the mean of its own cluster
    assert (((x[:, None] - centres[None]) ** 2).sum(2).argmin(1) == label).all() and len(set(label)) == 3
    sweep = {r["k"]: r["silhouette"] for r in clustering.silhouette_sweep(df, "v", range(2, 5)).collect()}
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    s = []
    for i in range(len(x)):
        own = d[i][(label == label[i])].sum() / ((label == label[i]).sum() - 1)
        other = min(d[i][label == k].mean() for k in range(3) if k != label[i])
        s.append((other - own) / max(own, other))
    assert sweep.keys() == {2, 3, 4} and sweep[3] == pytest.approx(np.mean(s), abs=2e-3)
