"""The packed model of a corpus against the models in tables, whatever the cuts; what it may leave on disk."""

import math

import pytest

from sievewright.operators import language_model
from sievewright.operators import packed_ngrams as P
from sievewright.plans import model_plans as M
from sievewright.session import shared_dir

TEXTS = ["a b c d e f g", "a b c d e x", "b c d e f, a b c d!", "a", "", None, "q r s t u v w a b c d e f", "x b c y b c z b c d", "é ß, a, b, c, d, e", ", , , , a , b , c"] * 3


@pytest.mark.parametrize("order, kneser_ney, per_bucket, chunk", [(2, False, 4, 25), (2, False, None, 10**6), (3, False, 6, 40), (5, True, 4, 25), (5, True, None, 10**6), (2, True, 4, 25), (3, True, 9, 1)])
def test_packed_is_the_same_model(spark, monkeypatch, order, kneser_ney, per_bucket, chunk):
    monkeypatch.setattr(P, "CHUNK", chunk)
    df = spark.createDataFrame([(f"id{k}", t) for k, t in enumerate(TEXTS)] + [(None, "a b")], "id string, text string").repartition(3)
    model = (language_model.train_kneser_ney if kneser_ney else language_model.train)(df, "text", order)
    plain = lambda m: sorted((r["n"], r["history"], r["next"], r["count"]) for r in m.collect())
    want = plain(model)
    assert plain(language_model.own_model(df, "text", order, kneser_ney, per_bucket=per_bucket)) == want
    cuts = language_model.discounts(model, order) if kneser_ney else None
    want = {r["id"]: r for r in language_model.perplexities(df, model, "id", "text", order, cuts).collect()}
    rows = language_model.own_perplexities(df, "id", "text", order, kneser_ney, per_bucket=per_bucket).collect()
    assert len(rows) == len(want) and {r["id"] for r in rows} | {None} == set(want) | {None}
    for r in rows:
        if r["id"] in want:
            w = want[r["id"]]
            assert r["n_pieces"] == w["n_pieces"] and (r["perplexity"] is None) == (w["perplexity"] is None)
            assert w["perplexity"] is None or math.isclose(r["perplexity"], w["perplexity"], rel_tol=1e-9)


def test_layout_gives_frequent_pieces_buckets_of_their_own(spark):
    df = spark.createDataFrame([(0, ["<s>", *"a b a c a d a e".split(), "</s>"])], "id int, toks array<string>")
    at = P.layout(df, 40, 3, per_bucket=4)
    assert at.hot == {"a": (2, 2)} and at.total == 4


@pytest.mark.parametrize("query", [M.perplexity_5gram, M.perplexity_bands_5gram, M.ngram_model_5gram])
def test_what_stays_on_disk_is_less_than_the_texts(spark, query):
    from pathlib import Path

    sf = "/root/testdata/sf0.001"
    at = Path(shared_dir(spark).removeprefix("file:"))
    size = lambda: sum(p.stat().st_size for p in at.rglob("*.parquet"))
    before = size()
    query(spark, sf).count()
    assert size() - before < Path(sf, "documents.parquet").stat().st_size * 4
