"""Every query with SQL against DuckDB on the smallest tables; the others must give as many rows as their tables say.

What the others compute is tested against plain versions: test_dedup, test_five_grams, test_new_operators,
test_extract and test_stats_and_evaluation.
"""

import math
from pathlib import Path

import duckdb
import pytest

from sievewright.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="needs the generated tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(names, values):
    order = sorted(range(len(names)), key=names.__getitem__)
    plain = lambda v: None if isinstance(v, float) and math.isnan(v) else round(v, 9) if isinstance(v, float) else v
    return sorted(names), sorted((tuple(plain(r[k]) for k in order) for r in values), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    want = duck.execute(registry.ORACLES[name])
    assert rows(got.columns, got.collect()) == rows([d[0] for d in want.description], want.fetchall())


#: Rows of the queries without SQL: as a number, or of a table.
ROWS = {
    "line_languages": "conversations",
    "perplexity_5gram": "documents",
    "perplexity_bands_5gram": 1,
    "bpe_token_counts": "documents",
    "kmeans_sizes": 5,
    "silhouettes": 7,
    "projected": "embeddings",
    "scaling_refined": 1,
    "near_dedup_counts": 1,
    "near_dedup_cluster_sizes": 1,
    "near_dedup_extremes": None,
    "ngram_model_5gram": None,
}


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_rows_without_sql(spark, duck, name):
    out = registry.QUERIES[name](spark, SF)
    want = ROWS[name]
    assert len(set(out.columns)) == len(out.columns)
    n = duck.execute(f"SELECT count(*) FROM {want}").fetchone()[0] if isinstance(want, str) else want
    assert out.count() == n if n is not None else out.count() > 20


def test_registry_is_consistent():
    assert set(registry.ORACLES) <= set(registry.QUERIES)
