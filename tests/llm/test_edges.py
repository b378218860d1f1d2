"""Every operator on one awkward table: nulls in every column, empty and very long texts, ties, repeated rows, clashing names."""

import random

import pytest
from pyspark.sql import functions as F

from sievewright.llm import decontamination, language_id, line_dedup, mixing, quality_forest, queries, secret_scan, simhash_dedup, substring_dedup, token_counts, url_filter

CLASHES = "id digest part pos state h0 h1 cell f0 f1 src dst component anchor words first last ref score label v topic tokens place n kind repo owner c value probability expression host path prefix sha batch rows __id __digest __gone __p __topic __bitmap __spans __text __source __lang".split()


def with_clashes(df, *keep):
    return df.withColumns({c: F.lit(f"clash {c}") for c in CLASHES if c not in df.columns and c not in keep})


@pytest.fixture(scope="module")
def awkward(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("ka ro mi tu sen dal fo be".split()) for _ in range(rng.randrange(1, 5)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = text(70)
    rows = [(i, f"{text(40)}\n{shared if i % 4 == 0 else text(60)}", "en", f"o{i % 5}/r{i % 7}", 1) for i in range(60)]
    rows += [rows[3], rows[3], (3, "another text under the same id", "en", "o", 1)]
    rows += [(100, None, "en", "o", None), (None, text(30), "en", "o", 3), (101, text(30), None, None, None), (None, None, None, None, None), (102, "", "", "", 0), (103, " \n\t\n ", "de", "o", 5)]
    rows += [(104, text(150_000), "en", "o", 1), (105, "x" * 1_000_000, "en", "o", 1), (106, "é" * 300_000, "fr", "o", 1), (107, "\n" * 20_000, "en", "o", 1), (108, '\0﻿"\\ \U0001f600', "en", "o", 1)]
    rows += [(200 + k, rows[1][1], "en", "o1/r1", 1) for k in range(5)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="module")
def items(spark, awkward):
    first = awkward.where("doc_id = 5").first()["text"].split()
    return spark.createDataFrame([(1, " ".join(first[:25])), (1, " ".join(first[:25])), (2, ""), (3, None), (None, "no id here at all")], "item_id long, text string")


def rules(spark):
    return spark.createDataFrame(queries.URL_RULES, "rule_id long, pattern string, action string")


def labels_of(docs):
    number = F.regexp_replace(F.col("doc_id").cast("string"), "doc-", "").cast("long")
    return docs.select("doc_id", F.when(number % 3 == 0, 1).when(number % 3 == 1, 0).alias("quality"))


OPERATORS = {
    "tokens": lambda docs, items: token_counts.count_tokens(docs, queries.VOCABULARY),
    "lines": lambda docs, items: line_dedup.keep_bitmaps(docs),
    "near": lambda docs, items: simhash_dedup.near_duplicates(docs),
    "spans": lambda docs, items: substring_dedup.repeated_spans(docs),
    "secrets": lambda docs, items: secret_scan.scan(docs),
    "leaks": lambda docs, items: decontamination.contaminated(docs, items),
    "language": lambda docs, items: language_id.identify(docs, language_id.fit(docs)),
    "mixing": lambda docs, items: mixing.mix(docs).select("doc_id", "text", "topic", "n_tokens", "probability"),
    "forest": lambda docs, items: quality_forest.judge(docs, labels_of(docs)),
}


@pytest.fixture(scope="module")
def plain_rows(awkward, items):
    """The rows of an operator on the awkward table, computed once."""
    known = {}

    def get(name):
        if name not in known:
            known[name] = sorted(OPERATORS[name](awkward, items).collect(), key=repr)
        return known[name]

    return get


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_names_change_nothing(awkward, items, plain_rows, name):
    run = OPERATORS[name]
    plain = plain_rows(name)
    assert sorted(run(with_clashes(awkward), with_clashes(items)).collect(), key=repr) == plain
    assert plain or name == "secrets"


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(awkward, items, name):
    assert OPERATORS[name](awkward.limit(0), items).count() == 0


def test_pages(spark):
    urls = ["http://m.example.org/a?b#c", None, "", "http://", "http://" + "a." * 3000 + "example.org/de/" + "x/" * 3000, "EXAMPLE.net/es/q", "http://u:p@[::1]:80/"]
    pages = spark.createDataFrame([(k, u, None) for k, u in enumerate(urls)] * 2 + [(None, urls[0], "x"), (None, None, None)], "page_id long, url string, html string")
    plain = sorted(url_filter.match_urls(pages, rules(spark)).collect(), key=repr)
    assert sorted(url_filter.match_urls(with_clashes(pages), rules(spark)).collect(), key=repr) == plain
    assert len(plain) == len(urls) + 2 and {r["action"] for r in plain if r["url"] is None} == {"none"}
    assert url_filter.match_urls(pages.limit(0), rules(spark)).count() == 0


@pytest.mark.parametrize("name", OPERATORS)
def test_ids_of_any_type(awkward, items, plain_rows, name):
    """String ids give as many rows as whole numbers do."""
    named = awkward.withColumn("doc_id", F.concat(F.lit("doc-"), "doc_id"))
    got, plain = OPERATORS[name](named, items).collect(), plain_rows(name)
    if name not in ("spans", "mixing", "forest"):  # there ids decide what is first, drawn or sampled
        assert len(got) == len(plain)
    assert all(r["doc_id"] is None or r["doc_id"].startswith("doc-") for r in got if "doc_id" in r)


def test_dropping_operators_keep_columns(awkward, items):
    docs = with_clashes(awkward)
    model = language_id.fit(docs)
    for out in (
        language_id.drop_rejected(docs, model),
        line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs)),
        simhash_dedup.drop_near_duplicates(docs),
        decontamination.drop_contaminated(docs, items),
        substring_dedup.remove_spans(docs, substring_dedup.repeated_spans(docs)),
    ):
        assert out.columns == docs.columns and 0 < out.count() <= docs.count()
        assert out.where("__id <> 'clash __id' OR __p <> 'clash __p' OR __text <> 'clash __text'").count() == 0


def test_copies_leave_one_document(awkward):
    left = [r["doc_id"] for r in simhash_dedup.drop_near_duplicates(awkward).collect()]
    assert 1 in left and not set(range(200, 205)) & set(left) and {100, 102, 103, None} <= set(left)
