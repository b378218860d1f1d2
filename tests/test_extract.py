import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sievewright.operators import extract, language_model

CODE = '''class foo:
    """About foo."""  # first
    def bar(self):
        """About bar."""
        return 1  # second
# third'''


def test_comments_and_docstrings():
    assert extract.comments_of("x=1 # a\n# b#c\ny=2\n", True) == " a bc"
    assert extract.comments_of(CODE) == "# first# second# third"
    assert extract.docstrings_of(CODE) == ["About foo.", "About bar."]
    assert extract.natural_text(CODE) == "About foo.\nAbout bar.\n\n first second third"
    assert extract.natural_text("def (") == "" and extract.natural_text("") == ""


def test_columns(spark):
    df = spark.createDataFrame([(1, CODE, "python"), (2, "def (", "java"), (3, None, "java"), (4, "", None), (5, "/* ab */ int x; // c", "java"), (6, "x", "no such")], "id int, code string, kind string")
    out = {r["id"]: r for r in extract.with_natural_text(df, "code").withColumns({"ok": extract.compiles(F.col("code")), "size": extract.comment_size(F.col("code"), F.col("kind"))}).collect()}
    assert out[1]["ok"] and not out[2]["ok"] and out[3]["ok"] is None
    assert out[1]["nl_size"] == len(out[1]["nl_text"]) and out[4]["nl_ratio"] is None
    assert out[5]["size"] == len("/* ab */") + len("// c") and out[6]["size"] is None and out[3]["size"] is None
    report = extract.compile_report(df, "code").first()
    assert (report["total"], report["valid"]) == (5, 3)


def test_language_info(spark):
    model = extract.NgramClassifier().fit([("the cat and the dog", "en"), ("der hund und die katze", "de")])
    df = spark.createDataFrame([("The dog\nund der",), (None,)], "t string").select(extract.language_info(F.col("t"), model).alias("i"))
    first, second = (r["i"] for r in df.collect())
    assert [x["language_line"] for x in first["on_lines"]] == ["en", "de"] and [x["number_characters_line"] for x in first["on_lines"]] == [7, 7]
    assert second is None or second["language"] is None


def plain_perplexity(texts, order):
    toks = [["<s>", *t, "</s>"] for t in texts]
    grams = Counter((tuple(t[max(0, i - n) : i]), t[i]) for t in toks for i in range(1, len(t)) for n in range(order) if n <= i)
    # one count for each length of history that exists
    total, kinds = Counter(), Counter()
    for (h, _), c in grams.items():
        total[h] += c
        kinds[h] += 1
    out = []
    for t in toks:
        score = 0.0
        for i in range(1, len(t)):
            p = 1 / (kinds[()] + 1)
            for n in range(min(order, i + 1)):
                h = tuple(t[i - n : i])
                p = max(grams[h, t[i]] - 0.75, 0) / total[h] + 0.75 * kinds[h] / total[h] * p
            score += math.log10(p)
        out.append(10 ** (-score / (len(t) - 2)) if len(t) > 2 else None)
    return out


def test_perplexity_against_a_plain_version(spark):
    texts = ["a b a b c", "a b", "c c c a", ""]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(9, None)], "id int, text string")
    got = {r["id"]: r["perplexity"] for r in language_model.perplexities(df, language_model.train(df, "text", 3), "id", "text", 3).collect()}
    want = dict(enumerate(plain_perplexity([t.split() for t in texts], 3)))
    assert set(got) == set(want)
    assert all(got[k] == (pytest.approx(v) if v is not None else None) for k, v in want.items())


def test_unseen_text_has_a_finite_perplexity(spark):
    model = language_model.train(spark.createDataFrame([("a b c",)], "text string"), "text", 2)
    out = language_model.perplexities(spark.createDataFrame([(1, "z y!")], "id int, text string"), model, "id", "text", 2).first()
    assert out["n_pieces"] == 3 and 0 < out["perplexity"] < math.inf
