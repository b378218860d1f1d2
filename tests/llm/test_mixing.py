import numpy as np
import pandas as pd

from sievewright.llm import mixing as M


def corpus():
    rows = []
    for i in range(600):
        s, lang = ("big", "a", "b")[min(2, i // 250)], ("en", "de")[i % 3 == 0]
        t = "one two three" + (" | four" if i % 5 == 0 else "") + " x" * (i % 7)
        rows.append((i, t, lang, s, len(t)))
    return rows


def test_rake_reaches_feasible_marginals():
    cells = pd.DataFrame([(s, lang, t, 1000.0 + 100 * k) for k, (s, lang, t) in enumerate((s, lang, t) for s in "ab" for lang in "xy" for t in "pq")], columns=["source", "lang", "topic", "tokens"])
    targets = {"source": pd.Series({"a": 0.6, "b": 0.4}), "lang": pd.Series({"x": 0.3, "y": 0.7}), "topic": pd.Series({"p": 0.5, "q": 0.5})}
    w = cells["tokens"] * M.rake(cells, targets, 0.3)
    assert abs(w.sum() - 0.3 * cells["tokens"].sum()) < 1e-6 * w.sum()
    for axis, want in targets.items():
        got = w.groupby(cells[axis]).sum() / w.sum()
        assert np.allclose(got[want.index], want, atol=1e-6)


def test_driver_and_frame_raking_agree(docs_of):
    df = docs_of(corpus())
    a = M.mix(df, rounds=4).toPandas().sort_values("doc_id", ignore_index=True)
    b = M.mix(df, rounds=4, driver_cells=0).toPandas().sort_values("doc_id", ignore_index=True)
    assert a["doc_id"].tolist() == b["doc_id"].tolist() and a["probability"].tolist() == b["probability"].tolist()
    targets = {"lang": {"en": 1.0, "de": 3.0}}
    a = M.mix(df, rounds=4, targets=targets).toPandas()
    b = M.mix(df, rounds=4, targets=targets, driver_cells=0).toPandas()
    assert set(a["doc_id"]) == set(b["doc_id"])


def test_draw_follows_the_probabilities(docs_of):
    out = M.mix(docs_of(corpus()), targets={"lang": {"en": 1, "de": 1}}, budget=0.3).toPandas()
    share = out.groupby("lang")["n_tokens"].sum() / out["n_tokens"].sum()
    assert abs(share["de"] - 0.5) < 0.08
    assert abs(out["n_tokens"].sum() / sum(M_tokens(r[1]) for r in corpus()) - 0.3) < 0.05


def M_tokens(t):
    return len((t or "").split())


def test_edge_cases(docs_of):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "a b", None, "s", 3), (3, "a b", None, "s", 3), (None, "a b c", "en", None, 5)]
    df = docs_of(rows).selectExpr("*", "'mine' AS topic", "7 AS tokens", "'k' AS probability")
    out = M.mix(df, budget=1.0)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "tokens", "topic", "n_tokens", "probability"]
    got = out.collect()
    assert {r["probability"] for r in got} <= {1.0} and all(r["tokens"] == 7 for r in got)
    assert len([r for r in got if r["doc_id"] == 3]) in (0, 2)
    assert M.mix(docs_of([])).count() == 0


def test_raking_ends_when_it_has_converged():
    cells = pd.DataFrame([(s, lang, "p", 100.0) for s in "ab" for lang in "xy"], columns=["source", "lang", "topic", "tokens"])
    targets = {"source": pd.Series({"a": 0.7, "b": 0.3}), "lang": pd.Series({"x": 0.4, "y": 0.6}), "topic": pd.Series({"p": 1.0})}
    assert np.allclose(M.rake(cells, targets, 0.3, rounds=3), M.rake(cells, targets, 0.3, rounds=4000), atol=1e-12)


def test_marginals_of_the_draw_are_the_targets(docs_of):
    for cells in (1_000_000, 0):
        p, n = M.probabilities(docs_of(corpus()), targets={"lang": {"en": 1, "de": 1}}, budget=0.2, driver_cells=cells)
        got = {(r["axis"], r["value"]): r for r in M.marginals(p).collect()}
        assert n == p.count() and abs(got["lang", "de"]["share_after"] - 0.5) < 1e-5 and got["lang", "de"]["share_before"] < 0.4
        want = {s: sum(M_tokens(r[1]) for r in corpus() if r[3] == s) ** 0.5 for s in ("big", "a", "b")}
        assert all(abs(got["source", s]["share_after"] - w / sum(want.values())) < 1e-5 for s, w in want.items())
