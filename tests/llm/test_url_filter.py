import re

import duckdb
import pyarrow as pa
import pytest

from sievewright.llm import queries
from sievewright.llm import url_filter as U

RULES = [
    (1, "bad.example/", "block"),
    (2, "http://bad.example/ok/", "allow"),
    (3, "sub.bad.example/ok/", "block"),
    (4, "bad.example/ok/page?x=1", "block"),
    (5, "good.example/a", "block"),
    (6, "good.example/a", "allow"),
    (7, "192.0.2.7/", "block"),
    (8, None, "block"),
    (9, "x.example/", None),
    (10, "a.b.c.d.deep.example/1/2/3/", "block"),
]


def plain(m):
    c = chr(int(m[1], 16))
    return c if c.isascii() and (c.isalnum() or c in "-._~") else m[0].upper()


def host_path(u):
    u = re.sub("%([0-9A-Fa-f]{2})", plain, (u or "").strip(" ")).split("#")[0]
    head, sep, tail = u.partition("://")
    u = tail if sep else u
    k = min([i for i in (u.find("/"), u.find("?")) if i >= 0], default=len(u))
    host = u[:k].rpartition("@")[2]
    if ":" in host and host.rpartition(":")[2].isdigit():
        host = host.rpartition(":")[0]
    rest = u[k:]
    path, q, query = rest.partition("?")
    if "/." in path:
        kept = []
        for x in (path + "/" if re.search("/[.][.]?$", path) else path).split("/")[1:]:
            if x == "..":
                kept = kept[:-1]
            elif x != ".":
                kept.append(x)
        path = "/" + "/".join(kept)
    return host.lower().strip("."), path or "/", (path or "/") + q + query


def brute(url):
    """Every rule against the URL by definition, without hashes or expansion."""
    host, path, full = host_path(url)
    if not host:
        return "none", -1
    hits = []
    for i, pattern, action in RULES:
        if pattern is None or action is None:
            continue
        h, p, f = host_path(pattern)
        fits = host == h or host.endswith("." + h) and h.count(".") >= 1 and not host.replace(".", "").isdigit()
        if fits and (f in (full, path) or f.endswith("/") and path.startswith(f)):
            hits.append((-h.count("."), -len(f), action, i))
    return (min(hits)[2], min(hits)[3]) if hits else ("none", -1)


URLS = [
    "http://bad.example",
    "https://u:p@BAD.example.:8080/ok/page",
    "http://bad.example/ok/page?x=1#frag",
    "http://sub.bad.example/ok/deep/er",
    "http://notbad.example/",
    "good.example/a",
    "good.example/a/b",
    "http://192.0.2.7/x",
    "http://9.192.0.2.7/x",
    "http://z.a.b.c.d.deep.example/1/2/3/4/5/6",
    "http://deep.example/1/2/3/",
    "http://x.example/" + "s/" * 3000,
    "?",
    "",
    None,
    "//",
    "http://bad.example//ok//page",
    "http://bad.example/no/../ok/page",
    "http://bad.example/ok/../../../x",
    "http://bad.example/ok/.",
    "http://bad.example/x/..",
    "http://bad%2Eexample/%6fk/p%61ge?x=1",
    "http://good.example/%c3%a9/../a",
    "http://good.example/%2e%2E/a",
    "http://good.example/%61%",
    "http://good.example/a%2",
    "http://good.example/...%2fa",
]


def test_matches_every_rule_by_definition(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").selectExpr("*", "'h' AS host", "'p' AS prefix", "0 AS labels")
    rules = spark.createDataFrame(RULES, "rule_id long, pattern string, action string")
    for limit in (200_000, 0):
        got = {r["page_id"]: (r["action"], r["rule_id"]) for r in U.match_urls(pages, rules, broadcast_rules=limit).collect()}
        assert got == {i: brute(u) for i, u in enumerate(URLS)}


def test_edge_cases(spark):
    rules = spark.createDataFrame(RULES, "rule_id long, pattern string, action string")
    schema = "page_id long, url string"
    twice = spark.createDataFrame([(1, URLS[0])] * 3 + [(None, URLS[0])], schema)
    assert sorted((str(r["page_id"]), r["action"]) for r in U.match_urls(twice, rules).collect()) == [("1", "block"), ("None", "block")]
    assert U.match_urls(spark.createDataFrame([], schema), rules).count() == 0
    assert [r["action"] for r in U.match_urls(twice, rules.limit(0)).collect()] == ["none", "none"]


@pytest.mark.parametrize("names", [("host", "url"), ("prefix", "path"), ("expression", "digest"), ("page", "sha"), ("a b", "rule_id ")])
def test_columns_of_any_name_and_ids_of_any_type(spark, names):
    rules = spark.createDataFrame(RULES, "rule_id long, pattern string, action string")
    some = [u for u in URLS if len(u or "") < 1000]
    pages = spark.createDataFrame([(f"p{k}", u) for k, u in enumerate(some)], "i string, u string").toDF(*names)
    out = U.match_urls(pages, rules, *names)
    assert out.columns == [*names, "action", "rule_id", "expression"]
    got = out.collect()
    assert {r[0]: (r[2], r[3]) for r in got} == {f"p{i}": brute(u) for i, u in enumerate(some)} and len(got) == len(some)


def test_sql_brings_urls_to_the_same_form(spark):
    got = U.split_urls(spark.createDataFrame(list(enumerate(URLS)), "i long, url string"), U.F.coalesce("url", U.F.lit("")), "i").collect()
    con = duckdb.connect()
    t = pa.table({"i": list(range(len(URLS))), "url": URLS})
    con.register("t", t)
    assert sorted(map(tuple, got)) == sorted(con.execute(queries._split_sql("t", "url", "i")).fetchall())
    assert [tuple(r)[1:] for r in sorted(got)] == [host_path(u) for u in URLS]
