import random

from sievewright.operators.graph import connected_components


def brute(edges):
    root = {}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root.setdefault(a, a)
        root.setdefault(b, b)
        ra, rb = find(a), find(b)
        root[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in root}


def test_components_match_union_find(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(25)] + [(300, 300)]
    df = spark.createDataFrame(edges, "src long, dst long")
    got = {r["id"]: r["component"] for r in connected_components(df).collect()}
    assert got == brute(edges)


def test_components_of_nothing_and_nulls(spark):
    empty = spark.createDataFrame([], "src long, dst long")
    assert connected_components(empty).count() == 0
    df = spark.createDataFrame([(None, 1), (2, None), (4, 3)], "src long, dst long")
    got = {r["id"]: r["component"] for r in connected_components(df).collect()}
    assert got == {3: 3, 4: 3}
