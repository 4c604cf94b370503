import random

from tamarack.llm.components import components
from tamarack.scratch import Scratch


def brute(edges):
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    return {x: find(x) for x in root}


def test_labels_are_the_least_nodes(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(300 - i, 299 - i) for i in range(40)]
    edges += [(rng.randrange(400, 700), rng.randrange(400, 700)) for _ in range(200)]
    edges += [(1000, i) for i in range(1001, 1060)] + [(i, 1000) for i in range(940, 990)] + [(5, 5), (7, 7), (5, 5)]
    edges += [(a, b) for a in range(2000, 2030) for b in range(2000, 2030)]
    tables = Scratch(spark, "components-test")
    got = components(tables, spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.label for r in got} == brute(edges) and len(got) == len(brute(edges))


def test_no_edges(spark):
    assert components(Scratch(spark, "components-test"), spark.createDataFrame([], "a long, b long")).count() == 0
