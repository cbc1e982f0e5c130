import random

from attestor.llm.common import Workspace
from attestor.llm.components import connected_components, stars


def _components(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return sorted((x, find(x)) for x in parent)


def test_random_graphs_chains_and_hubs(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)]
    edges += [(1000 + i, 1001 + i) for i in range(70)] + [(2000, 2000 + i) for i in range(200)]
    edges += [(5, 5), (7, None), (None, 8), edges[0], edges[0]]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    want = sorted((x, find(x)) for x in parent)
    got = connected_components(spark.createDataFrame(edges, "a long, b long"), Workspace(spark, "t")).collect()
    assert sorted((r.node, r.component) for r in got) == want


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "a string, b string"), Workspace(spark, "t")).collect() == []


def test_stars_join_what_edges_join(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + a, 100 + b) for a in range(30) for b in range(30)] + [(-3, None)]
    rows = spark.createDataFrame(edges, "a long, b long").repartition(4)
    for each in (len(edges), 100):
        got = [(r.a, r.b) for r in stars(rows, len(edges), each).collect()]
        assert _components(got) == _components([e for e in edges if e[1] is not None and e[0] != e[1]])
        assert len(got) < 90 * -(-len(edges) // each)
    assert stars(rows.limit(0), 0).collect() == []
