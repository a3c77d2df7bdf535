"""Graph operators and the partitioner on small graphs."""

import random

import pytest

from lattica.operators import graph as G
from lattica.operators import partition as P

EDGES = [(0, 1, 2.0), (0, 2, 1.0), (1, 3, 4.0), (2, 3, 1.0), (0, 3, 5.0), (4, 5, 1.0)]


@pytest.fixture(scope="module")
def g(spark):
    e = spark.createDataFrame(EDGES, "u long, v long, w double").cache()
    v = spark.range(7).selectExpr("id", "cast(id + 1 AS double) AS w")
    return e, v


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_levels(g):
    assert rows(G.top_levels(*g)) == [(0, 0.0), (1, 1.0), (2, 1.0), (3, 2.0), (4, 0.0), (5, 1.0), (6, 0.0)]
    assert dict(rows(G.bottom_levels(*g)))[0] == 2.0
    assert dict(rows(G.top_levels(*g, step="w")))[3] == 6.0


def test_order_is_topological(g):
    place = {v: k for k, v in enumerate(G.depth_first_order(*g))}
    assert all(place[u] < place[v] for u, v, _ in EDGES) and len(place) == 7


def test_cycle(spark, g):
    e, v = g
    c = e.union(spark.createDataFrame([(3, 0, 1.0)], e.schema))
    assert rows(G.is_acyclic(c, v)) == [(False,)] and rows(G.is_acyclic(e, v)) == [(True,)]


def test_components_distances_reduction(g):
    e, v = g
    assert rows(G.connected_components(e, v)) == [(0, 0), (1, 0), (2, 0), (3, 0), (4, 4), (5, 4), (6, 6)]
    assert rows(G.distances(e, v.where("id = 0"))) == [(0, 0), (1, 1), (2, 1), (3, 1)]
    assert (0, 3, 5.0) not in rows(G.transitive_reduction(e)) and G.transitive_reduction(e).count() == 5


def test_long_chain_takes_few_rounds(spark):
    e = spark.range(500).selectExpr("id AS u", "id + 1 AS v", "1.0D AS w")
    v = spark.range(501).selectExpr("id", "1.0D AS w")
    assert G.connected_components(e, v, max_rounds=20).where("component <> 0").count() == 0


def test_metrics(spark, g):
    e, v = g
    p = spark.createDataFrame([(0, 0), (1, 0), (2, 1), (3, 1), (4, 0), (5, 1), (6, 0)], "id long, part int")
    assert rows(P.edge_cut(e, p)) == [(1.0 + 4.0 + 5.0 + 1.0, 4)]
    assert rows(P.communication_volume(e, p)) == [(1.0 + 4.0 + 1.0, 3)]
    assert rows(P.latency(e, v, p)) == [(14.0,)]
    q = rows(G.quotient(e, p))
    assert sum(w for a, b, n, w in q if a != b) == 11.0


def test_fix_acyclicity(spark):
    e = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (2, 3, 1.0)], "u long, v long, w double")
    p = spark.createDataFrame([(0, 0), (1, 1), (2, 0), (3, 0)], "id long, part int")
    assert rows(P.fix_acyclicity(e, p)) == [(0, 0), (1, 1), (2, 1), (3, 1)]


@pytest.mark.parametrize("stop", [1000, 40])
def test_partition_is_acyclic(spark, stop):
    r = random.Random(2)
    edges = sorted({(a, b) for a, b in ((r.randrange(60), r.randrange(60)) for _ in range(90)) if a < b})
    e = spark.createDataFrame([(a, b, 1.0) for a, b in edges], "u long, v long, w double")
    v = spark.range(60).selectExpr("id", "1.0D AS w")
    p = P.acyclic_partition(e, v, 4, stop_size=stop)
    part = dict(rows(p))
    assert len(part) == 60 and set(part.values()) == {0, 1, 2, 3}
    # Parts are numbered downstream, so no edge goes to a lower one.
    assert all(part[a] <= part[b] for a, b in edges)
