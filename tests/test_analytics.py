import random

import pytest
from pyspark.sql import functions as F

from tests.graphs import column, f1
from weftgraph.graph import Graph
from weftgraph.operators import analytics, shaping, vertex
from weftgraph.plans.gas import VertexProgram, run

BASE = {0: 0.15, 1: 0.15, 5: 0.15, 7: 0.15}


@pytest.fixture(scope="module")
def directed(spark):
    return Graph.directed(f1(spark).select("src", "dst"), 8)


def test_universe_and_kinds(directed):
    kinds = column(directed.kinds(), "kind")
    assert {k for k, v in kinds.items() if v == "source"} == {1, 5}
    assert {k for k, v in kinds.items() if v == "regular"} == {2, 3, 6, 8}
    assert {k for k, v in kinds.items() if v == "sink"} == {4}
    assert {k for k, v in kinds.items() if v == "isolated"} == {0, 7}
    assert directed.n_edges() == 13


def test_degrees(directed):
    into = analytics.in_degree(directed)
    assert column(into, "degree") == {0: 0, 1: 0, 2: 1, 3: 3, 4: 5, 5: 0, 6: 2, 7: 0, 8: 2}
    assert [tuple(r) for r in vertex.topk(into, 3, F.col("degree")).collect()] == [(4, 5), (3, 3), (6, 2)]
    out = column(analytics.out_degree(directed), "degree")
    assert out == {0: 0, 1: 3, 2: 2, 3: 1, 4: 0, 5: 4, 6: 1, 7: 0, 8: 2}


@pytest.mark.parametrize(
    ("k", "defer", "four", "total"),
    [(1, True, 0.479375, 2.115), (2, True, 0.732476, 2.535179), (2, False, 0.682578, 2.485281), (20, True, 0.790314, 2.821488), (20, False, 0.790311, 2.821484), (None, True, 0.790314, 2.821488)],
)
def test_pagerank(directed, k, defer, four, total):
    ranks = column(analytics.pagerank(directed, k, defer_sinks=defer), "rank")
    assert ranks[4] == pytest.approx(four, abs=1e-5)
    assert sum(ranks.values()) == pytest.approx(total, abs=1e-5)
    assert {k: ranks[k] for k in BASE} == BASE


def test_shortest_paths(spark):
    g = Graph.directed(f1(spark), 8, order="ord")
    found = column(analytics.sssp(g, 5), "distance")
    assert found == {0: None, 1: None, 2: None, 3: 115, 4: 44, 5: 0, 6: 94, 7: None, 8: 82}
    assert sum(2147483647 if d is None else d for d in found.values()) == 8589934923


def test_first_weight_wins(spark):
    g = Graph.directed(f1(spark, extra=[(3, 4, 1)]), 8, order="ord")
    assert {(r.src, r.dst): r.weight for r in g.edges.collect()}[3, 4] == 71


def test_bfs_and_components(spark):
    g = Graph.undirected(f1(spark).select("src", "dst"), 8)
    found = {r.id: (r.hops, r.parent) for r in analytics.bfs(g, 5).collect()}
    assert found == {0: (None, None), 7: (None, None), 5: (0, 0), 3: (1, 5), 4: (1, 5), 6: (1, 5), 8: (1, 5), 1: (2, 4), 2: (2, 4)}
    labels = column(analytics.connected_components(g), "label")
    assert labels == {0: 0, 7: 7, **dict.fromkeys([1, 2, 3, 4, 5, 6, 8], 1)}


def test_triangles(spark):
    found = column(analytics.triangles(f1(spark), 8), "triangles")
    assert {k: v for k, v in found.items() if v} == {2: 2, 3: 2, 4: 1, 5: 1, 6: 1}
    dag = Graph.directed(f1(spark).select("src", "dst"), 8, acyclic=True)
    assert column(analytics.in_neighbours(dag), "neighbours")[8] == [4, 5, 6]


def test_random_graphs_against_plain_python(spark):
    rng = random.Random(7)
    pairs = [(rng.randrange(40), rng.randrange(40)) for _ in range(70)]
    rng.shuffle(pairs)
    edges = spark.createDataFrame(pairs, "src long, dst long")
    near = {v: set() for v in range(41)}
    for a, b in pairs:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    label, hops = {}, {0: 0}
    for v in range(41):
        if v not in label:
            todo = [v]
            while todo:
                x = todo.pop()
                if x not in label:
                    label[x] = v
                    todo += near[x]
    level = [0]
    while level:
        level = sorted({y for x in level for y in near[x]} - hops.keys())
        hops |= dict.fromkeys(level, max(hops.values()) + 1)
    g = Graph.undirected(edges, 40)
    assert column(analytics.connected_components(g), "label") == label
    found = column(analytics.bfs(g, 0), "hops")
    assert found == {v: hops.get(v) for v in range(41)}
    total = sum(1 for a in near for b in near[a] for c in near[a] if a < b < c and c in near[b])
    assert sum(column(analytics.triangles(edges, 40), "triangles").values()) == total


def test_empty_graph(spark):
    g = Graph.directed(spark.createDataFrame([], "src long, dst long"), 2)
    assert column(analytics.in_degree(g), "degree") == {0: 0, 1: 0, 2: 0}
    assert column(analytics.pagerank(g), "rank") == {0: 0.15, 1: 0.15, 2: 0.15}
    assert column(analytics.triangles(g.edges, 2), "triangles") == {0: 0, 1: 0, 2: 0}


def test_bipartite_and_shaping(spark):
    edges = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (2, 2)], "src long, dst long")
    g = Graph.bipartite(edges, 2, 2, directed=False)
    assert sorted(map(tuple, g.edges.collect())) == [(1, 3), (1, 4), (2, 4), (3, 1), (4, 1), (4, 2)]
    assert (g.n, g.n_left, g.n_right, g.is_bipartite, g.is_directed) == (4, 2, 2, True, False)
    assert sorted(map(tuple, shaping.reverse(edges).collect())) == [(1, 1), (2, 1), (2, 2), (2, 2)]


def test_vertex_operators(spark):
    state = spark.createDataFrame([(0, 5.0, True), (1, None, True), (2, 5.0, False), (3, 1.0, True)], "id long, x double, active boolean")
    assert [r.id for r in vertex.topk(state, 9, F.col("x")).collect()] == [0, 2, 3]
    assert vertex.reduce(state, F.col("x"), active_only=True).first()[0] == 6.0
    assert [r.id for r in vertex.display(state, 2).collect()] == [0, 1, 2]
    best = vertex.batched_topk(state, 1, F.array(F.col("x"), -F.col("x")))
    assert sorted((r.batch, r.id) for r in best.collect()) == [(0, 0), (1, 3)]
    a, b = state.where("id < 2"), state.where("id > 0")
    assert sorted(r.id for r in vertex.union(a, b).collect()) == [0, 1, 2, 3]
    assert [r.id for r in vertex.intersect(a, b).collect()] == [1]
    assert [r.id for r in vertex.difference(a, b).collect()] == [0]
    assert [r.id for r in vertex.rest(state, a, state.where("id = 3")).collect()] == [2]


def test_untouched_vertices_keep_state_and_subset(spark):
    g = Graph.directed(spark.createDataFrame([(0, 1), (2, 3)], "src long, dst long"), 4)
    program = VertexProgram(init={"x": F.col("id")}, active=F.lit(True), message=F.col("x") + 10, combine=F.sum, apply=lambda i: {"x": F.col("acc")})
    assert column(run(program, g, 1), "x") == {0: 0, 1: 10, 2: 2, 3: 12, 4: 4}
    assert column(run(program, g, 1, subset=spark.createDataFrame([(2,)], "id long")), "x") == {0: 0, 1: 1, 2: 2, 3: 12, 4: 4}
