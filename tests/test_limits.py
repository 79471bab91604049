"""Runs to convergence that end before it are errors."""

import os

import pytest
from pyspark.sql import functions as F

from weftgraph.graph import Graph
from weftgraph.operators import analytics
from weftgraph.operators.simulation import simulate
from weftgraph.plans.gas import VertexProgram, run


def test_program_that_does_not_converge_raises(spark):
    g = Graph.directed(spark.createDataFrame([(i, i + 1) for i in range(1, 7)], "src long, dst long"), 7)
    hops = VertexProgram({"hops": F.when(F.col("id") == 1, 0)}, F.col("id") == 1, F.col("hops") + 1, F.min, lambda i: {"hops": F.least("hops", "acc")}, F.col("old_hops").isNull())
    with pytest.raises(RuntimeError, match="converge"):
        run(hops, g, limit=3)
    assert {r.id: r.hops for r in run(hops, g, max_iters=3).collect()}[4] == 3
    assert {r.id: r.hops for r in run(hops, g).collect()}[7] == 6


def test_simulation_that_does_not_converge_raises(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 7)], "src long, dst long")
    labels = spark.createDataFrame([(i, "a") for i in range(1, 8)], "id long, label string")
    pattern = spark.createDataFrame([(1, 1)], "src long, dst long"), spark.createDataFrame([(1, "a")], "q long, label string")
    with pytest.raises(RuntimeError, match="converge"):
        simulate(edges, labels, *pattern, limit=2)
    assert simulate(edges, labels, *pattern).count() == 0


def test_rounds_leave_no_states_behind(spark):
    def left():
        where = (spark.sparkContext.getCheckpointDir() or "").removeprefix("file:")
        return sum(x.startswith("rdd-") for x in os.listdir(where)) if os.path.isdir(where) else 0

    g = Graph.directed(spark.createDataFrame([(i, i + 1) for i in range(1, 8)], "src long, dst long"), 8)
    before = left()
    assert max(r.hops or 0 for r in analytics.bfs(g, 1).collect()) == 7
    assert 0 < left() - before <= 2
