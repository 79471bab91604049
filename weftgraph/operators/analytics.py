"""Graph analytics: degrees, PageRank, shortest paths, components, triangles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.graph import Graph
from weftgraph.operators import shaping
from weftgraph.plans.components import star_components
from weftgraph.plans.gas import VertexProgram, run
from weftgraph.plans.scratch import Scratch, cut

DAMPING, REST = 0.85, 0.15


def in_degree(graph: Graph) -> DataFrame:
    """(id, degree) for the whole universe."""
    counted = graph.edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("degree"))
    return graph.vertices.join(counted, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def out_degree(graph: Graph) -> DataFrame:
    return in_degree(graph.reversed())


def pagerank(graph: Graph, iterations: int | None = None, tolerance: float = 1e-5, defer_sinks: bool = True) -> DataFrame:
    """(id, rank): 0.15 + 0.85 * sum of rank(u) / out-degree(u) over in-neighbours, from 0.15
    everywhere; not normalised, nothing handed round from dangling vertices.

    Vertices without edges in stay at 0.15.  Without ``iterations`` it runs until no vertex
    with edges in and out moves by more than ``tolerance``.  With ``defer_sinks`` vertices
    without edges out get their rank once, from the others' last ranks; without, in every
    round like the rest.
    """
    out = graph.edges.groupBy("src").agg((F.lit(1.0) / F.count("*")).alias("share"))
    # the sender's share rides on its edges: no round has to join the degrees again
    edges = graph.edges.select("src", "dst").join(out, "src")
    program = VertexProgram(
        init={"rank": F.lit(REST)},
        active=F.lit(True),
        message=F.col("rank"),
        gather=F.col("msg") * F.col("share"),
        combine=F.sum,
        apply=lambda i: {"rank": F.lit(REST) + F.lit(DAMPING) * F.col("acc")},
        activate=F.abs(F.col("rank") - F.col("old_rank")) > tolerance if iterations is None else F.lit(True),
        stationary=True,
    )
    return run(program, Graph(edges, graph.n), iterations, defer_sinks=defer_sinks).select("id", "rank")


def sssp(graph: Graph, root: int) -> DataFrame:
    """(id, distance): the least sum of weights from root along edges; null if unreached."""
    near = F.least("acc", "distance")  # least() skips nulls
    program = VertexProgram(
        init={"distance": F.when(F.col("id") == root, F.lit(0)).cast("long")},
        active=F.col("id") == root,
        message=F.col("distance"),
        gather=F.col("msg") + F.col("weight"),
        combine=F.min,
        apply=lambda i: {"distance": near},
        activate=F.col("old_distance").isNull() | (F.col("distance") < F.col("old_distance")),
    )
    return run(program, graph).select("id", "distance")


def bfs(graph: Graph, root: int) -> DataFrame:
    """(id, hops, parent) over an undirected graph; null if unreached.  Root has 0 and 0;
    of several parents the largest id counts."""
    new = F.col("hops").isNull()
    program = VertexProgram(
        init={"hops": F.when(F.col("id") == root, F.lit(0)).cast("int"), "parent": F.when(F.col("id") == root, F.lit(0)).cast("long")},
        active=F.col("id") == root,
        message=F.col("id"),
        combine=F.max,
        apply=lambda i: {"hops": F.when(new, F.lit(i + 1)).otherwise(F.col("hops")), "parent": F.when(new, F.col("acc")).otherwise(F.col("parent"))},
        activate=F.col("old_hops").isNull(),
    )
    return run(program, graph).select("id", "hops", "parent")


def connected_components(graph: Graph) -> DataFrame:
    """(id, label) over an undirected graph: the smallest id of the component; by stars, in
    rounds that do not grow with the diameter as handing labels on would."""
    found = star_components(graph.edges, Scratch(graph.edges.sparkSession, "components"))
    return graph.vertices.join(found, "id", "left").select("id", F.coalesce("component", "id").alias("label"))


def in_neighbours(graph: Graph) -> DataFrame:
    """(id, neighbours): the sources of a vertex's edges, ascending; only where there are any."""
    return graph.edges.groupBy(F.col("dst").alias("id")).agg(F.sort_array(F.collect_list("src")).alias("neighbours"))


def triangles(edges: DataFrame, n: int) -> DataFrame:
    """(id, triangles): triangles whose middle id it is, whatever the edges' directions.

    They are found by degree, so a hub of a low id starts no more paths than any other.
    """
    middle = F.sort_array(F.array("a", "b", "c"))[1]
    counted = _closed(edges).groupBy(middle.alias("id")).agg(F.count("*").alias("triangles"))
    universe = edges.sparkSession.range(0, n + 1)
    return universe.join(counted, "id", "left").select("id", F.coalesce("triangles", F.lit(0)).cast("long").alias("triangles"))


def triangle_total(edges: DataFrame) -> DataFrame:
    """One row: triangles in all."""
    return _closed(edges).agg(F.count("*").alias("triangles"))


def _closed(edges: DataFrame) -> DataFrame:
    """(b, c, a): each triangle once.

    Edges go from ends of few neighbours to ends of more, so a hub starts few paths and the
    paths grow as the edges to the power 1.5 at most.  Paths meet by joins whose skewed
    partitions can be split; no neighbour list is shipped.
    """
    pairs = cut(shaping.dedupe(shaping.orient_acyclic(shaping.drop_loops(edges.select("src", "dst")))))
    degree = shaping.symmetrise(pairs).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("d"))
    ranked = pairs.join(degree.select(F.col("id").alias("src"), F.col("d").alias("ds")), "src").join(degree.select(F.col("id").alias("dst"), F.col("d").alias("dd")), "dst")
    up = F.struct("ds", "src") < F.struct("dd", "dst")
    dag = cut(ranked.select(F.when(up, F.col("src")).otherwise(F.col("dst")).alias("src"), F.when(up, F.col("dst")).otherwise(F.col("src")).alias("dst")))
    ab, ac = dag.select(F.col("src").alias("a"), F.col("dst").alias("b")), dag.select(F.col("src").alias("a"), F.col("dst").alias("c"))
    paths = ab.join(ac, "a").where("b <> c")
    return paths.join(dag.select(F.col("src").alias("b"), F.col("dst").alias("c")), ["b", "c"], "left_semi")
