"""A runner for vertex programs: each round is one equi-join and one aggregation.

A program says, in column expressions, what a vertex starts with, what it sends, what an
edge makes of that, how messages meet, and what a vertex that got any becomes.  The runner
turns a round into

    frontier(src, msg) join edges on src -> group by dst, combine -> left join on id

and cuts the lineage after it; how many vertices became active is observed in the job that
computes the round, so a round of a stationary program costs one job; other programs' plans
adapt to their frontier, in a job for each shuffle.  Vertices that got no message keep their
state: the join is a left join and apply holds only where something arrived.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from weftgraph.graph import Graph
from weftgraph.plans.scratch import cut, fixed_plans, uncut

Combine = Callable[[Column], Column]


@dataclass
class VertexProgram:
    """Expressions of a program.

    init: state columns over ``id`` (and the columns of a given state); active: which
    vertices send at first.  message: over the state.  gather: over ``msg``, the edge's
    columns and, with uses_dst_state, the receiver's first state as ``dst_<column>``.
    combine: an aggregate.  apply(iteration): new state columns over the old ones and
    ``acc``.  activate: over the new state and ``old_<column>``, whether the vertex sends
    next.  stationary: whoever got a message sends, and sources send in every round.
    """

    init: dict[str, Column]
    active: Column
    message: Column
    combine: Combine
    apply: Callable[[int], dict[str, Column]]
    activate: Column = field(default_factory=lambda: F.lit(True))
    gather: Column = field(default_factory=lambda: F.col("msg"))
    stationary: bool = False
    uses_dst_state: bool = False

    def initialise(self, vertices: DataFrame, subset: DataFrame | None = None) -> DataFrame:
        """First states; with subset(id) only its vertices get to be active."""
        active = F.coalesce(self.active, F.lit(False))
        out = vertices.select("id", *[c.alias(k) for k, c in self.init.items()], active.alias("active"))
        if subset is not None:
            chosen = subset.select("id").distinct().withColumn("__in", F.lit(True))
            out = out.join(chosen, "id", "left").withColumn("active", F.col("active") & F.coalesce("__in", F.lit(False))).drop("__in")
        return out


def accumulate(program: VertexProgram, senders: DataFrame, edges: DataFrame, snapshot: DataFrame | None = None) -> DataFrame:
    """(dst, acc): what the messages of ``senders`` come to at each receiver."""
    sent = senders.select(F.col("id").alias("src"), program.message.alias("msg"))
    carried = sent.join(edges, "src")
    if program.uses_dst_state:
        names = [c for c in snapshot.columns if c not in ("id", "active")]
        carried = carried.join(snapshot.select(F.col("id").alias("dst"), *[F.col(c).alias(f"dst_{c}") for c in names]), "dst")
    return carried.groupBy("dst").agg(program.combine(program.gather).alias("acc"))


def absorb(program: VertexProgram, state: DataFrame, acc: DataFrame, iteration: int, sources: bool) -> DataFrame:
    """The state after a round, with ``active``, and ``moved`` where activate held."""
    names = [c for c in state.columns if c not in ("id", "active", "moved", "kind")]
    joined = state.join(acc.withColumn("__got", F.lit(True)), state["id"] == acc["dst"], "left")
    got = F.col("__got").isNotNull()
    new = program.apply(iteration)
    out = joined.select("id", *([F.col("kind")] if "kind" in state.columns else []), *[F.when(got, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in names], *[F.col(c).alias(f"old_{c}") for c in names], F.col("active").alias("__was"), got.alias("__got"))
    out = out.withColumn("moved", F.col("__got") & F.coalesce(program.activate, F.lit(False)))
    goes = F.col("__got") if program.stationary else F.col("moved")
    if program.stationary and sources:
        goes = goes | (F.col("__was") & (F.col("kind") == "source"))
    out = out.withColumn("active", goes)
    return out.drop("__was", "__got", *[f"old_{c}" for c in names])


def run(program: VertexProgram, graph: Graph, max_iters: int | None = None, defer_sinks: bool = False, state: DataFrame | None = None, subset: DataFrame | None = None, limit: int = 10_000) -> DataFrame:
    """Runs to convergence or for ``max_iters`` rounds; returns (id, state columns, active).

    Convergence is a round in which no vertex that has edges in and out was moved; it is an
    error if ``limit`` rounds do not reach it.  With
    ``defer_sinks`` vertices that only receive are left out of the rounds and computed once
    after them, from all final states; with one round they are part of it.

    state(id, ...) is where another program ended: init may use its columns, so programs
    follow each other on one graph or on a graph and its reversal.  subset(id) limits who
    sends at first.
    """
    if program.stationary:
        # the frontier is all vertices in every round, so there is nothing to adapt to
        with fixed_plans(graph.edges.sparkSession):
            return _rounds(program, graph, max_iters, defer_sinks, state, subset, limit)
    return _rounds(program, graph, max_iters, defer_sinks, state, subset, limit)


def _rounds(program: VertexProgram, graph: Graph, max_iters: int | None, defer_sinks: bool, state: DataFrame | None, subset: DataFrame | None, limit: int) -> DataFrame:
    vertices = state if state is not None else graph.vertices
    first = program.initialise(vertices, subset)
    if program.stationary or defer_sinks:
        first = first.join(graph.kinds(), "id")
    now = cut(first)
    edges = graph.edges
    defer = defer_sinks and max_iters != 1
    if defer:
        sinks = now.where("kind = 'sink'").select(F.col("id").alias("dst"))
        to_sinks = edges.join(sinks, "dst", "left_semi")
        edges = edges.join(sinks, "dst", "left_anti")
    # dealt by source once, so that a round shuffles messages and not edges
    edges = edges.repartition(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), "src")
    # of plans that are run as they are, the cut table has the dealing by source for all rounds
    dealt = cut(edges) if program.stationary else edges
    edges = dealt.persist()
    snapshot = now if program.uses_dst_state else None
    start = now.where("active")
    rounds = 0
    while rounds < (max_iters or limit):
        acc = accumulate(program, now.where("active"), edges, snapshot)
        seen = Observation(f"round{rounds}")
        nxt = absorb(program, now, acc, rounds, sources=True)
        before, now = now, cut(nxt.observe(seen, F.count_if("moved").alias("moved")).drop("moved"))
        if rounds:  # the first states are read again
            uncut(before)
        rounds += 1
        if seen.get["moved"] == 0:
            break
    else:
        if not max_iters:
            raise RuntimeError(f"the program did not converge in {limit} rounds")
    edges.unpersist()
    if program.stationary:
        uncut(dealt)
    if defer:
        senders = now.where("kind = 'regular'").unionByName(start.where("kind = 'source'"))
        now = absorb(program, now, accumulate(program, senders, to_sinks, snapshot), rounds, sources=False).drop("moved")
    return now.drop("kind")
