"""Connected components: forests inside tasks, then large-star and small-star rounds.

First each task turns the edges that it holds, up to a fixed number at a time, into stars
on their smallest ids, so no edge that closes a cycle there is shuffled.  Where all edges
are one such portion its stars are the components.  Otherwise rounds join the portions:
each is two min-aggregations with map-side combining and two joins whose skewed partitions
the adaptive planner can split.  The edge list never leaves the executors and never grows
beyond its first size plus one edge for each vertex.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.plans.scratch import Scratch


#: Edges that a task holds at a time: 8 MB of them, and some 100 MB while they are joined.
EDGES_AT_ONCE = 1 << 19


def forest(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The edges' components as stars: (id, smallest id) of all ids but the smallest."""
    ids, place = np.unique(np.concatenate((hi, lo)), return_inverse=True)
    u, v = place[: len(hi)], place[len(hi) :]
    of = np.arange(len(ids))
    while len(u):
        a, b = of[u], of[v]
        apart = a != b
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(of, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(of, up := of[of]):
            of = up
    leaf = np.flatnonzero(of != np.arange(len(ids)))
    return ids[leaf], ids[of[leaf]]


def _forests(edges: DataFrame, at_once: int) -> tuple[DataFrame, bool]:
    """Edges (hi, lo) as the stars of portions, and whether all are one portion."""
    tasks = -(-edges.count() // at_once)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        rows = 0
        for batch in batches:
            hi, lo = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for at in range(0, len(hi), at_once):
                part = (hi[at : at + at_once], lo[at : at + at_once])
                if rows + len(part[0]) > at_once:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in forest(*map(np.concatenate, zip(*held)))], ["hi", "lo"])
                    held, rows = [], 0
                held.append(part)
                rows += len(part[0])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in forest(*map(np.concatenate, zip(*held)))], ["hi", "lo"])

    return edges.coalesce(max(1, tasks)).mapInArrow(run, "hi long, lo long"), tasks <= 1


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("hi", "lo")).alias("x")).first()
    return row["n"], row["x"]


def star_components(edges: DataFrame, scratch: Scratch, max_rounds: int = 64, at_once: int = EDGES_AT_ONCE) -> DataFrame:
    """edges(src, dst), any direction, loops and repeats allowed -> (id, component).

    ``component`` is the smallest id that can be reached.  Only ids with an edge to
    another id are returned.  Rows with a null end are no edges.
    """
    src, dst = F.col("src").cast("long"), F.col("dst").cast("long")
    given = scratch.write(edges.where("src <> dst").select(F.greatest(src, dst).alias("hi"), F.least(src, dst).alias("lo")), "edges")
    stars, whole = _forests(given, at_once)
    e = scratch.write(stars if whole else stars.distinct(), "edges")
    scratch.drop(given)
    last = None if whole else _signature(e)
    for _ in range(max_rounds):
        if whole:
            break
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        floor = large.groupBy("hi").agg(F.min("lo").alias("m"))
        moved = large.join(floor, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        nxt = scratch.write(moved.unionAll(floor.select("hi", F.col("m").alias("lo"))).distinct(), "edges")
        now = _signature(nxt)
        scratch.drop(e)
        e = nxt
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    leaves = e.select(F.col("hi").alias("id"), F.col("lo").alias("component"))
    return leaves.unionAll(leaves.select(F.col("component").alias("id"), "component").distinct())
