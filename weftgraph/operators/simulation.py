"""Matching of labelled patterns by child simulation, as a decreasing fixpoint of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from weftgraph.plans.scratch import cut, uncut


def simulate(edges: DataFrame, labels: DataFrame, pattern_edges: DataFrame, pattern_labels: DataFrame, limit: int = 10_000) -> DataFrame:
    """(id, q): the greatest relation in which id and q have one label, and for each edge
    q -> q2 of the pattern some edge id -> id2 leads to a pair (id2, q2) of it.

    labels(id, label) may lack vertices, which then match nothing; pattern_edges(src, dst)
    and pattern_labels(q, label) are small and broadcast.  Repeated labels are allowed.

    Which pair an edge of the data lets another pair rest on is worked out once, from the
    labels.  A round then keeps what rests on pairs that are left, and pairs all of whose
    pattern edges are met; it is one semi-join and two aggregations, and its size is
    observed in its own job.
    """
    pattern = pattern_edges.select(F.col("src").alias("q"), F.col("dst").alias("q2")).distinct()
    need = F.broadcast(pattern.groupBy("q").agg(F.count("*").alias("need")))
    pairs = labels.join(F.broadcast(pattern_labels), "label").select("id", "q").distinct().join(need, "q", "left")
    seen = Observation("pairs")
    pairs = cut(pairs.select("id", "q", F.coalesce("need", F.lit(0)).alias("need")).observe(seen, F.count("*").alias("n"), F.count_if(F.col("need") > 0).alias("open")))
    leaves, size = pairs.where("need = 0").select("id", "q"), seen.get["open"]
    heads = pairs.where("need > 0").select(F.col("id").alias("src"), "q", "need")
    tails = pairs.select(F.col("id").alias("dst"), F.col("q").alias("q2"))
    rests = cut(edges.select("src", "dst").distinct().join(heads, "src").join(F.broadcast(pattern), "q").join(tails, ["dst", "q2"]).select(F.col("src").alias("id"), "q", "need", F.col("dst").alias("id2"), "q2"))
    alive, inner = pairs.select("id", "q"), None
    for i in range(limit):
        left = rests.join(alive.select(F.col("id").alias("id2"), F.col("q").alias("q2")), ["id2", "q2"], "left_semi")
        met = left.select("id", "q", "need", "q2").distinct().groupBy("id", "q").agg(F.count("*").alias("met"), F.first("need").alias("need"))
        seen = Observation(f"round{i}")
        before, inner = inner, cut(met.where("met >= need").select("id", "q").observe(seen, F.count("*").alias("n")))
        if before is not None:
            uncut(before)
        alive = leaves.unionAll(inner)
        if seen.get["n"] == size:
            break
        size = seen.get["n"]
    else:
        raise RuntimeError(f"the simulation did not converge in {limit} rounds")
    return alive


def matched(relation: DataFrame) -> DataFrame:
    """The data vertices that match any pattern node."""
    return relation.select("id").distinct()
