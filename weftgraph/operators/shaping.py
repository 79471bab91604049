"""Operators that shape edges: all are projections, filters and one aggregation at most.

Edges are DataFrames (src, dst[, weight]); ids are longs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _weights(edges: DataFrame) -> list[str]:
    return [c for c in edges.columns if c not in ("src", "dst")]


def reverse(edges: DataFrame) -> DataFrame:
    """Every edge turned round."""
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *_weights(edges))


def drop_loops(edges: DataFrame) -> DataFrame:
    return edges.where("src <> dst")


def dedupe(edges: DataFrame, order: Column | str | None = None) -> DataFrame:
    """One edge for each (src, dst).  Of weighted ones that of the smallest ``order`` stays
    and order leaves; without order that of the smallest weight does."""
    if "weight" not in edges.columns:
        return edges.select("src", "dst").distinct()
    return edges.groupBy("src", "dst").agg(F.min_by("weight", order if order is not None else "weight").alias("weight"))


def symmetrise(edges: DataFrame) -> DataFrame:
    """Edges and their mirror images; repeats stay until dedupe()."""
    return edges.unionByName(reverse(edges))


def orient_acyclic(edges: DataFrame) -> DataFrame:
    """Every edge from its smaller id to its larger."""
    return edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), *_weights(edges))


def offset_right(edges: DataFrame, n_left: int) -> DataFrame:
    """Ids of the right side moved behind those of the left."""
    return edges.withColumn("dst", F.col("dst") + F.lit(n_left).cast("long"))


def side(id_col: Column | str, n_left: int) -> Column:
    """left for ids up to n_left, right beyond."""
    return F.when((F.col(id_col) if isinstance(id_col, str) else id_col) <= n_left, "left").otherwise("right")


def classify(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, kind): regular has edges in and out, sink only in, source only out, isolated
    neither.  One pass over the edges: each tells both its ends, and sums meet by id."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    seen = ends.groupBy("e.id").agg(F.max("e.o").alias("o"), F.max("e.i").alias("i"))
    kind = F.when((F.col("o") == 1) & (F.col("i") == 1), "regular").when(F.col("i") == 1, "sink").when(F.col("o") == 1, "source").otherwise("isolated")
    return vertices.select("id").join(seen, "id", "left").select("id", kind.alias("kind"))
