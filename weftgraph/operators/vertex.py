"""Operators over vertex states: folds, top-k, batches of top-k, display, bit sets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def reduce(state: DataFrame, value: Column, fold: Callable[[Column], Column] = F.sum, active_only: bool = False, name: str = "value") -> DataFrame:
    """One row: a fold of a value over all (or the active) vertices."""
    return (state.where("active") if active_only else state).agg(fold(value).alias(name))


def topk(state: DataFrame, k: int, value: Column, active_only: bool = False, name: str = "value") -> DataFrame:
    """The k vertices of the largest value, equal ones by id; never more rows than there are."""
    own = (state.where("active") if active_only else state).select("id", value.alias(name))
    return own.where(F.col(name).isNotNull()).orderBy(F.desc(name), F.asc("id")).limit(k)


def batched_topk(state: DataFrame, k: int, values: Column, active_only: bool = False) -> DataFrame:
    """(batch, rank, id, value): the top k for each entry of an array of values.

    Each partition keeps its own k best of a batch before anything is shuffled, so a batch
    of all vertices does not meet in one task.
    """
    own = (state.where("active") if active_only else state).select("id", F.posexplode(values).alias("batch", "value")).where("value is not null")
    order = [F.desc("value"), F.asc("id")]
    salted = own.withColumn("__s", F.pmod(F.xxhash64("id"), F.lit(64)))
    best = salted.withColumn("__r", F.row_number().over(Window.partitionBy("batch", "__s").orderBy(*order))).where(F.col("__r") <= k)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("batch").orderBy(*order)))
    return ranked.where(F.col("rank") <= k).select("batch", "rank", "id", "value")


def display(state: DataFrame, n: int, most: int = 30) -> DataFrame:
    """The states of ids 0 to min(n, most), in order."""
    return state.where(F.col("id") <= min(n, most)).orderBy("id")


def reset_activity(state: DataFrame) -> DataFrame:
    return state.withColumn("active", F.lit(False))


def activate_all(state: DataFrame) -> DataFrame:
    return state.withColumn("active", F.lit(True))


def of_side(state: DataFrame, n_left: int, left: bool = True) -> DataFrame:
    """The states of the left or the right vertices of a bipartite graph."""
    return state.where(F.col("id") <= n_left if left else F.col("id") > n_left)


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("id").union(b.select("id")).distinct()


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("id").intersect(b.select("id"))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("id").subtract(b.select("id"))


def rest(universe: DataFrame, *sets: DataFrame) -> DataFrame:
    """What is in none of the sets."""
    for s in sets:
        universe = difference(universe, s)
    return universe.select("id")
