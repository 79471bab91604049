"""A graph: normalised edges, the universe of its vertices, and what kind it is."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from weftgraph.operators import shaping


@dataclass(frozen=True)
class Graph:
    """edges(src, dst[, weight]) without loops and repeats; vertices(id), 0 to n.

    The universe reaches from 0 to n inclusive, so files that count from 0 and files that
    count from 1 both fit; ids that no edge has are isolated vertices.
    """

    edges: DataFrame
    n: int
    is_directed: bool = True
    n_left: int | None = None

    @classmethod
    def directed(cls, edges: DataFrame, n: int, reverse: bool = False, acyclic: bool = False, order: str | None = None) -> Graph:
        edges = shaping.drop_loops(edges)
        if acyclic:
            edges = shaping.orient_acyclic(edges)
        if reverse:
            edges = shaping.reverse(edges)
        return cls(shaping.dedupe(edges, order), n)

    @classmethod
    def undirected(cls, edges: DataFrame, n: int, order: str | None = None) -> Graph:
        return cls(shaping.dedupe(shaping.symmetrise(shaping.drop_loops(edges)), order), n, is_directed=False)

    @classmethod
    def bipartite(cls, edges: DataFrame, n_left: int, n_right: int, directed: bool = True, reverse: bool = False, order: str | None = None) -> Graph:
        """Left ids 1 to n_left; right ids, given from 1 on, move behind them."""
        moved = shaping.offset_right(edges, n_left)
        made = cls.directed(moved, n_left + n_right, reverse, order=order) if directed else cls.undirected(moved, n_left + n_right, order)
        return cls(made.edges, made.n, directed, n_left)

    @property
    def vertices(self) -> DataFrame:
        return self.edges.sparkSession.range(0, self.n + 1)

    @property
    def is_bipartite(self) -> bool:
        return self.n_left is not None

    @property
    def n_right(self) -> int | None:
        return None if self.n_left is None else self.n - self.n_left

    def n_edges(self) -> int:
        return self.edges.count()

    def reversed(self) -> Graph:
        return Graph(shaping.reverse(self.edges), self.n, self.is_directed, self.n_left)

    def persist(self) -> Graph:
        """Keeps the edges, dealt by source, for the rounds of an iteration."""
        return Graph(self.edges.repartition("src").persist(), self.n, self.is_directed, self.n_left)

    def unpersist(self) -> None:
        self.edges.unpersist()

    def kinds(self) -> DataFrame:
        return shaping.classify(self.vertices, self.edges)
