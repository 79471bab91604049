"""The registered queries of the engine's own operators, over graphs made of the tables.

graph "cust": an edge from each order's customer to the customer whose number a fixed rule
makes of the order's key, weighted 1 to 128, the first by order key counting.  graph "mix"
lacks the edges whose source is a multiple of 7 and those whose end is a multiple of 5, so
all kinds of vertices occur.  Documents and their words make the bipartite graph.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph import functions
from weftgraph.graph import Graph
from weftgraph.operators import analytics, corpus, retrieval, shaping, simulation, vertex
from weftgraph.plans.gas import VertexProgram, run
from weftgraph.plans.scratch import Scratch

ROOT = 1
#: Edges between the first four market segments in alphabetical order.
PATTERN = [(0, 1), (0, 2), (1, 2), (1, 3), (2, 1), (2, 3)]
TOP = 10


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def top_id(spark: SparkSession, sf_dir: str) -> int:
    return _read(spark, sf_dir, "customer").agg(F.max("c_custkey")).first()[0]


def raw_edges(spark: SparkSession, sf_dir: str, kind: str = "cust") -> DataFrame:
    """(src, dst, weight, ord) as they come, with loops and repeats."""
    n = top_id(spark, sf_dir) + 1
    orders = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    out = orders.select(F.col("o_custkey").alias("src"), ((F.col("o_orderkey") * 7919 + 13) % n).alias("dst"), (F.col("o_orderkey") % 128 + 1).alias("weight"), F.col("o_orderkey").alias("ord"))
    return out.where("src % 7 <> 0 AND dst % 5 <> 0") if kind == "mix" else out


def graph(spark: SparkSession, sf_dir: str, kind: str = "cust", undirected: bool = False, weighted: bool = False) -> Graph:
    edges = raw_edges(spark, sf_dir, kind)
    edges = edges if weighted else edges.select("src", "dst")
    return (Graph.undirected if undirected else Graph.directed)(edges, top_id(spark, sf_dir), order="ord" if weighted else None)


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.postings_of(_read(spark, sf_dir, "documents"))


def keyword_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All different words of each benchmark item, in order."""
    words = F.array_distinct(functions.tokens("text"))
    return _read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), words.alias("terms"))


def n_docs(spark: SparkSession, sf_dir: str) -> int:
    return _read(spark, sf_dir, "documents").count()


def _pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _read(spark, sf_dir, "customer").select("c_mktsegment").distinct().orderBy("c_mktsegment").limit(4)
    rows = [(i, r[0]) for i, r in enumerate(labels.collect())]
    edges = spark.createDataFrame(PATTERN, "src long, dst long")
    data = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("label"))
    return simulation.simulate(graph(spark, sf_dir, "mix").edges, data, edges, spark.createDataFrame(rows, "q long, label string"))


def _weighted_in(spark: SparkSession, sf_dir: str, max_iters: int | None) -> DataFrame:
    """A user's own program: the largest sum of two weights that meets along a path."""
    g = graph(spark, sf_dir, "mix", weighted=True)
    program = VertexProgram(
        init={"best": F.lit(0).cast("long")},
        active=F.col("id") % 3 == 0,
        message=F.col("best"),
        gather=F.col("msg") + F.col("weight") + F.col("dst_best"),
        combine=F.max,
        apply=lambda i: {"best": F.greatest("best", F.col("acc") * (i + 1))},
        activate=F.col("best") > F.col("old_best"),
        uses_dst_state=True,
    )
    return run(program, g, max_iters).select("id", "best")


def _binary_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftgraph.sources import binary

    edges = graph(spark, sf_dir, weighted=True).edges
    path = Scratch(spark, "binary").path("edges")
    binary.write_edges(edges, path, weight="int", header=True)
    return binary.read_edges(spark, path, weight="int", header=True)


def _text_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted edges through text files with a header line, as the tools exchange them."""
    from weftgraph.sources import text

    edges = graph(spark, sf_dir, weighted=True).edges
    path = Scratch(spark, "text").path("edges")
    text.write_edges(edges, path, weights="own", header=(1, 1, 1))
    return text.read_edges(spark, path, weight="int")


def _corpus_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The term dictionary as the corpus writer leaves it, read back."""
    return corpus.build(corpus.global_doc_ids(_parted(spark, sf_dir)), Scratch(spark, "corpus").path("graph"))[1]


Query = Callable[[SparkSession, str], DataFrame]
#: Ranks are sums of 0.1275 / degree: with few places some lie half-way, where the order of
#: the sum would decide; twelve are beyond all of degrees under 512.
_rank = "round(rank, 12) AS rank"

QUERIES: dict[str, Query] = {
    "edges_normalized": lambda s, d: graph(s, d).edges,
    "edges_reversed": lambda s, d: graph(s, d).reversed().edges,
    "edges_symmetric": lambda s, d: graph(s, d, undirected=True).edges,
    "edges_acyclic": lambda s, d: Graph.directed(raw_edges(s, d).select("src", "dst"), top_id(s, d), acyclic=True).edges,
    "edges_weighted_dedupe": lambda s, d: graph(s, d, weighted=True).edges,
    "bipartite_offset": lambda s, d: Graph.bipartite(_read(s, d, "lineitem").select((F.col("l_partkey") + 1).alias("src"), (F.col("l_suppkey") + 1).alias("dst")), _read(s, d, "part").count(), _read(s, d, "supplier").count()).edges,
    "bipartite_sides": lambda s, d: s.range(1, _read(s, d, "part").count() + _read(s, d, "supplier").count() + 1).groupBy(shaping.side("id", _read(s, d, "part").count()).alias("side")).agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id")),
    "vertex_classes": lambda s, d: graph(s, d, "mix").kinds(),
    "graph_metadata": lambda s, d: graph(s, d, "mix").edges.agg(F.count("*").alias("n_edges")).withColumn("n_vertices", F.lit(top_id(s, d) + 1).cast("long")),
    "in_degree": lambda s, d: analytics.in_degree(graph(s, d, "mix")),
    "out_degree": lambda s, d: analytics.out_degree(graph(s, d, "mix")),
    "degree_top3": lambda s, d: vertex.topk(analytics.in_degree(graph(s, d)), 3, F.col("degree"), name="degree"),
    "pagerank_1": lambda s, d: analytics.pagerank(graph(s, d, "mix"), 1).selectExpr("id", _rank),
    "pagerank_10": lambda s, d: analytics.pagerank(graph(s, d, "mix"), 10).selectExpr("id", _rank),
    "pagerank_textbook_10": lambda s, d: analytics.pagerank(graph(s, d, "mix"), 10, defer_sinks=False).selectExpr("id", _rank),
    "pagerank_converged": lambda s, d: analytics.pagerank(graph(s, d, "mix"), tolerance=1e-9).select("id", F.round("rank", 5).alias("rank")),
    "pagerank_checksum": lambda s, d: analytics.pagerank(graph(s, d, "mix"), 10).join(analytics.out_degree(graph(s, d, "mix")), "id").agg(F.sum("degree").alias("degrees"), F.round(F.sum("rank"), 4).alias("ranks")),
    "sssp": lambda s, d: analytics.sssp(graph(s, d, "mix", weighted=True), ROOT),
    "sssp_summary": lambda s, d: analytics.sssp(graph(s, d, "mix", weighted=True), ROOT).agg(F.count("distance").alias("reached"), F.sum(F.coalesce("distance", F.lit(2147483647))).alias("checksum")),
    "bfs": lambda s, d: analytics.bfs(graph(s, d, "mix", undirected=True), ROOT).withColumn("hops", F.col("hops").cast("long")),
    "bfs_summary": lambda s, d: analytics.bfs(graph(s, d, "mix", undirected=True), ROOT).agg(F.count("hops").alias("reached"), F.sum(F.col("hops") * F.col("parent")).alias("checksum")),
    "cc": lambda s, d: analytics.connected_components(graph(s, d, "mix", undirected=True)),
    "cc_checksum": lambda s, d: vertex.reduce(analytics.connected_components(graph(s, d, "mix", undirected=True)), F.col("label"), name="labels"),
    "triangles_per_vertex": lambda s, d: analytics.triangles(raw_edges(s, d), top_id(s, d)),
    "triangles_total": lambda s, d: analytics.triangle_total(raw_edges(s, d)),
    "in_neighbors_sorted": lambda s, d: analytics.in_neighbours(Graph.directed(raw_edges(s, d).select("src", "dst"), top_id(s, d), acyclic=True)).select("id", F.concat_ws(",", F.transform("neighbours", lambda x: x.cast("string"))).alias("neighbours")),
    "vertex_program_one_round": lambda s, d: _weighted_in(s, d, 1),
    "vertex_program_three_rounds": lambda s, d: _weighted_in(s, d, 3),
    "init_from_state": lambda s, d: _seeded(s, d),
    "bipartite_round": lambda s, d: _bipartite_round(s, d),
    "reduce_active": lambda s, d: vertex.reduce(analytics.in_degree(graph(s, d, "mix")).withColumn("active", F.col("degree") > 5), F.col("degree"), F.max, active_only=True, name="degree"),
    "btopk": lambda s, d: vertex.batched_topk(analytics.in_degree(graph(s, d, "mix")).join(analytics.out_degree(graph(s, d, "mix")).withColumnRenamed("degree", "out"), "id"), 5, F.array("degree", "out", F.col("degree") + F.col("out"))).withColumn("rank", F.col("rank").cast("long")).withColumn("batch", F.col("batch").cast("long")),
    "subset_init": lambda s, d: VertexProgram(init={"value": F.col("id") * 2}, active=F.lit(True), message=F.col("value"), combine=F.sum, apply=lambda i: {}).initialise(graph(s, d).vertices, s.range(0, top_id(s, d) + 1, 10)),
    "bitset_ops": lambda s, d: _bitsets(s, d),
    "display_head": lambda s, d: vertex.display(analytics.in_degree(graph(s, d, "mix")), top_id(s, d)),
    "id_permutation": lambda s, d: graph(s, d).vertices.select("id", functions.bucket_id("id", 128, top_id(s, d) // 128 + 1).alias("dealt")).withColumn("back", functions.bucket_id_back("dealt", 128, top_id(s, d) // 128 + 1)),
    "doc_stats": lambda s, d: retrieval.doc_stats(postings(s, d)),
    "term_stats": lambda s, d: retrieval.term_stats(postings(s, d)),
    "collection_stats": lambda s, d: retrieval.collection_stats(postings(s, d), n_docs(s, d)).withColumn("mean_length", F.round("mean_length", 6)),
    "term_dictionary": lambda s, d: corpus.term_dictionary(postings(s, d)),
    "query_term_lookup": lambda s, d: retrieval.term_lookup(retrieval.query_terms(keyword_queries(s, d)), corpus.term_dictionary(postings(s, d), n_docs(s, d))).withColumn("pos", F.col("pos").cast("long")),
    "bm25_topk": lambda s, d: retrieval.bm25(postings(s, d), keyword_queries(s, d), n_docs(s, d), TOP, digits=6).withColumn("rank", F.col("rank").cast("long")),
    "lm_topk": lambda s, d: retrieval.language_model(postings(s, d), keyword_queries(s, d), n_docs(s, d), TOP, digits=6).withColumn("rank", F.col("rank").cast("long")),
    "corpus_graph": lambda s, d: corpus.build(corpus.global_doc_ids(_parted(s, d)))[0],
    "graph_simulation": _pattern,
    "graph_simulation_count": lambda s, d: simulation.matched(_pattern(s, d)).agg(F.count("*").alias("matched")),
    "random_weights": lambda s, d: graph(s, d).edges.withColumn("weight", functions.random_weight("src", "dst")),
    "binary_roundtrip": _binary_roundtrip,
    "text_roundtrip": _text_roundtrip,
    "corpus_roundtrip": _corpus_roundtrip,
}


def _seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A program that starts from where another ended: degrees summed over in-neighbours."""
    g = graph(spark, sf_dir, "mix")
    degrees = analytics.out_degree(g)
    program = VertexProgram(init={"own": F.col("degree"), "around": F.lit(0).cast("long")}, active=F.col("degree") > 0, message=F.col("own"), combine=F.sum, apply=lambda i: {"around": F.col("acc")})
    return run(program, g, 1, state=degrees).select("id", "own", "around")


def _bipartite_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One round over an undirected bipartite graph in which only the left side sends."""
    n_left = _read(spark, sf_dir, "part").count()
    edges = _read(spark, sf_dir, "lineitem").select((F.col("l_partkey") + 1).alias("src"), (F.col("l_suppkey") + 1).alias("dst"))
    g = Graph.bipartite(edges, n_left, _read(spark, sf_dir, "supplier").count(), directed=False)
    program = VertexProgram(init={"total": F.lit(0).cast("long")}, active=F.col("id") <= n_left, message=F.col("id"), combine=F.sum, apply=lambda i: {"total": F.col("acc")})
    return vertex.of_side(run(program, g, 1), n_left, left=False).select("id", "total")


def _parted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings of documents dealt to four parts, numbered anew in each."""
    own = postings(spark, sf_dir)
    return own.select(((F.col("doc") - 1) % 4).cast("int").alias("part"), F.floor((F.col("doc") - 1) / 4).alias("doc_id"), "term", "tf")


def _bitsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = graph(spark, sf_dir, "mix")
    out, into = g.edges.select(F.col("src").alias("id")).distinct(), g.edges.select(F.col("dst").alias("id")).distinct()
    parts = {"union": vertex.union(out, into), "intersect": vertex.intersect(out, into), "difference": vertex.difference(out, into), "rest": vertex.rest(g.vertices, out, into)}
    made = None
    for name, ids in parts.items():
        rows = ids.select(F.lit(name).alias("part"), "id")
        made = rows if made is None else made.unionAll(rows)
    return made
