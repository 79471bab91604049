"""Ranked retrieval over postings (doc, term, tf): BM25 and a Dirichlet language model.

All queries of a batch are answered in one plan: query terms meet the postings by one
join, scores are one aggregation, and each query's best come from a window that keeps k
rows a query and bucket before its rows meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.plans.scratch import cut, fixed_plans

#: Query terms of a batch that are sent to all tasks.
FEW = 1_000_000
K1, B, MU = 1.2, 0.75, 2000.0


def doc_stats(postings: DataFrame) -> DataFrame:
    """(doc, length): tokens of each document."""
    return postings.groupBy("doc").agg(F.sum("tf").cast("long").alias("length"))


def term_stats(postings: DataFrame) -> DataFrame:
    """(term, df, total_tf): documents and tokens of each term."""
    return postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").cast("long").alias("total_tf"))


def collection_stats(postings: DataFrame, n_docs: int) -> DataFrame:
    """One row: tokens of the collection, and the mean length over n_docs documents."""
    return postings.agg(F.sum("tf").cast("long").alias("n_tokens")).withColumn("mean_length", F.col("n_tokens") / F.lit(n_docs))


def term_lookup(queries: DataFrame, dictionary: DataFrame) -> DataFrame:
    """queries(qid, pos, term) with term_id of dictionary(term, term_id); 0 if unknown."""
    return queries.join(dictionary, "term", "left").select("qid", "pos", "term", F.coalesce("term_id", F.lit(0)).cast("long").alias("term_id"))


def query_terms(queries: DataFrame) -> DataFrame:
    """queries(qid, terms array) as rows (qid, pos, term)."""
    return queries.select("qid", F.posexplode("terms").alias("pos", "term"))


def _best(scores: DataFrame, k: int) -> DataFrame:
    order = [F.desc("score"), F.asc("doc")]
    salted = scores.withColumn("__s", F.pmod(F.xxhash64("doc"), F.lit(32)))
    best = salted.withColumn("__r", F.row_number().over(Window.partitionBy("qid", "__s").orderBy(*order))).where(F.col("__r") <= k)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(*order)))
    return ranked.where(F.col("rank") <= k).select("qid", "rank", "doc", "score")


def _matches(postings: DataFrame, terms: DataFrame, n_docs: int) -> DataFrame:
    """Postings of the queries' distinct known terms, with the document's length and the
    collection's tokens.

    One pass over the postings makes a row a document: its length, and its postings of terms
    that some query has.  These rows are written, still dealt by document, and the other
    parts of the plan read just them; scores of a document come from one task.
    """
    asked = cut(terms.select("qid", "term").distinct())
    few = asked.count() <= FEW
    small = F.broadcast if few else lambda df: df
    with fixed_plans(postings.sparkSession):
        flagged = postings.join(small(asked.select("term").distinct().withColumn("__asked", F.lit(True))), "term", "left")
        own = F.collect_list(F.when(F.col("__asked"), F.struct("term", "tf"))).alias("hits")  # skips nulls
        docs = cut(flagged.groupBy("doc").agg(F.sum("tf").cast("long").alias("length"), own))
    stats = docs.agg(F.sum("length").alias("n_tokens")).withColumn("mean_length", F.col("n_tokens") / F.lit(n_docs))
    hits = docs.select("doc", "length", F.inline("hits"))
    weighed = asked.join(term_stats(hits), "term")  # every document of an asked term is among them
    return hits.join(small(weighed), "term").crossJoin(F.broadcast(stats))  # one row


def bm25(postings: DataFrame, queries: DataFrame, n_docs: int, k: int, digits: int | None = None) -> DataFrame:
    """(qid, rank, doc, score) of the k best documents that have a term of the query.

    queries(qid, terms array).  A term counts once however often the query has it; the
    weight of a term that most documents have is negative.  Equal scores go by doc.
    """
    idf = F.log10((F.lit(float(n_docs)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("length") / F.col("mean_length"))
    score: Column = F.sum(idf * F.col("tf") * F.lit(K1 + 1) / (F.col("tf") + norm))
    scores = _matches(postings, query_terms(queries), n_docs).groupBy("qid", "doc").agg((F.round(score, digits) if digits is not None else score).alias("score"))
    return _best(scores, k)


def language_model(postings: DataFrame, queries: DataFrame, n_docs: int, k: int, mu: float = MU, digits: int | None = None) -> DataFrame:
    """(qid, rank, doc, score) by query likelihood with Dirichlet smoothing.

    The query's length counts repeated and unknown terms too; the sum over terms does not.
    """
    lengths = queries.select("qid", F.size("terms").alias("n_terms"))
    seen = F.log10(1 + F.col("tf") / (F.lit(mu) * F.col("total_tf") / F.col("n_tokens")))
    own = F.first("n_terms") * F.log10(F.lit(mu) / (F.first("length") + F.lit(mu)))
    score: Column = F.sum(seen) + own
    scores = _matches(postings, query_terms(queries), n_docs).join(lengths, "qid").groupBy("qid", "doc").agg((F.round(score, digits) if digits is not None else score).alias("score"))
    return _best(scores, k)
