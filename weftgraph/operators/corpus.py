"""From postings to a bipartite graph: global document ids and a dense term dictionary."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions import pieces
from weftgraph.plans.scratch import cut


def postings_of(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", first_id: int = 1) -> DataFrame:
    """(doc, term, tf) of texts; the smallest id is first_id if ids begin at 0.

    Texts are dealt by document before they are split, so their words are counted where
    they are: a text is smaller than its postings, and postings stay dealt by document.
    """
    parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = documents.select((F.col(id_col) + first_id).alias("doc"), F.col(text_col).alias("__text")).repartition(parts, "doc")
    words = dealt.select("doc", F.explode(pieces("__text")).alias("term")).where("term <> ''")
    return words.groupBy("doc", "term").agg(F.count("*").alias("tf"))


def global_doc_ids(postings: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """postings(part, doc_id, ...) with doc_id moved behind the documents of earlier parts.

    counts(part, n_docs) if the parts say it, else their distinct documents.  The prefix sum
    runs over one row a part.
    """
    counts = counts if counts is not None else postings.groupBy("part").agg(F.countDistinct("doc_id").alias("n_docs"))
    before = counts.select("part", (F.sum("n_docs").over(Window.orderBy("part")) - F.col("n_docs")).alias("before"))
    return postings.join(F.broadcast(before), "part").withColumn("doc_id", F.col("doc_id") + F.col("before")).drop("before")


def term_dictionary(postings: DataFrame, n_docs: int = 0) -> DataFrame:
    """(term, term_id): dense numbers from n_docs + 1 in the terms' order.

    Terms are dealt by ranges of equal size, numbered in each and moved by the sizes of the
    ranges before, so no task sees all terms; there is one row a range to sum over.  They
    are written once, as a range drawn anew could have other bounds.
    """
    parts = int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = postings.select("term").distinct().repartitionByRange(parts, "term").sortWithinPartitions("term")
    own = cut(dealt.select("term", F.monotonically_increasing_id().alias("m")))
    # the id's high bits are the partition's number, the low 33 number its rows
    part = F.shiftright("m", 33)
    sizes = own.groupBy(part.alias("r")).agg(F.count("*").alias("n"))
    before = sizes.select("r", (F.sum("n").over(Window.orderBy("r")) - F.col("n")).alias("before"))
    rank = F.col("m").bitwiseAND((1 << 33) - 1) + F.col("before") + 1 + n_docs
    return own.join(before, part == F.col("r")).select("term", rank.cast("long").alias("term_id"))


def build(postings: DataFrame, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(edges (doc_id, term_id, tf), dictionary (term, term_id)); written under path if given."""
    dictionary = cut(term_dictionary(postings))
    edges = postings.join(dictionary, "term").select("doc_id", "term_id", "tf")
    if path:
        spark = postings.sparkSession
        edges.write.mode("overwrite").parquet(f"{path}/edges")
        dictionary.write.mode("overwrite").parquet(f"{path}/terms")
        return spark.read.parquet(f"{path}/edges"), spark.read.parquet(f"{path}/terms")
    return edges, dictionary
