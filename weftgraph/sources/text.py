"""Text files: edges, labels, queries, postings."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.sources import files


def numbered(lines: DataFrame) -> DataFrame:
    """(line, value): lines of text files with their number from 0, files in the order of
    their paths; Spark packs splits into partitions by size, in any order."""
    own = lines.select("value", F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("m"))
    # a split's rows follow each other in one partition; splits are counted and summed
    counts = own.groupBy("p", "b").agg(F.count("*").alias("n"), F.min("m").alias("first"))
    before = counts.select("p", "b", (F.sum("n").over(Window.orderBy("p", "b")) - F.col("n") - F.col("first")).alias("shift"))
    return own.join(before, ["p", "b"]).select((F.col("m") + F.col("shift")).alias("line"), "value")


def read_edges(spark: SparkSession, path: str, weight: str = "none") -> DataFrame:
    """Edges of a text file: numbers with blanks between, comments from % or #.

    weight: none (a third number is left out), int or double.
    """
    part = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(~F.col("value").rlike(r"^\s*([%#]|$)"))
    columns = [F.get(part, 0).cast("long").alias("src"), F.get(part, 1).cast("long").alias("dst")]
    if weight != "none":
        columns.append(F.get(part, 2).cast("long" if weight == "int" else "double").alias("weight"))
    return rows.select(*columns)


def read_header(path: str) -> tuple[int, ...]:
    """The numbers in the last of the comment lines that a file begins with; () if there are none."""
    last = ""
    for line in files.read_range(files.listing(path)[0][0], 0, 1 << 16).decode().split("\n"):
        if not line.startswith(("%", "#")):
            break
        last = line
    return tuple(int(x) for x in re.findall(r"\d+", last))


def write_edges(edges: DataFrame, path: str, weights: str = "none", header: tuple[int, ...] | None = None, seed: int = 1) -> None:
    """Edges as text part files; weights: none, own (1 where there are none) or random.
    A header goes to a comment line of a part file that sorts before the others."""
    from weftgraph.functions import random_weight

    columns = [F.col("src"), F.col("dst")]
    if weights == "random":
        columns.append(random_weight("src", "dst", seed))
    elif weights == "own":
        columns.append(F.col("weight") if "weight" in edges.columns else F.lit(1))
    edges.select(F.concat_ws(" ", *[c.cast("string") for c in columns]).alias("value")).write.mode("append").text(path)
    if header is not None:
        files.write_bytes(f"{path.rstrip('/')}/part-00000-00-header.txt", [("% " + " ".join(map(str, header)) + "\n").encode()])


def read_vertex_labels(spark: SparkSession, path: str) -> DataFrame:
    """(id, label) of a list that opens with [ and has one object of one text value a line,
    for ids from 0 on; a line of null is a vertex without a label."""
    entry = numbered(spark.read.text(path)).where(~F.col("value").rlike(r"^\s*[\[\]]\s*$"))
    label = F.regexp_extract("value", r':\s*"((?:[^"\\]|\\.)*)"', 1)
    return entry.where(F.col("value").rlike(r':\s*"')).select((F.col("line") - 1).alias("id"), label.alias("label"))


def read_pattern_labels(spark: SparkSession, path: str) -> DataFrame:
    """(q, label): labels with white space between, numbered from 0; a pattern is small."""
    data = b"".join(files.read_range(p, 0, n) for p, n in files.listing(path)).decode()
    return spark.createDataFrame(list(enumerate(data.split())), "q long, label string")


def read_terms(spark: SparkSession, path: str, n_docs: int = 0) -> DataFrame:
    """(term, term_id): a term a line; its number is the line's, from 1 on behind n_docs,
    whatever number stands beside it."""
    return numbered(spark.read.text(path)).select(F.split(F.trim("value"), r"\s+")[0].alias("term"), (F.col("line") + 1 + n_docs).alias("term_id")).where("term <> ''")


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """(qid, terms): a query a line, numbered from 0; blank lines are none."""
    lines = numbered(spark.read.text(path).where(F.trim("value") != ""))
    return lines.select(F.col("line").alias("qid"), F.filter(F.split(F.trim("value"), " "), lambda x: x != "").alias("terms"))


def read_postings(spark: SparkSession, paths: list[str], sep: str = "\t") -> DataFrame:
    """(part, doc_id, term, tf) of text files, part being the file's place in the list;
    rows of an empty term are left out."""
    out = None
    for i, path in enumerate(paths):
        rows = spark.read.csv(path, sep=sep, schema="doc_id long, term string, tf long", quote="").select(F.lit(i).alias("part"), "doc_id", "term", "tf")
        out = rows if out is None else out.unionAll(rows)
    return out.where("term is not null and term <> ''")
