"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet
and read again as the docs of the next.  All but the last return the columns of documents,
so any of them may be run, rerun or checked alone.  Any column may hold nulls: a null text
counts as an empty one, so the language stage rejects it, and the others, run alone, keep
it as it is; a row without an id or source stays in as far as its text lets it.  Empty
tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import decontaminate, langid, linededup, nearcopies, packing
from weftgraph.llm.common import table
from weftgraph.llm.queries import tokenizer_path
from weftgraph.plans.scratch import Scratch


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language that one byte tree predicts best; its name becomes lang.

    Texts without a letter go, texts that no language has for itself, and texts that no
    tree predicts better than the uniform 8 bits a byte: other languages, code, noise.
    """
    return langid.keep_identified(docs, langid.fit(docs), min_score=0.5, lang_col="lang", max_bits=8.0)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that too many documents of their source have."""
    kept = linededup.drop_boilerplate(docs, Scratch(spark, "pipeline-lines"))
    n_chars = F.when(F.col("__n_dropped") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return kept.withColumn("n_chars", n_chars).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near duplicates.

    Documents are linked whose sets of five-word shingles have a Jaccard similarity of 0.8
    or more: by the trie of SimHash fingerprints first, and for pairs that differ in more
    bits than a trie can carry by an exact search of what the trie leaves apart.
    """
    return nearcopies.keep_first(docs, Scratch(spark, "pipeline-near"), words=5, share=(4, 5))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window with a benchmark item."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 2048 tokens."""
    pieces = packing.cut(docs, tokenizer_path(spark, "byte_bpe_50k.json"), capacity=2048, end_id=0)
    return packing.pack(pieces, Scratch(spark, "pipeline-packing"), capacity=2048)


STAGES = [
    ("language_id", language),
    ("line_dedup", lines),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", benchmark),
    ("best_fit_packing", packed),
]

#: Byte trees, tokenizers and packing have no SQL; tests/llm/test_pipeline.py holds run()
#: against plain versions, stage by stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the documents of sf_dir on."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, scratch.write(stage(spark, docs, sf_dir), name)
        if i:
            scratch.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
