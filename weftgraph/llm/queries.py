"""The thin opN_<name> queries: each applies its operator to its whole table and derives the digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import decontaminate, langid, linededup, packing, quality, rules, simhash, substrings, tokenstore, toxicity
from weftgraph.llm.common import table
from weftgraph.plans.scratch import Scratch


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), Scratch(spark, "op1"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def tokenizer_path(spark: SparkSession, name: str) -> str:
    """Where a tokenizer file is: under the folder in spark.weftgraph.tokenizers, else in the installed package."""
    folder = spark.conf.get("spark.weftgraph.tokenizers", None)
    if folder:
        return f"{folder.rstrip('/')}/{name}"
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "op3")
    path = scratch.path("store")
    tokenstore.write_store(table(spark, sf_dir, "documents"), path, scratch, tokenizer_path(spark, "word_bpe_49k.json"), end_id=2)
    return tokenstore.read_store(spark, path, with_ids=False, scratch=scratch)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.drop_boilerplate(table(spark, sf_dir, "documents"), Scratch(spark, "op4"))
    n_lines = F.greatest("__n_lines", F.lit(1)).alias("n_lines")  # a null text counts as one empty line
    return kept.select("doc_id", "source", n_lines, F.col("__n_dropped").alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.dedup(table(spark, sf_dir, "documents"), Scratch(spark, "op5"), size=20)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.cut(table(spark, sf_dir, "documents"), tokenizer_path(spark, "byte_bpe_50k.json"), capacity=2048, end_id=0)
    return packing.pack(pieces, Scratch(spark, "op7"), capacity=2048)


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), Scratch(spark, "op6"))
    return toxicity.score(docs, model, threshold=0.7, locate=False)


def op9_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(table(spark, sf_dir, "documents"), Scratch(spark, "op9")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), Scratch(spark, "op10"))
    return quality.score(docs, model, threshold=0.5)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_decontaminate": op2_decontaminate,
    "op3_token_store": op3_token_store,
    "op4_line_dedup": op4_line_dedup,
    "op5_substrings": op5_substrings,
    "op7_packing": op7_packing,
    "op6_toxicity": op6_toxicity,
    "op8_langid": op8_langid,
    "op9_rules": op9_rules,
    "op10_quality": op10_quality,
}

ORACLES: dict[str, str] = {
    "op4_line_dedup": linededup.ORACLE,
}
