"""Documents to packed sequences: quality rules, toxicity, near-duplicates, packing.

The first three stages judge each row by itself and return the rows they keep with all columns: a null doc_id is judged by its
text, rows that share a doc_id are judged apart, null and empty texts fail the rules' 50 words, an empty table stays empty, and
columns of other names come through."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cairn.llm import minhash, packing, quality_rules, toxicity
from cairn.llm.common import Scratch
from cairn.llm.queries import tokenizer

#: No stage but the first rules is SQL: models, minima and linear programs. tests/llm holds run() against brute force.
ORACLE_SQL = None


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep_good(docs, _labels(spark, sf_dir))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not predicted toxic."""
    return toxicity.keep_clean(docs, _labels(spark, sf_dir))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest doc_id."""
    return minhash.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences."""
    return packing.pack_documents(docs, tokenizer("word_bpe_49k.json"), with_ids=False)


STAGES = [("quality_rules", quality), ("toxicity", toxic), ("near_duplicates", near_duplicates), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
