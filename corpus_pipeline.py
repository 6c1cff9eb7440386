"""Training-corpus pipeline: toxicity filter, SimHash near-dedup, suffix-array dedup, best-fit packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ferrule.llm import packing, simhash, suffix_dedup, toxicity
from ferrule.llm.common import table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold, by a model trained on the labels of these documents."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.keep_one(docs)


def suffix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that repeat among them."""
    return suffix_dedup.dedup_texts(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document, with its bin and place."""
    return packing.pack_texts(docs)


STAGES = [("toxicity", drop_toxic), ("simhash_near_dedup", near_dedup), ("suffix_dedup", suffix), ("best_fit_packing", pack)]
#: A trained model, fingerprints, suffix order and packing have no SQL form; tests/llm compares run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
