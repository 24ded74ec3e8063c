"""The corpus pipeline: classify, deduplicate, mix and pack the documents table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm import exact_dedup, gam, mixing, simhash
from quern.llm.queries import LEVELS, WEIGHTS, pack_documents
from quern.llm.shared import land_alone, remove


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return gam.drop_poor(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the one with the largest id stays."""
    return exact_dedup.drop_exact(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    return simhash.drop_near(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draw 60 % of the words by the target weights; a document comes once for each pass that draws on it, cut where a source's share ends in it."""
    return mixing.draw(docs, LEVELS, WEIGHTS, share=(3, 5), max_epochs=4, seed=7)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences of token ids, and which pieces of which documents they hold."""
    return pack_documents(docs)


STAGES = [
    ("quality classifier", classify),
    ("exact dedup", exact),
    ("SimHash near-dedup", near),
    ("mixing to target weights", mixed),
    ("best-fit packing", packed),
]

#: The classifier, the fingerprints and the packing are beyond SQL; tests compare the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another; what a stage and the one before it stored goes when its output is stored."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs, path = land_alone(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), f"stage{k}")
        if before:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
