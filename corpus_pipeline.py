"""The corpus pipeline: each stage is one of the operators of ``fluxprint.llm``.

A stage takes (spark, docs, sf_dir) with ``docs`` a stored table and returns the documents it
keeps, in their columns; the last one returns them with their place in the shards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fluxprint.llm import darts, kneser, mixing, ring, templates
from fluxprint.llm.common import read
from fluxprint.session import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is within reach of their language's trusted text (operator 10)."""
    return kneser.clean(docs, read(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id (operator 6)."""
    return darts.clean(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark (operator 8)."""
    return templates.clean(docs, read(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn at the rates that meet the target weights (operator 3)."""
    return mixing.mix(docs, read(spark, sf_dir, "labels"))


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their shard and slot on the ring (operator 2)."""
    return ring.bounded_ring(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixture", mixture),
          ("sharding", sharding)]
# The rates, the signatures and the perplexities are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
