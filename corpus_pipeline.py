"""From raw documents to sharded training rows, one stage after another, each read from written Parquet."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontamination, jaccard, mixing, quality, sharding, simhash
from tidemark.llm.text import drop_rows
from tidemark.plans.scratch import cut, scratch_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a base rule or lie beyond the robust cut-off go."""
    verdicts = quality.quality(docs).where(~F.col("kept")).select("doc_id", "text_key").distinct()
    return drop_rows(docs, cut(verdicts, "rejected"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays that five-word shingles of Jaccard similarity 0.8 or more connect."""
    return simhash.first_of(docs, jaccard.near_duplicates(docs))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a phrase of ten words of a benchmark item go, also with its words close together in any order."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontamination.contamination(docs, items, within=decontamination.WITHIN)
    met = (F.size("hits") > 0) | (F.size("near_items") > 0)
    return drop_rows(docs, cut(found.where(met).select("doc_id", "text_key").distinct(), "contaminated"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Small sources are repeated, up to twice; every document is used at least once."""
    return mixing.mixed(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sixteen shards of the same mixture; the columns of documents with shard and slot."""
    return sharding.shard(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("shard", shard),
]

#: Shingle sets, robust estimates and phrase postings are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``; every result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_dir(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
