"""A corpus pipeline: each stage works on what the one before it kept.

Null text counts as empty throughout, null ids, languages and sources are values
of their own, rows that repeat are documents of their own until near-duplicates
go, and a table without rows stays one. Columns beyond those of ``documents``
are kept, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from marginalia import session
from marginalia.llm import decontam, mixing, quality, sharding, simhash

#: What the stages read, and ``documents`` has.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; short ones (null and empty texts too) are among them. Rows that repeat are judged alike."""
    return quality.keep_good(docs).select(*_all(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the smallest id, null only if all are.

    Rows that repeat are one group; texts without words are one as well.
    """
    return simhash.keep_one(docs).select(*_all(docs))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go. Without items, or without words, none does."""
    return decontam.clean(docs, session.table(spark, sf_dir, "benchmark")).select(*_all(docs))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as the mix takes them; those without words once."""
    return mixing.mixed(docs).select(*_all(docs))


def byte_sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of every document that is left; rows that repeat get slots of their own."""
    return sharding.shard(docs)


def _all(docs: DataFrame) -> list[str]:
    return [f"`{c}`" for c in docs.columns]


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
    ("byte_sharding", byte_sharding),
]

#: Fingerprints and the robust estimates have no SQL form; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet in the shared folder and read again.

    A stage's output goes once the next one is written; the last stage's result
    is cut off from its input, so nothing but that result's checkpoint is left.
    """
    folder = f"{session.shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs, before = session.table(spark, sf_dir, "documents"), session.made()
    written: list[str] = []
    try:
        for name, stage in STAGES[:-1]:
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
            session.sweep(spark, before)
            for old in written:
                session.remove(spark, f"{folder}/{old}")
            written = [name]
        return STAGES[-1][1](spark, docs, sf_dir)
    finally:
        session.sweep(spark, before)
        session.remove(spark, folder)
