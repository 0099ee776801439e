"""The corpus operators as registered queries: each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import ctw, decontam, mixing, oracles, pii, quality, secrets, sharding, simhash, tokencount, toxicity
from marginalia.session import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words",
        F.aggregate("words", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["first"]).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.size("words") > 0).alias("contaminated"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.lm_scores(table(spark, sf_dir, "documents"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = lambda kind: F.size(F.filter("base", lambda c: c["kind"] == kind)).cast("long").alias(f"n_{kind}")
    listed = lambda spans: f"array_join(transform({spans}, c -> concat(c.kind, ':', c.start, ':', c.end)), ',')"
    plain = "transform({}, c -> named_struct('rank', c.rank, 'start', c.start, 'end', c.end, 'kind', c.kind))"
    return pii.find(table(spark, sf_dir, "documents")).select(
        "doc_id", number("email"), number("ip"), number("card"), number("phone"), F.sha2(F.expr(listed("base")), 256).alias("base_sha256"),
        F.expr(listed(f"array_sort(concat({plain.format('base')}, {plain.format('added')}))")).alias("spans"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"), path="source")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = [
        op1_quality_rules, op2_decontamination, op3_token_counts, op4_lm_scoring, op5_simhash_near_dedup, op6_mixing, op7_pii, op8_sharding, op9_toxicity, op10_secret_scan,
    ]
    return {f.__name__: f for f in made}


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": oracles.quality_sql(), "op2_decontamination": oracles.DECONTAMINATION, "op6_mixing": oracles.MIXING, "op8_sharding": oracles.SHARDING}
