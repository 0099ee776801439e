"""Reciprocal rank fusion, and what's made of fused hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60
NOTHING = "No relevant context found."


def ranked(hits: DataFrame, lane: int, order: list[Column], group: list[str] | None = None) -> DataFrame:
    """Hits with their place (from 1) in a lane."""
    w = Window.partitionBy(*group).orderBy(*order) if group else Window.orderBy(*order)
    return hits.withColumn("rank", F.row_number().over(w)).withColumn("lane", F.lit(lane))


def rrf(lanes: list[DataFrame], k: int = RRF_K, key: str = "chunk_id", group: list[str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """Sum of 1 / (k + rank) over the lanes in which a hit stands.

    ``lanes`` have key, rank, lane. One aggregation of the union, so a hit in
    only one lane needs no outer join. What a hit carries (``keep``) comes from
    where it was seen first; ties in score go by that place too. An id that
    stands twice in a lane adds twice.
    """
    group, keep = group or [], keep or []
    union = None
    for lane in lanes:
        part = lane.select(*group, key, "rank", "lane", *keep)
        union = part if union is None else union.unionByName(part)
    seen = F.col("lane").cast("long") * 1_000_000_000 + F.col("rank")
    return union.groupBy(*group, key).agg(
        F.sum(1.0 / (k + F.col("rank"))).alias("score"), F.min(seen).alias("first_seen"), *[F.min_by(c, seen).alias(c) for c in keep]).withColumn("source", F.lit("hybrid"))


def best(fused: DataFrame, limit: int) -> DataFrame:
    return fused.orderBy(F.desc("score"), "first_seen").limit(limit)


def citations(hits: DataFrame) -> DataFrame:
    return hits.select("chunk_id", "path", F.coalesce("heading_path", F.lit("root")).alias("heading_path"))


def answer_draft(hits: DataFrame) -> DataFrame:
    """One row: a line of path and heading for each hit in order of rank."""
    line = F.concat(F.lit("- "), F.coalesce("path", F.lit("None")), F.lit(" :: "), F.coalesce("heading_path", F.lit("root")))
    listed = F.array_sort(F.collect_list(F.struct(F.col("rank"), line.alias("line"))))
    return hits.agg(F.array_join(F.transform(listed, lambda x: x["line"]), "\n").alias("draft")).select(
        F.when(F.col("draft") == "", F.lit(NOTHING)).otherwise(F.col("draft")).alias("answer_draft"))
