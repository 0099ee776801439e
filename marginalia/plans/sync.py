"""Incremental synchronisation of the index with a tree of notes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATE = "path string, content_hash string, mtime double, updated_at double"
CHUNKS = (
    "seq struct<batch:bigint,nth:bigint>, chunk_id string, note_id string, text string, path string, note_title string, heading_path string, "
    "tags array<string>, links array<string>, tasks array<string>, frontmatter string, derived_fields map<string,string>, mtime double")
VECTORS = "chunk_id string, seq struct<batch:bigint,nth:bigint>, embedding array<float>"
#: Of each chunk what ranking needs, without its text.
LENGTHS = "chunk_id string, seq struct<batch:bigint,nth:bigint>, dl bigint"
POSTINGS = "term string, chunk_id string, positions array<int>, tf int, dl int"
SCHEMAS = {"chunks": CHUNKS, "vectors": VECTORS, "postings": POSTINGS, "lengths": LENGTHS, "state": STATE}
KEYS = {"chunks": "chunk_id", "vectors": "chunk_id", "postings": "chunk_id", "lengths": "chunk_id", "state": "path"}
MODES = ("full", "incremental", "file")


def plan_sync(current: DataFrame, state: DataFrame, full: bool = False) -> DataFrame:
    """path, content_hash, mtime, status (new, changed, unchanged) of what's there now.

    ``current`` has path, content_hash, mtime. In full mode all is to be done
    again, but what's gone isn't purged by that.
    """
    old = state.select("path", F.col("content_hash").alias("old_hash"))
    same = F.col("old_hash").eqNullSafe(F.col("content_hash"))
    status = F.when(F.col("old_hash").isNull(), "new").when(~same | F.lit(full), "changed").otherwise("unchanged")
    return current.join(old, "path", "left").withColumn("status", status)


def should_reindex(current: DataFrame, state: DataFrame) -> DataFrame:
    return plan_sync(current, state).select("path", (F.col("status") != "unchanged").alias("reindex"))


def missing(state: DataFrame, current: DataFrame) -> DataFrame:
    """Tracked paths that are gone."""
    return state.join(current.select("path"), "path", "left_anti").select("path")


def counts(plan: DataFrame, gone: DataFrame, errors: DataFrame) -> DataFrame:
    """One row: processed, skipped, deleted, errors (sorted list)."""
    a = plan.agg(F.count_if(F.col("status") != "unchanged").alias("processed"), F.count_if(F.col("status") == "unchanged").alias("skipped"))
    b = gone.agg(F.count(F.lit(1)).alias("deleted"))
    c = errors.agg(F.array_sort(F.collect_list("error")).alias("errors"))
    return a.crossJoin(b).crossJoin(c)  # one row each


def tracked(state: DataFrame) -> DataFrame:
    return state.select("path").distinct()


def last_sync(state: DataFrame) -> DataFrame:
    return state.agg(F.max("updated_at").alias("last_sync_timestamp"))


def recorded(done: DataFrame, now: float) -> DataFrame:
    """The rows of state for what was done."""
    return done.select("path", "content_hash", "mtime", F.lit(float(int(now))).alias("updated_at"))


def record(state: DataFrame, done: DataFrame, gone: DataFrame, now: float) -> DataFrame:
    """The state after a run: what was done with its new hash, without what's gone."""
    fresh = recorded(done, now)
    kept = state.join(fresh.select("path").unionByName(gone.select("path")).distinct(), "path", "left_anti")
    return kept.select("path", "content_hash", "mtime", "updated_at").unionByName(fresh)
