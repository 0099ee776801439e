"""Continuous synchronisation: the change stream drives the batch functions."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from marginalia.service import NoteIndex
from marginalia.sources.vault import SUFFIX


def latest(changes: DataFrame) -> DataFrame:
    """One row a path: the last kind of change in a batch, notes only."""
    notes = changes.where(F.endswith(F.col("path"), F.lit(SUFFIX)))
    order = [c for c in ("seq", "mtime") if c in changes.columns][:1]
    return notes.groupBy("path").agg(F.max_by("kind", order[0]).alias("kind"))


#: Changed files up to which a batch does each by itself; the first batch is the whole tree.
MOST_FILES = 1000


def apply_batch(index: NoteIndex, changes: DataFrame) -> dict | None:
    """Deletions, or very many changes, make one incremental pass; otherwise the changed files are done, and no others read.

    A path that was created and is gone again is left to the next deletion event.
    """
    kinds = latest(changes).orderBy("path").limit(MOST_FILES + 1).collect()
    if not kinds:
        return None
    if len(kinds) > MOST_FILES or any(r.kind == "deleted" for r in kinds):
        return index.sync("incremental")
    return index.sync_files([r.path for r in kinds])


def watch(index: NoteIndex, checkpoint: str, interval: str = "1 second", once: bool = False) -> StreamingQuery:
    """Start the stream. ``interval`` is the debounce; ``once`` handles what's there and stops."""
    stream = index.spark.readStream.format("vault_changes").option("exclude", json.dumps(index.config.exclude_globs)).load(str(index.config.vault_path))
    writer = stream.writeStream.foreachBatch(lambda batch, _: apply_batch(index, batch)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()
