"""The verbs: sync, search, query, note context, status, health."""

from __future__ import annotations

import json
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.config import Config
from marginalia.functions import text as T
from marginalia.operators import chunk, embed, filters, fusion, keyword, parse, vector
from marginalia.plans import sync as plans
from marginalia.session import cut, together
from marginalia.sources import store, vault

RESULT = ("chunk_id", "score", "source", "text")
METADATA = ("path", "note_title", "heading_path", "tags", "links", "tasks", "frontmatter", "derived_fields", "mtime")


class NoteIndex:
    """An index of one tree of notes.

    ``stale='replace'`` drops the chunks of a note's earlier version and keeps
    what a surviving copy of a removed note needs; ``'keep'`` only drops chunks
    of removed paths. ``dates`` as in ``parse_notes``; ``syntax`` 'fts' takes
    queries as query language, 'plain' as mere words.
    """

    def __init__(self, spark: SparkSession, config: Config, embedder: embed.Embedder | None = None, *, stale: str = "replace", dates: str = "iso",
                 syntax: str = "fts", metric: str = "cosine", exact_filter: bool = False) -> None:
        self.spark, self.config = spark, config
        self.embedder = embedder or embed.HttpEmbedder(config.embedder_url, config.embedding_model)
        self.stale, self.dates, self.syntax, self.metric, self.exact_filter = stale, dates, syntax, metric, exact_filter
        self.store = store.SnapshotStore(spark, str(config.store_path), plans.SCHEMAS, plans.KEYS)
        vault.register(spark)

    # ------------------------------------------------------------------ writing

    def _files(self, some: list[str] | None = None) -> DataFrame:
        reader = self.spark.read.format("vault").option("exclude", json.dumps(self.config.exclude_globs))
        return (reader if some is None else reader.option("files", json.dumps(some))).load(str(self.config.vault_path))

    def _inside(self, file_path: str) -> Path:
        root = Path(self.config.vault_path).resolve()
        full = (root / file_path).resolve()
        if not full.is_relative_to(root):
            raise ValueError("file_path must lie inside the vault")
        return full

    def sync(self, mode: str = "incremental", file_path: str | None = None) -> dict:
        """processed, skipped, deleted, errors. Modes: full, incremental, file."""
        if mode not in plans.MODES:
            raise ValueError(f"mode must be one of {plans.MODES}")
        if mode != "file":
            return self._apply(self._files(), full=mode == "full", purge=True)
        if not file_path:
            raise ValueError("file_path is required when mode='file'")
        full = self._inside(file_path)
        if not full.exists():
            raise FileNotFoundError(str(full))
        return self.sync_files([file_path])

    def sync_files(self, paths: list[str]) -> dict:
        """These files and no others; those that aren't there are passed over."""
        root = Path(self.config.vault_path).resolve()
        there = sorted({str(f.relative_to(root)) for f in map(self._inside, paths) if f.exists()})
        return self._apply(self._files(there), full=False, purge=False)

    def _apply(self, files: DataFrame, full: bool, purge: bool) -> dict:
        """Hash what's there, parse only what changed, and write only the rows that come and the keys that go."""
        hashed = cut(files.select("seq", "path", "mtime", "error", T.content_hash(F.col("text")).alias("content_hash")))
        old, state = self.store.read("chunks"), self.store.read("state")
        plan, gone = together(
            self.spark, lambda: cut(plans.plan_sync(hashed.where("error is null").select("path", "content_hash", "mtime"), state, full)),
            # a path that can't be read now is still there: its chunks stay
            lambda: cut(plans.missing(state, hashed) if purge else state.where("false").select("path")))
        redo = plan.where("status <> 'unchanged'").select("path")
        if self.stale == "replace":
            # texts that leave the index may have a copy elsewhere, which is then indexed anew
            leaving = state.join(gone.unionByName(plan.where("status = 'changed'").select("path")), "path", "left_semi").select("content_hash").distinct()
            redo = redo.unionByName(plan.where("status = 'unchanged'").join(leaving, "content_hash", "left_semi").select("path")).distinct()
        redo = cut(redo)
        some = not redo.isEmpty()
        held = lambda df: cut(df) if some else df.where("false")  # noqa: E731 - without a note to do again there's nothing to plan or run
        notes = held(parse.parse_notes(files.where("error is null").drop("error").join(redo, "path", "left_semi"), self.dates))
        bad = notes.where("error is not null")
        errors = hashed.where("error is not null").select("error").unionByName(bad.select(F.concat_ws(": ", "path", "error").alias("error")))
        plan = plan.join(bad.select("path"), "path", "left_anti")
        notes, redo = notes.where("error is null").drop("error"), redo.join(bad.select("path"), "path", "left_anti")
        made = chunk.chunk_notes(notes, self.config.chunk_size, self.config.chunk_overlap, self.config.redact_patterns)
        batch = self.store.version() + 1
        ordered = made.orderBy("seq", "section", "nth").withColumn("seq", F.struct(F.lit(batch).cast("bigint").alias("batch"), F.monotonically_increasing_id().alias("nth")))
        fresh = held(ordered.drop("section", "nth"))
        fresh = fresh.groupBy("chunk_id").agg(F.max_by(F.struct(*fresh.columns), "seq").alias("r")).select("r.*")
        # a chunk that stays under its id keeps its place in order of insertion
        fresh = held(fresh.join(old.select("chunk_id", F.col("seq").alias("was")), "chunk_id", "left").withColumn("seq", F.coalesce("was", "seq")).drop("was"))
        left = gone if self.stale == "keep" else gone.unionByName(redo).distinct()
        dropped, index, vectors = together(
            self.spark, lambda: cut(old.join(left, "path", "left_semi").select("chunk_id").unionByName(fresh.select("chunk_id")).distinct()),
            lambda: held(keyword.postings(fresh)), lambda: self._vectors(fresh) if some else self.store.read("vectors").where("false"))
        done = notes.join(plan.where("status <> 'unchanged'").select("path"), "path", "left_semi")
        lengths = keyword.doc_lengths(fresh).join(fresh.select("chunk_id", "seq"), "chunk_id")
        changes = {
            "chunks": (fresh, dropped), "vectors": (vectors, dropped), "lengths": (lengths, dropped),
            "postings": (index.repartitionByRange("term", "chunk_id").sortWithinPartitions("term", "chunk_id"), dropped),
            "state": (plans.recorded(done, time.time()), gone.unionByName(done.select("path"))),
        }
        return together(self.spark, lambda: self.store.apply(changes), lambda: plans.counts(plan, gone, errors).first().asDict())[1]

    def _vectors(self, fresh: DataFrame) -> DataFrame:
        """Embeddings of new chunks, all as long as those that are there, or as the first."""
        made = cut(embed.embed(fresh, self.embedder).join(fresh.select("chunk_id", "seq"), "chunk_id"))
        first = self.store.read("vectors").select(F.size("embedding").alias("n")).first() or made.select(F.size("embedding").alias("n")).first()
        return vector.check_dimension(made, first.n) if first else made

    def delete_note(self, note_id: str) -> None:
        """Drop a note's chunks from all tables."""
        ids = self.store.read("chunks").where(F.col("note_id") == note_id).select("chunk_id")
        self.store.apply({n: (self.store.read(n).where("false"), ids) for n, key in plans.KEYS.items() if key == "chunk_id"})

    # ------------------------------------------------------------------ reading

    def keyword_lane(self, query: str, filters_: dict | None, limit: int) -> DataFrame:
        stats = keyword.corpus_stats(self.store.read("lengths"))
        return keyword.search(self.store.read("chunks"), self.store.read("postings"), stats, query, limit, filters_, self.syntax, self.exact_filter)

    def semantic_lane(self, query: str, filters_: dict | None, limit: int) -> DataFrame:
        """The nearest 3 * limit chunks that pass the filters, cut to limit."""
        chunks, vectors = self.store.read("chunks"), self.store.read("vectors")
        ok = filters.compile_filters(filters_)
        if self.exact_filter:
            vectors = vectors.join(chunks.where(ok).select("chunk_id"), "chunk_id", "left_semi")
        near = vector.topk(vectors, self.embedder.embed([query])[0], 3 * limit, self.metric, tie="seq")
        hits = chunks.join(F.broadcast(near.drop("seq")), "chunk_id")  # at most 3 * limit rows
        return hits.where(ok).orderBy(F.desc("score"), "seq").limit(limit).withColumn("source", F.lit("semantic"))

    def hits(self, query: str, filters_: dict | None = None, top_k: int = 10) -> DataFrame:
        """Fused hits in order: rank, chunk_id, score, source, text and metadata; one plan for both lanes."""
        from pyspark.sql import Window

        q = " ".join(query.lower().split())
        keep = ["text", *METADATA]
        order = [F.desc("score"), F.asc("seq")]
        lanes = [fusion.ranked(self.semantic_lane(q, filters_, top_k), 0, order), fusion.ranked(self.keyword_lane(q, filters_, top_k), 1, order)]
        best = fusion.best(fusion.rrf(lanes, keep=keep), top_k)
        return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "first_seen"))).drop("first_seen")

    @staticmethod
    def _shape(row) -> dict:
        meta = {k: row[k] for k in METADATA}
        meta["raw_frontmatter"] = json.loads(meta.pop("frontmatter") or "{}")
        return {k: row[k] for k in RESULT} | {"metadata": meta}

    def search(self, query: str, filters: dict | None = None, top_k: int = 10) -> dict:
        rows = self.hits(query, filters, top_k).orderBy("rank").collect()  # at most top_k
        return {"query": query, "hits": [self._shape(r) for r in rows]}

    def query(self, query: str, filters: dict | None = None, top_k: int = 8) -> dict:
        chunks = self.search(query, filters, top_k)["hits"]
        cited = [{"chunk_id": h["chunk_id"], "path": h["metadata"]["path"], "heading_path": h["metadata"].get("heading_path") or "root"} for h in chunks]
        return {
            "answer_draft": "\n".join(f"- {c['path']} :: {c['heading_path']}" for c in cited) or fusion.NOTHING,
            "citations": cited, "chunks": chunks, "debug_scores": [h["score"] for h in chunks],
        }

    def note_context(self, note_path: str, backlinks: bool = False) -> dict:
        """Chunks and links of a note. Links to it are only looked up on demand."""
        chunks = self.store.read("chunks")
        own = chunks.where(F.col("path") == note_path)
        row = own.agg(F.array_sort(F.collect_list(F.struct("seq", "chunk_id"))).alias("ids"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("links")))).alias("out")).first()
        ids = [r.chunk_id for r in row.ids]
        back: list[str] = []
        if backlinks:
            names = [note_path, note_path.removesuffix(".md"), Path(note_path).stem]
            to = chunks.where(F.exists("links", lambda x: F.split(x, "#")[0].isin(names)) & (F.col("path") != note_path))
            back = [r.path for r in to.select("path").distinct().orderBy("path").collect()]
        return {"note_path": note_path, "chunk_ids": ids, "chunk_count": len(ids), "outlinks": row.out, "backlinks": back}

    def status(self) -> dict:
        state = self.store.read("state")
        return {
            "watch_enabled": self.config.watch_enabled, "max_context_chunks": self.config.max_context_chunks, "model": self.config.embedding_model,
            "index_size": self.store.read("chunks").count(), "last_sync_timestamp": plans.last_sync(state).first()[0],
            "watcher_state": "enabled" if self.config.watch_enabled else "disabled", "last_tracked_files": plans.tracked(state).count(), "model_available": self.embedder.health(),
        }

    def health(self) -> dict:
        there = self.store.exists()
        return {"vectors": there, "embedder": self.embedder.health(), "keywords": there}
