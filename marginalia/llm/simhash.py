"""Near-duplicates by SimHash fingerprints and multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from marginalia.llm.common import hot_join, only
from marginalia.session import cut, ship

SHINGLE, SEED, DISTANCE = 4, 42, 4
#: (bits, radius on the probing side, radius on the table side) of each segment, from the top.
#: Four differing bits over three segments: if the first two have two each, the third has none.
NARROW = ((22, 1, 0), (21, 1, 0), (21, 0, 0))
#: Over two segments: two in the first (one on either side), or else at most one in the second.
WIDE = ((32, 1, 1), (32, 1, 0))
#: From so many fingerprints on, two wide segments cost less than three narrow ones.
WIDE_FROM = 1 << 25
#: A table entry with more fingerprints than this is split by segments of the other bits.
HOT = 1024


def fingerprint(text: str | None, k: int = SHINGLE) -> int:
    """64 bits; a bit is one if over half of the shingles' XXH64 have it. No words: 0."""
    found = (text or "").encode().lower().split()  # bytes: A-Z only, and blanks as the contract has them
    if not found:
        return 0
    if len(found) <= k:
        return xxhash.xxh64_intdigest(b" ".join(found), SEED)
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(b" ".join(g), SEED) for g in zip(*[found[i:] for i in range(k)], strict=False)], dtype=">u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):  # bounded however long the text
        ones += np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">u8")[0])


def fingerprints(documents: DataFrame, k: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long), one row a document. Null text has fingerprint 0."""
    ship(documents.sparkSession)
    docs = only(documents, "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.fromiter((fingerprint(t.as_py(), k) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits.view(np.int64))], names=["doc_id", "fp"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def _ball(value: str, width: int, plan: Sequence[tuple[int, int, int]], side: int, either: bool = True) -> Column:
    """Keys under which ``value`` (its low ``width`` bits) stands on one side: segment number and bits.

    Where only the probing side has a ball and ``either`` of two values may
    probe, it need only turn zeros to ones: one of them has the zero.
    """
    keys, shift = [], width
    for n, (bits, *radius) in enumerate(plan):
        shift -= bits
        part, tag = f"(shiftrightunsigned({value}, {shift}) & {(1 << bits) - 1}L)", f"{n << 40}L"
        keys.append(f"array({tag} | {part})")
        if radius[side]:
            which = f"sequence(0, {bits - 1})"
            if either and not all(radius):
                which = f"filter({which}, i -> (shiftright({part}, i) & 1L) = 0)"
            keys.append(f"transform({which}, i -> {tag} | ({part} ^ shiftleft(1L, i)))")
    return F.expr(f"concat({', '.join(keys)})")


def _thirds(width: int) -> tuple[tuple[int, int, int], ...]:
    third = width // 3
    return ((width - 2 * third, 1, 0), (third, 1, 0), (third, 0, 0))


def links(fps: DataFrame, plan: Sequence[tuple[int, int, int]] = NARROW, distance: int = DISTANCE, hot: int = HOT) -> DataFrame:
    """All pairs (u, v), u < v, of distinct fingerprints that differ in at most ``distance`` bits.

    ``fps`` has the distinct values in column fp. Each stands in the table under
    its segments; small Hamming balls around its segments are looked up there
    and whole distances verified. Entries of over ``hot`` values (many values
    that share a segment) are joined on segments of the remaining bits as well,
    by the same scheme, so no entry is ever multiplied out as a whole.
    """
    assert distance == DISTANCE, "the radii of the segments are for distance 4"
    left = fps.select(F.explode(_ball("fp", 64, plan, 0)).alias("key"), "fp")
    right = fps.select(F.explode(_ball("fp", 64, plan, 1)).alias("key"), F.col("fp").alias("other"))
    heavy = cut(right.groupBy("key").count().where(F.col("count") > hot).select("key"))
    near = (F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= distance) & (F.col("fp") != F.col("other"))
    found = None
    if not heavy.isEmpty():
        lows = []
        for side, df, name in ((0, left, "fp"), (1, right, "other")):
            rest, low = None, 64
            for n, (bits, *_) in enumerate(plan):
                low -= bits
                sub = _ball(f"(shiftleft(shiftrightunsigned({name}, {min(63, low + bits)}), {low}) | ({name} & {(1 << low) - 1}L))" if n else f"({name} & {(1 << low) - 1}L)",
                            64 - bits, _thirds(64 - bits), side, either=False)
                rest = F.when(F.shiftrightunsigned("key", 40) == n, sub) if rest is None else rest.when(F.shiftrightunsigned("key", 40) == n, sub)
            lows.append(df.join(heavy, "key", "left_semi").select("key", F.explode(rest).alias("sub"), name))
        found = lows[0].join(lows[1], ["key", "sub"]).where(near).select("fp", "other")
        left, right = left.join(heavy, "key", "left_anti"), right.join(heavy, "key", "left_anti")
    cold = left.join(right, "key").where(near).select("fp", "other")
    found = cold if found is None else found.unionByName(cold)
    return found.select(F.least("fp", "other").alias("u"), F.greatest("fp", "other").alias("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (its component's smallest node) for every node that has an edge.

    Large-star and small-star in turn until nothing changes. Each round is a
    minimum by node (combined before the shuffle) and a join that keeps the rows
    of a star's hub where they are, written to the shared folder; the driver sees
    only a count and a checksum.
    """
    edges = cut(edges.select("u", "v"))
    seen = None
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = cut(hot_join(both.where("v > u"), low, "u").select(F.col("m").alias("u"), "v").where("u <> v").distinct())
        down = large.groupBy("v").agg(F.min("u").alias("m"))
        edges = cut(
            hot_join(large, down, "v").select(F.col("m").alias("a"), F.col("u").alias("b")).where("a <> b")
            .unionByName(down.select(F.col("m").alias("a"), F.col("v").alias("b")))
            .select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct())
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        seen = now
    return edges.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(
        edges.select(F.col("u").alias("node"), F.col("u").alias("root"))).distinct()


def near_duplicates(documents: DataFrame, *, hot: int = HOT) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable), one row a document.

    Exact copies are one fingerprint and never paired with each other: only
    distinct fingerprints are linked, so a group that holds a third of all rows
    costs one value. Null and empty texts have fingerprint 0 and are linked like
    any other. A null id is never the smallest unless all are null. Rows that
    repeat stay repeated; an empty table gives no rows.
    """
    return _grouped(documents, hot).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _grouped(documents: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, fp, root (a fingerprint that names the component), component_id, one row a document."""
    docs = cut(fingerprints(documents))
    first = cut(docs.groupBy("fp").agg(F.min("doc_id").alias("first")))
    plan = WIDE if first.count() >= WIDE_FROM else NARROW
    roots = cut(components(links(first.select("fp"), plan, hot=hot)))
    least = first.join(roots, first["fp"] == roots["node"]).groupBy("root").agg(F.min("first").alias("least"))
    named = roots.join(least, "root").select(F.col("node").alias("fp"), "root", "least")
    ids = first.join(named, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("least", "first").alias("component_id"))
    return hot_join(docs, ids, "fp").select("doc_id", "fp", "root", "component_id")


def _beside(documents: DataFrame) -> DataFrame:
    """All columns, and the fingerprint as __fp."""
    ship(documents.sparkSession)
    at = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.fromiter((fingerprint(t.as_py()) for t in batch.column(at)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bits.view(np.int64))], names=[*batch.schema.names, "__fp"])

    return documents.mapInArrow(run, StructType([*documents.schema.fields, StructField("__fp", LongType())]))


def keep_one(documents: DataFrame) -> DataFrame:
    """Of every component one row: of those with the smallest id (null only if all are), one with the least fingerprint; all columns stay.

    What goes is named by id and taken out by an anti-join. An id that several
    rows have, null included, doesn't say which is meant: those rows are told
    apart by their fingerprint as well.
    """
    found = cut(_grouped(documents).select("doc_id", "fp", "root"))
    best = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp")).alias("b"))
    stays = cut(best.select(F.col("b.doc_id").alias("__id"), F.col("b.fp").alias("__of")))
    again = cut(found.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("__gone")))
    gone = found.join(stays, found["doc_id"].eqNullSafe(stays["__id"]) & (found["fp"] == stays["__of"]), "left_anti").select(F.col("doc_id").alias("__gone"))
    gone = gone.unionByName(again).distinct()
    left = documents.join(gone, documents["doc_id"].eqNullSafe(gone["__gone"]), "left_anti")
    if again.isEmpty():
        return left
    repeated = _beside(documents.join(again, documents["doc_id"].eqNullSafe(again["__gone"]), "left_semi"))
    one = repeated.join(stays, repeated["doc_id"].eqNullSafe(stays["__id"]) & (repeated["__fp"] == stays["__of"]), "left_semi").dropDuplicates(["doc_id", "__fp"])
    return left.unionByName(one.drop("__fp"))
