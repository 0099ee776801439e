"""LM scoring by context-tree weighting over bytes, and an add-one unigram base.

A byte is eight binary decisions. Each decision (the bits before it in its
byte) has a context tree over the bytes before: a node for every suffix of up
to ``DEPTH`` bytes that training texts had. A node estimates its next bit by
Krichevsky-Trofimov, and mixes that with the mixture of the next longer
context, weighted by how well either coded the training texts (the posterior
weight of a node as a leaf of the tree, against the product of its children).

Counts of DEPTH + 1 byte strings are all that's gathered from the texts; nodes
of all depths are sums of those, and weights run up the tree level by level.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import fold, only, opened
from marginalia.session import cut, remove, scratch, ship

DEPTH = 4
END = 0xFF  # in no UTF-8 text: closes a text, and stands before its first byte
#: Nodes that one pass of scoring holds in memory (16 bytes each, 17 more while a level is read); beyond it documents are read once for each block.
BLOCK_NODES = 16_000_000
#: log10 probabilities are added up as whole numbers of this unit, so that sums don't depend on their order.
UNIT = 2.0**-36
PIECE = 1 << 20
CHUNK_TOKENS = 1 << 20
#: Distinct words of a hash bucket, and entries (words of a chunk) that one task adds up, on average.
BUCKET_WORDS, GROUP_ENTRIES = 1 << 16, 4_000_000
#: Least hashes of a chunk that the number of distinct words is estimated from.
SKETCH = 256
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


# ---------------------------------------------------------------- byte contexts


def pieces(texts: pa.Array, depth: int = DEPTH) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(index of the text, context and byte as one number) of every predicted byte, ends included, a piece at a time."""
    texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + PIECE, side="right")) - 1)
        lengths = np.diff(offsets[first : last + 1])
        n = last - first
        symbols = np.full(int(lengths.sum()) + n * (depth + 1), END, np.uint8)
        shift = np.arange(n) * (depth + 1) + depth
        symbols[np.arange(int(lengths.sum())) + np.repeat(shift, lengths)] = _LOWER[data[offsets[first] : offsets[last]]]
        predicted = np.ones(len(symbols), bool)
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]) + np.arange(n) * (depth + 1)
        predicted[starts[:, None] + np.arange(depth)] = False
        owner = np.repeat(np.arange(first, last), lengths + depth + 1)
        for at in range(depth, len(symbols), PIECE):  # a very long text comes in several
            to = min(at + PIECE, len(symbols))
            key = np.zeros(to - at, np.int64)
            for i in range(depth + 1):
                key = (key << 8) | symbols[at - depth + i : to - depth + i]
            keep = predicted[at:to]
            yield owner[at:to][keep], key[keep]
        first = last


def gram_counts(documents: DataFrame, depth: int = DEPTH) -> DataFrame:
    """gram, n: how often each string of depth + 1 bytes stands in the texts; combined within a task first."""
    ship(documents.sparkSession)

    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        keys, counts = np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        return keys[heads], np.add.reduceat(counts, heads)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for _, key in pieces(batch.column(0), depth):
                parts.append(np.unique(key, return_counts=True))
                if sum(len(k) for k, _ in parts[1:]) > 1_000_000:
                    parts = [merged(parts)]  # no more than the distinct strings of the task's texts
        if parts:
            keys, counts = merged(parts)
            for at in range(0, len(keys), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + 100_000]), pa.array(counts[at : at + 100_000])], names=["gram", "n"])

    return only(documents, "text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _lgamma(x: str) -> str:
    """ln Gamma of x >= 1/2 as SQL: Stirling's series after eight steps up."""
    y = f"({x} + 8D)"
    steps = " * ".join(f"({x} + {i}D)" for i in range(8))
    return (f"(({y} - 0.5D) * ln{y} - {y} + {0.5 * math.log(2 * math.pi)}D + 1D / (12D * {y}) - 1D / (360D * {y} * {y} * {y})"
            f" + 1D / (1260D * {y} * {y} * {y} * {y} * {y}) - ln({steps}))")


def tree(grams: DataFrame, depth: int = DEPTH) -> DataFrame:
    """depth, key (context << 8 | decision), a, b (zeros, ones), own (weight of the node's own estimate), one, seen.

    ``own`` is Pe / (Pe + product of the children's weighted probabilities), 1
    at full depth. Levels go from the longest contexts to the empty one, each
    an aggregation of the one before; a level is at most as large as that. On
    the way back each node takes from its parent what shorter contexts have
    mixed in: ``one`` is the probability of a one where this node is the longest
    context that training texts had (a longer one would say 1/2); ``seen`` is 1
    if zeros came, plus 2 if ones did.
    """
    estimate = f"{_lgamma('(a + 0.5D)')} + {_lgamma('(b + 0.5D)')} - {_lgamma('(a + b + 1D)')} - {math.log(math.pi)}D"
    level = grams.select("n", F.expr("gram & 255").alias("byte"), F.expr("shiftright(gram, 8)").alias("context"), F.explode(F.expr("sequence(0, 7)")).alias("j")).select(
        F.expr("shiftleft(context, 8) | shiftleft(1L, j) | shiftright(byte, 8 - j)").alias("key"), F.expr("shiftright(byte, 7 - j) & 1").alias("bit"), "n",
    ).groupBy("key").agg(F.sum(F.expr("if(bit = 0, n, 0L)")).alias("a"), F.sum(F.expr("if(bit = 1, n, 0L)")).alias("b"))
    level = cut(level.withColumn("weighted", F.expr(estimate)).withColumn("own", F.lit(1.0)))
    shorter = "shiftleft(shiftright(key, 8) & {}L, 8) | (key & 255)".format
    levels = [level]
    for d in range(depth - 1, -1, -1):
        level = (
            level.groupBy(F.expr(shorter((1 << 8 * d) - 1)).alias("key"))
            .agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("weighted").alias("split"))
            .withColumn("leaf", F.expr(estimate))
            .withColumn("own", F.expr("1D / (1D + exp(least(700D, split - leaf)))"))
            .withColumn("weighted", F.expr(f"greatest(leaf, split) + ln(1D + exp(-abs(leaf - split))) - {math.log(2)}D")))
        level = cut(level.select("key", "a", "b", "weighted", "own"))
        levels.append(level)
    out, passed = None, None
    for d, level in enumerate(reversed(levels)):
        level = level.withColumn("kt", F.expr("(b + 0.5D) / (a + b + 1D)"))
        if passed is None:
            level = level.withColumns({"so_far": F.lit(0.0), "left": F.lit(1.0)})
        else:  # a parent has at most 256 children
            level = level.withColumn("up", F.expr(shorter((1 << 8 * (d - 1)) - 1))).join(passed, "up")
        mixed = "kt" if d == depth else "own * kt + (1D - own) * 0.5D"
        level = level.withColumns({"depth": F.lit(d), "one": F.expr(f"so_far + left * ({mixed})"), "seen": F.expr("cast(if(a > 0, 1, 0) + if(b > 0, 2, 0) as byte)")})
        level = level if d == depth else cut(level)
        passed = level.select(F.col("key").alias("up"), F.expr("so_far + left * own * kt").alias("so_far"), F.expr("left * (1D - own)").alias("left"))
        some = level.select("depth", "key", "a", "b", "own", "one", "seen")
        out = some if out is None else out.unionByName(some)
    return out


class Model:
    """A tree (or the part of it under some last-two-byte contexts) as sorted arrays."""

    def __init__(self, level: Callable[[int], pa.Table], depth: int) -> None:
        """``level`` gives the nodes of one depth: num_rows, and to_batches() of key, one, seen; no more than a batch is held as read."""
        self.depth, self.keys, self.ones = depth, [], []
        for d in range(depth + 1):
            nodes, at = level(d), 0
            k, one, seen = np.empty(nodes.num_rows, np.int64), np.empty(nodes.num_rows), np.empty(nodes.num_rows if d == depth else 0, np.uint8)
            for batch in nodes.to_batches():
                to = at + batch.num_rows
                k[at:to], one[at:to] = batch.column("key").to_numpy(), batch.column("one").to_numpy()
                if d == depth:
                    seen[at:to] = batch.column("seen").to_numpy()
                at = to
            if len(k) > 1 and (k[1:] <= k[:-1]).any():  # written in order, but read in whatever
                order = np.argsort(k)
                k, one, seen = k[order], one[order], seen[order] if d == depth else seen
            self.keys.append(k)
            self.ones.append(one)
        grams = []
        for at in range(0, len(k), PIECE):  # the strings that training texts had, from the last decision of each byte
            part, flags = k[at : at + PIECE], seen[at : at + PIECE]
            last = (part & 255) >= 128
            context, decision, flags = part[last] >> 8 << 8, part[last] & 255, flags[last]
            grams += [context[flags & flag > 0] | ((decision << 1 | bit) & 255)[flags & flag > 0] for bit, flag in ((0, 1), (1, 2))]
        self.grams = np.sort(np.concatenate(grams or [np.empty(0, np.int64)]))
        self.known = np.concatenate([self.bits(self.grams[i : i + PIECE]) for i in range(0, len(self.grams), PIECE)] or [np.empty(0)])

    def bits(self, grams: np.ndarray) -> np.ndarray:
        """log10 probability of the last byte of each gram."""
        total = np.zeros(len(grams))
        for j in range(8):
            decision, bit = 1 << j | (grams & 255) >> (8 - j), grams >> (7 - j) & 1
            one = np.full(len(grams), 0.5)
            open_ = np.arange(len(grams))
            for d in range(self.depth, -1, -1):
                k = (grams[open_] >> 8 & ((1 << 8 * d) - 1)) << 8 | decision[open_]
                at = np.searchsorted(self.keys[d], k)
                found = at < len(self.keys[d])
                found[found] = self.keys[d][at[found]] == k[found]
                one[open_[found]] = self.ones[d][at[found]]
                open_ = open_[~found]
                if not len(open_):
                    break
            total += np.log10(np.where(bit == 1, one, 1 - one))
        return total

    def score(self, grams: np.ndarray) -> np.ndarray:
        """log10 probability of the last byte of each of the sorted grams."""
        if not len(self.grams):
            return self.bits(grams)
        at = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        out, new = self.known[at], self.grams[at] != grams
        out[new] = self.bits(grams[new])
        return out


class _Level:
    """The nodes of one depth in some folders, read a batch at a time."""

    def __init__(self, parts: list[ds.Dataset], d: int) -> None:
        self.parts, self.own = parts, pc.field("depth") == d
        self.num_rows = sum(p.count_rows(filter=self.own) for p in parts)

    def to_batches(self) -> Iterator[pa.RecordBatch]:
        for p in self.parts:
            yield from p.to_batches(columns=["key", "one", "seen"], filter=self.own, batch_size=1 << 16, batch_readahead=1, fragment_readahead=1, use_threads=False)


_MODELS: dict[tuple, Model] = {}


def _load(folder: str, block: int, blocks: int, depth: int) -> Model:
    key = (folder, block, blocks)
    if key not in _MODELS:  # once for each Python worker
        _MODELS.clear()
        where, base = opened(folder)
        parts = [ds.dataset(f"{base}/block={k}", filesystem=where, format="parquet") for k in (-1, block) if where.get_file_info(f"{base}/block={k}").type]
        _MODELS[key] = Model(lambda d: _Level(parts, d), depth)
    return _MODELS[key]


def code_lengths(documents: DataFrame, model: DataFrame, folder: str, depth: int = DEPTH, block_nodes: int = BLOCK_NODES) -> DataFrame:
    """doc_id, text_hash, score (log10 probability of text and end, lower-cased A-Z), n_bytes.

    The tree is written to ``folder`` (a URI that all can read) and read from
    there by the workers; its size is counted, and a larger one is cut by the last two bytes
    of the context (all longer contexts of a byte then lie in one block), each
    block scoring the bytes that are its own. A block of one context has at
    most 65,536 x 255 nodes at depth four, whatever the corpus.
    """
    spark = documents.sparkSession
    ship(spark)
    blocks = max(1, -(-model.count() // block_nodes))
    last_two = F.expr("shiftright(key, 8) & 65535")
    placed = model.select("depth", "key", "one", "seen", F.when(F.col("depth") < 2, F.lit(-1)).otherwise(F.pmod(F.xxhash64(last_two), F.lit(blocks)).cast("int")).alias("block"))
    placed.repartition("block").sortWithinPartitions("block", "depth", "key").write.partitionBy("block").parquet(folder)
    docs = only(documents, "doc_id", "text").withColumn("text_hash", F.xxhash64("text"))
    owners = np.array([r.b for r in spark.range(65536).select(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("b")).collect()] if blocks > 1 else [0] * 65536, np.int32)

    def scorer(block: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            made = _load(folder, block, blocks, depth)
            for batch in batches:
                score, n = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
                for owner, gram in pieces(batch.column(1), depth):
                    if blocks > 1:
                        mine = owners[(gram >> 8) & 65535] == block
                        owner, gram = owner[mine], gram[mine]
                    if not len(gram):
                        continue
                    code, distinct = pd.factorize(gram)
                    order = np.argsort(distinct)
                    units = np.empty(len(distinct), np.int64)
                    units[order] = np.rint(made.score(distinct[order]) / UNIT)
                    heads = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
                    score[owner[heads]] += np.add.reduceat(units[code], heads)
                    n[owner[heads]] += np.diff(np.append(heads, len(owner)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(score), pa.array(n)], names=["doc_id", "text_hash", "score", "n_bytes"])

        return run

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = None
    for block in range(blocks):
        part = docs.mapInArrow(scorer(block), f"doc_id {kind}, text_hash long, score long, n_bytes long")
        out = part if out is None else out.unionByName(part)
    if blocks > 1:
        out = out.groupBy("doc_id", "text_hash").agg(F.sum("score").alias("score"), F.sum("n_bytes").alias("n_bytes"), F.count(F.lit(1)).alias("rows")).withColumn(
            "times", F.expr(f"rows div {blocks}")).select(
            "doc_id", "text_hash", F.expr("score div times").alias("score"), F.expr("n_bytes div times").alias("n_bytes"), F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int"))).alias("_")).drop("_")
    return out.withColumn("score", F.col("score") * UNIT)


# ---------------------------------------------------------------- unigram base

def _chunk(rows: list[tuple], vocabulary: dict[bytes, int], name: str, schema: pa.Schema) -> pa.RecordBatch:
    """A chunk as one row: its distinct words' hashes in order, their training counts, and which of them each of its documents has."""
    hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in vocabulary), np.uint64, len(vocabulary))
    order = np.argsort(hashes)
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order))
    hashes = hashes[order]
    ids = [rank[seen] for *_, seen in rows]
    trained = [i for i, (_, _, t, _) in zip(ids, rows, strict=True) if t]
    counts = np.bincount(np.concatenate(trained) if trained else np.empty(0, np.int32), minlength=len(hashes)).astype(np.uint32)
    made = {
        "chunk": name, "hashes": hashes.tobytes(), "counts": counts.tobytes(), "least": hashes[:SKETCH].view(np.int64).tolist(), "entries": len(hashes),
        "docs": [d for d, *_ in rows], "text_hashes": [h for _, h, _, _ in rows], "trains": [t for _, _, t, _ in rows],
        "lengths": np.array([len(i) for i in ids], np.int64).tobytes(), "ids": (np.concatenate(ids) if ids else np.empty(0)).astype(np.uint32).tobytes(),
    }
    return pa.RecordBatch.from_arrays([pa.array([made[f.name]], f.type) for f in schema], schema=schema)


def _sliced(bits: int, salts: int):
    """Each chunk's words by hash bucket: bucket, salt, chunk, hashes, counts."""
    schema = pa.schema([("bucket", pa.int32()), ("salt", pa.int32()), ("chunk", pa.string()), ("hashes", pa.binary()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, h, c in zip(*batch.columns, strict=True):
                hashes, counts = np.frombuffer(h.as_buffer(), np.uint64), np.frombuffer(c.as_buffer(), np.uint32)
                bucket = (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)
                edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.empty(0, np.int64)
                salt = xxhash.xxh32_intdigest(chunk.as_py()) % salts
                rows = [(int(bucket[a]), salt, chunk.as_py(), hashes[a:b].tobytes(), counts[a:b].tobytes()) for a, b in zip(edges, [*edges[1:], len(bucket)], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    return run


def _added(hashes: pa.ChunkedArray, counts: pa.ChunkedArray, width: type) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of several packed arrays, and the sums of their counts."""
    words, back = np.unique(np.concatenate([np.frombuffer(h.as_buffer(), np.uint64) for h in hashes]), return_inverse=True)
    return words, np.bincount(back, np.concatenate([np.frombuffer(c.as_buffer(), width) for c in counts]), len(words)).astype(np.int64)


def unigram(documents: DataFrame, folder: str, train: str = "train", *, bucket_words: int = BUCKET_WORDS, group_entries: int = GROUP_ENTRIES) -> DataFrame:
    """doc_id, text_hash, n_tokens, n_known, train_tokens, base_score, train of every distinct row.

    Words are counted by chunks of about a million tokens: a chunk sends each
    distinct word's hash and training count once, packed by hash bucket; a
    bucket adds up over chunks and sends the totals back; a chunk then sums
    logarithms for its documents from totals and word numbers it kept. So a
    frequent word costs one entry a chunk, and no (document, word) pair is ever
    shuffled. Buckets are as many as the distinct words need (estimated from each
    chunk's least hashes), and a bucket's chunks are split by a salt where they
    have more entries than one task should hold; sums of the parts are then
    added. Words are told apart by 64-bit hashes. Ids keep their type.
    """
    spark = documents.sparkSession
    ship(spark)
    docs = only(documents, "doc_id", "text", train).select("doc_id", F.xxhash64("text").alias("text_hash"), F.col(train).cast("boolean").alias("train"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    made = f"chunk string, hashes binary, counts binary, least array<long>, entries long, docs array<{kind}>, text_hashes array<long>, trains array<boolean>, lengths binary, ids binary"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, vocabulary, tokens, k = [], {}, 0, 0
        schema = None
        for batch in batches:
            if schema is None:
                lists = {"docs": pa.list_(batch.schema.field(0).type), "least": pa.list_(pa.int64()), "text_hashes": pa.list_(pa.int64()), "trains": pa.list_(pa.bool_()), "chunk": pa.string(), "entries": pa.int64()}
                schema = pa.schema([(n, lists.get(n, pa.binary())) for n in ("chunk", "hashes", "counts", "least", "entries", "docs", "text_hashes", "trains", "lengths", "ids")])
            for d, h, t, text in zip(*batch.columns, strict=True):
                found = (text.as_py() or "").encode().lower().split()
                seen = np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in found), np.int32, len(found))
                rows.append((d.as_py(), h.as_py(), t.as_py(), seen))
                tokens += len(found) + 1
                if tokens >= CHUNK_TOKENS:
                    yield _chunk(rows, vocabulary, f"{TaskContext.get().partitionId()}.{k}", schema)
                    rows, vocabulary, tokens, k = [], {}, 0, k + 1
        if rows:
            yield _chunk(rows, vocabulary, f"{TaskContext.get().partitionId()}.{k}", schema)

    docs.mapInArrow(count, made).write.option("compression", "zstd").option("parquet.block.row.count.limit", 16).parquet(f"{folder}/parts")
    parts = spark.read.parquet(f"{folder}/parts")
    ends, entries = parts.agg(F.coalesce(F.sum(F.size(F.filter("trains", lambda t: t))), F.lit(0)), F.coalesce(F.sum("entries"), F.lit(0))).first()
    least = [r.h & (1 << 64) - 1 for r in parts.select(F.explode("least").alias("h")).distinct().orderBy(F.expr("h < 0"), "h").limit(SKETCH).collect()]
    distinct = len(least) if len(least) < SKETCH else (SKETCH - 1) * (1 << 64) / (max(least) + 1)
    bits = max(0, math.ceil(math.log2(distinct / bucket_words))) if distinct else 0
    salts = max(1, math.ceil(entries / 2**bits / group_entries))
    sent = parts.select("chunk", "hashes", "counts").mapInArrow(_sliced(bits, salts), "bucket int, salt int, chunk string, hashes binary, counts binary")
    back_kind = "chunk string, bucket int, totals binary, v long, n long"

    def answer(hashes: pa.ChunkedArray, chunk: pa.ChunkedArray, bucket: int, words: np.ndarray, totals: np.ndarray, whole: bool) -> pa.Table:
        own = [totals[np.searchsorted(words, np.frombuffer(h.as_buffer(), np.uint64))].tobytes() for h in hashes]
        v, n = (int((totals > 0).sum()), int(totals.sum())) if whole else (0, 0)  # told once a bucket
        once = [1] + [0] * (len(own) - 1)
        return pa.table({"chunk": chunk, "bucket": pa.array([bucket] * len(own), pa.int32()), "totals": pa.array(own, pa.binary()), "v": pa.array([v * x for x in once], pa.int64()), "n": pa.array([n * x for x in once], pa.int64())})

    if salts == 1:
        def add(key, group):
            return answer(group["hashes"], group["chunk"], key[0].as_py(), *_added(group["hashes"], group["counts"], np.uint32), True)

        told = sent.groupBy("bucket").applyInArrow(add, back_kind)
    else:
        def part(key, group):
            words, totals = _added(group["hashes"], group["counts"], np.uint32)
            return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "words": pa.array([words.tobytes()], pa.binary()), "sums": pa.array([totals.tobytes()], pa.binary())})

        def whole(key, group):
            words, totals = _added(group["words"], group["sums"], np.int64)
            return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "words": pa.array([words.tobytes()], pa.binary()), "sums": pa.array([totals.tobytes()], pa.binary())})

        packed = "bucket int, words binary, sums binary"
        held = cut(sent.groupBy("bucket", "salt").applyInArrow(part, packed).groupBy("bucket").applyInArrow(whole, packed))
        held = held.select("*", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))

        def tell(key, asked, known):
            words, totals = np.frombuffer(known["words"][0].as_buffer(), np.uint64), np.frombuffer(known["sums"][0].as_buffer(), np.int64)
            if not asked.num_rows:  # a salt without chunks in this bucket still tells the sums, if it's the first
                asked = pa.table({"hashes": pa.array([b""], pa.binary()), "chunk": pa.array([None], pa.string())})
            return answer(asked["hashes"], asked["chunk"], key[0].as_py(), words, totals, key[1].as_py() == 0)

        told = sent.groupBy("bucket", "salt").cogroup(held.groupBy("bucket", "salt")).applyInArrow(tell, back_kind)
    told.write.option("compression", "zstd").option("parquet.block.row.count.limit", 64).parquet(f"{folder}/totals")
    totals = spark.read.parquet(f"{folder}/totals")
    v, n = totals.agg(F.coalesce(F.sum("v"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    v, n = v + (ends > 0), n + ends

    def sums(key, group):
        group = group.sort_by("bucket")  # the chunk's own row has bucket -1
        own = {c: group[c][0] for c in ("docs", "text_hashes", "trains", "lengths", "ids")}
        known = [np.frombuffer(t.as_buffer(), np.int64) for t in group["totals"][1:]]
        c = np.concatenate(known) if known else np.empty(0, np.int64)
        ids, lengths = np.frombuffer(own["ids"].as_buffer(), np.uint32), np.frombuffer(own["lengths"].as_buffer(), np.int64)
        row, tokens = np.repeat(np.arange(len(lengths)), lengths), lengths + 1
        return pa.table({
            "doc_id": own["docs"].values, "text_hash": own["text_hashes"].values, "n_tokens": tokens,
            "n_known": np.bincount(row, c[ids] > 0, len(lengths)).astype(np.int64) + int(ends > 0), "train_tokens": np.full(len(tokens), n, np.int64),
            "base_score": np.bincount(row, np.log10(c + 1.0)[ids], len(lengths)) + math.log10(ends + 1) - tokens * math.log10(n + v + 1), "train": own["trains"].values,
        })

    back = parts.select("chunk", F.lit(-1).alias("bucket"), F.lit(None).cast("binary").alias("totals"), "docs", "text_hashes", "trains", "lengths", "ids").unionByName(
        totals.where("chunk is not null").select("chunk", "bucket", "totals"), allowMissingColumns=True)
    return back.groupBy("chunk").applyInArrow(
        sums, f"doc_id {kind}, text_hash long, n_tokens long, n_known long, train_tokens long, base_score double, train boolean").dropDuplicates(["doc_id", "text_hash"])


def lm_scores(documents: DataFrame, *, modulus: int = 7, held: int = 2, depth: int = DEPTH, block_nodes: int = BLOCK_NODES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte of every document.

    Both models learn from the documents outside the held-out fold. Null text is
    empty: one end to code. A null id is the empty id to the fold, and another
    id in the result. Ids may be of any type and hold any characters. Repeated
    rows are learnt from and scored each. Without training documents every bit
    costs one bit. An empty table gives no rows.
    """
    spark = documents.sparkSession
    folder = scratch(spark, "lm")
    try:
        docs = only(documents, "doc_id", "text").withColumn("train", fold(F.col("doc_id"), modulus) != held)
        model = cut(tree(cut(gram_counts(docs.where("train"), depth)), depth))
        base = unigram(docs, f"{folder}/unigram")
        coded = code_lengths(documents, model, f"{folder}/tree", depth, block_nodes)
        base = base.select(F.col("doc_id").alias("base_id"), F.col("text_hash").alias("base_hash"), "n_tokens", "n_known", "train_tokens", "base_score", "train")
        return cut(coded.join(base, F.col("doc_id").eqNullSafe(F.col("base_id")) & (F.col("text_hash") == F.col("base_hash"))).select(
            "doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes",
            (-F.col("score") * math.log2(10) / F.col("n_bytes")).alias("bits_per_byte")))
    finally:
        remove(spark, folder)
