"""Token counts from flat token files by a separator scan.

A token file is a bare array of unsigned 16-bit ids: documents one after the
other, each closed by an end-of-document id, without an index.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.llm.common import only, opened
from marginalia.session import cut, shared_dir, ship

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
EOD = 50256
BLOCK_TOKENS = 1 << 20


_ENCODERS: dict = {}


def ranks(vocabulary: str, eod: int = EOD) -> dict[bytes, int]:
    """The public vocabulary at that path; refused if its ids don't fit 16 bits or one of them is the separator's."""
    with open(vocabulary, "rb") as lines:
        found = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    if eod in (ids := set(found.values())) or max(ids | {eod}) > 0xFFFF:
        raise ValueError(f"{vocabulary} has ids above 65535, or gives {eod} to a token")
    return found


def encoder(vocabulary: str, eod: int = EOD):
    """Its encoder, made once for each Python worker."""
    if (vocabulary, eod) not in _ENCODERS:
        import tiktoken

        _ENCODERS[vocabulary, eod] = tiktoken.Encoding("given", pat_str=PATTERN, mergeable_ranks=ranks(vocabulary, eod), special_tokens={})
    return _ENCODERS[vocabulary, eod]


def write_tokens(documents: DataFrame, folder: str, *, vocabulary: str = VOCABULARY, eod: int = EOD) -> DataFrame:
    """Write token files, one a partition, and return where documents went: file, nth, doc_id, size (of the file, so far).

    The order of ids in a file is kept, not their offsets; those are what the
    scan finds. A file is written under a name of its attempt and counts only if
    the row that names it arrives, so retried tasks do no harm.
    """
    docs = only(documents, "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, out = encoder(vocabulary, eod).encode_ordinary, None
        where, base = opened(folder)
        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.u16"
        nth = size = 0
        try:
            for batch in batches:
                if out is None:
                    out = where.open_output_stream(f"{base}/{name}")
                sizes = []
                for value in batch.column(1):
                    ids = np.array([*encode(value.as_py() or ""), eod], np.uint16)
                    out.write(ids.tobytes())
                    size += len(ids)
                    sizes.append(size)
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * n), pa.array(np.arange(nth, nth + n)), batch.column(0), pa.array(sizes, pa.int64())], names=["file", "nth", "doc_id", "size"])
                nth += n
        finally:
            if out is not None:
                out.close()

    return docs.mapInArrow(run, f"file string, nth long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, size long")


def blocks(spark: SparkSession, folder: str, names: list[str], block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The blocks of given files, whose lengths are looked up."""
    where, base = opened(folder)
    rows = [(info.base_name, info.size // 2) for info in where.get_file_info([f"{base}/{n}" for n in names])]
    return pieces_of(spark.createDataFrame(rows, "file string, tokens long"), block_tokens)


def pieces_of(files: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """file, block, start, size (tokens): equal pieces of the files, from their lengths (file, tokens) alone."""
    return files.where("tokens > 0").select("file", "tokens", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(tokens - 1) div {block_tokens}"))).alias("block")).select(
        "file", "block", (F.col("block") * block_tokens).alias("start"), F.least(F.lit(block_tokens), F.col("tokens") - F.col("block") * block_tokens).alias("size"))


def separators(pieces: DataFrame, folder: str, *, eod: int = EOD) -> DataFrame:
    """Each block's own reading: file, block, start, found, head, tail, lengths.

    ``head``: tokens before its first separator, ``tail``: after its last, both
    the whole block if it has none; ``lengths``: of the documents that lie
    between two of its separators.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = opened(folder)
        for batch in batches:
            for file, block, start, size in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                with where.open_input_file(f"{base}/{file}") as f:
                    f.seek(2 * start)
                    ids = np.frombuffer(f.read(2 * size), np.uint16)
                at = np.flatnonzero(ids == eod)
                head, tail = (int(at[0]), int(size - 1 - at[-1])) if len(at) else (size, size)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file]), pa.array([block], pa.int64()), pa.array([len(at)], pa.int64()), pa.array([head], pa.int64()), pa.array([tail], pa.int64()),
                     pa.array([(np.diff(at) - 1).tolist()], pa.list_(pa.int64()))],
                    names=["file", "block", "found", "head", "tail", "lengths"])

    return pieces.select("file", F.col("block").cast("long").alias("block"), F.col("start").cast("long").alias("start"), F.col("size").cast("long").alias("size")).mapInArrow(
        run, "file string, block long, found long, head long, tail long, lengths array<long>")


def stitch(read: DataFrame) -> DataFrame:
    """file, nth, n_tokens of every document, from the blocks' readings; tokens after a file's last separator are one as well.

    A running sum of separators numbers the documents; the tokens that a
    document has in earlier blocks are a running sum of tails since the last
    block that had a separator. Both run over a file's blocks, of which a file
    has one a million tokens.
    """
    run = Window.partitionBy("file").orderBy("block")
    before = run.rowsBetween(Window.unboundedPreceding, -1)
    group = Window.partitionBy("file", "since").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        read.withColumn("nth", F.coalesce(F.sum("found").over(before), F.lit(0)))
        .withColumn("since", F.coalesce(F.sum((F.col("found") > 0).cast("int")).over(before), F.lit(0)))
    )
    # what came before: the tail of the block that opened the stretch, and the whole blocks after it
    openers = placed.where("found > 0").select("file", (F.col("since") + 1).alias("since"), F.col("tail").alias("opened"))
    full = placed.join(openers, ["file", "since"], "left").withColumn(
        "carried", F.coalesce("opened", F.lit(0)) + F.coalesce(F.sum(F.when(F.col("found") == 0, F.col("head")).otherwise(0)).over(group), F.lit(0)))
    # what a file ends with, if no separator closes it
    ends = full.groupBy("file").agg(F.max_by(F.struct(F.when(F.col("found") > 0, F.col("tail")).otherwise(F.col("carried") + F.col("head")).alias("n_tokens"), (F.col("nth") + F.col("found")).alias("nth")), "block").alias("x"))
    ends = ends.where("x.n_tokens > 0").select("file", "x.nth", "x.n_tokens")
    closed = full.where("found > 0").select(
        "file", F.posexplode(F.concat(F.array(F.col("carried") + F.col("head")), F.col("lengths"))).alias("k", "n_tokens"), "nth",
    ).select("file", (F.col("nth") + F.col("k")).alias("nth"), "n_tokens")
    return closed.unionByName(ends)


def token_counts(documents: DataFrame, *, vocabulary: str = VOCABULARY, eod: int = EOD, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """doc_id, n_tokens of every document by way of flat token files.

    Null text counts as empty: 0 tokens. Rows that repeat are counted each. An
    empty table gives no rows. Files lie in the shared folder while this runs.
    """
    spark = documents.sparkSession
    ship(spark)
    folder = f"{shared_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    ranks(vocabulary, eod)  # refused here rather than in a task
    where, base = opened(folder)
    where.create_dir(base, recursive=True)
    try:
        placed = cut(write_tokens(documents, folder, vocabulary=vocabulary, eod=eod))
        pieces = pieces_of(placed.groupBy("file").agg(F.max("size").alias("tokens")), block_tokens)
        width = max(1, min(2 * placed.rdd.getNumPartitions(), 2000))
        counted = cut(stitch(separators(pieces.repartition(width, "file", "block"), folder, eod=eod)))
    finally:
        where.delete_dir(base)
    return placed.select("file", "nth", "doc_id").join(counted, ["file", "nth"]).select("doc_id", "n_tokens")
