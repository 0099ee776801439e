"""Contiguous shards of equal bytes from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.common import filled, only
from marginalia.session import cut

OVERHEAD = 16


def shard(documents: DataFrame, n_shards: int = 40, *, overhead: int = OVERHEAD) -> DataFrame:
    """Shard and slot of every document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Documents stand in one fixed order: md5 of the id, then id, size, checksum.
    Each of the 65,536 leading md5 values is a partition of that order. Its
    total of bytes and of rows gives, by a running sum over those totals alone,
    where it starts; a running sum inside it then gives each document's first
    byte. The shard is the n-th of the whole in which the document's middle
    byte falls, so shards are contiguous and differ from an equal share by less
    than one document at each end. Only ids, sizes and checksums are shuffled.

    Null text counts as empty (size ``overhead``, checksum 0), a null id as the
    empty id; rows that repeat get slots of their own; no rows give no rows.
    """
    text = filled(F.col("text"))
    docs = cut(only(documents, "doc_id", "text").select(
        "doc_id", (F.octet_length(text) + overhead).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.md5(filled(F.col("doc_id").cast("string")).cast("binary")).alias("place"),
    ).withColumn("bucket", F.conv(F.substring("place", 1, 4), 16, 10).cast("int")))
    earlier = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(0))
    heads = docs.groupBy("bucket").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).select(
        "bucket", F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("byte_head"),
        F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("row_head"), F.sum("bytes").over(whole).alias("total"))
    inside = Window.partitionBy("bucket").orderBy("place", "doc_id", "size", "text_crc32")
    placed = cut(
        docs.withColumn("low", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        .withColumn("nth", F.row_number().over(inside) - 1)
        .join(F.broadcast(heads), "bucket")  # at most 65,536 rows of four numbers
        .select("doc_id", "size", "text_crc32", (F.col("nth") + F.col("row_head")).alias("nth"),
                F.expr(f"cast(least({n_shards - 1}, ((2 * (low + byte_head) + size) * {n_shards}) div (2 * total)) as int)").alias("shard")))
    starts = placed.groupBy("shard").agg(F.min("nth").alias("start"))
    return placed.join(F.broadcast(starts), "shard").select(  # n_shards rows
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("nth") - F.col("start")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))
