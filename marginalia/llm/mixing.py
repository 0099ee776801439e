"""Mixing sources to target weights by Sainte-Lague apportionment.

Words are dealt out in equal blocks. Every source has a target number of words;
a divisor method (odd divisors 1, 3, 5, ...) turns targets into whole numbers of
blocks. The method is house-monotone, so the quota of one shard is what its
blocks add to the apportionment of all shards before it: whole numbers that
never fall and that sum to the total. A source's documents, in an order that the
seed gives, are one line of blocks; each shard takes its quota of them where the
shard before it ended, from the front and round again. So the seed decides which
blocks are taken, and a document is taken whole but for the one at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.common import beside, filled, only, words
from marginalia.session import cut

REPEATS = 3
BLOCK_WORDS = 16
#: Shards that quotas are made for.
SHARDS = 40
#: Sources up to which their table (some fifty numbers a source) is broadcast.
BROADCAST_SOURCES = 20_000


def sized(documents: DataFrame, seed: int) -> DataFrame:
    """doc_id, source, size in words and the place in seeded order, without the text."""
    return only(documents, "doc_id", "source", "text").select(
        "doc_id",
        "source",
        F.size(words(F.col("text"))).cast("long").alias("size"),
        _place(seed).alias("place"),
    )


def _place(seed: int) -> Column:
    """The place in seeded order: rows are spread by id alone."""
    return F.md5(F.concat(F.lit(f"{seed}:"), filled(F.col("doc_id").cast("string"))).cast("binary"))


def targets(sizes: DataFrame, repeats: int = REPEATS) -> DataFrame:
    """One row for each source: source_size, weight, target.

    Weights are 1, 2, 3, 1, ... over the sources by code point, null last. A
    target is ``least(repeats * source_size, level * weight)`` with the one
    level at which targets sum to all words; that's where capping and resharing
    the excess by weight ends. Sources are ordered by the level at which they
    are capped, so the level follows from running sums over the source table.
    That table has one short row a source and is the only thing that is ordered
    as a whole.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    whole = Window.partitionBy(F.lit(0))
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    return (
        sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("weight", (F.row_number().over(by_name) - 1) % 3 + 1)
        .withColumn("cap", F.col("source_size") * repeats)
        .withColumn("total", F.sum("source_size").over(whole))
        .withColumn("capped_before", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("weight_left", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("left", F.col("total") - F.col("capped_before"))
        .withColumn("free", F.col("left") / F.col("weight_left") <= F.col("cap") / F.col("weight"))
        # the first source that isn't capped sets the level of all after it
        .withColumn("first", F.min(F.when(F.col("free"), F.struct((-F.col("weight_left")).alias("less"), "left"))).over(whole))
        .withColumn("share", F.col("first.left") * F.col("weight") / -F.col("first.less"))
        .select("source", "source_size", "weight",
                F.when(F.col("share").isNotNull() & (F.col("share") < F.col("cap")), F.col("share"))
                .otherwise(F.col("cap").cast("double")).alias("target"))
    )


def apportion(shares: DataFrame, seats: Column, by: str | None = None) -> DataFrame:
    """``seats`` blocks among the rows of ``shares`` (source, target) by highest quotients, for each value of ``by``.

    Rounding ``target * seats / sum`` gives each source its seats but for at
    most half the number of sources; only the quotients near that point can
    decide the rest, so only those are listed and ranked: the cost depends on
    the number of sources, not on the number of seats. Ties go to the source
    that comes first. No target, no seats.
    """
    keys = [by] if by else []
    whole = Window.partitionBy(*(keys or [F.lit(0)]))
    near = (
        shares.withColumn("sum", F.sum("target").over(whole)).withColumn("n", F.count(F.lit(1)).over(whole))
        .where(F.col("target") > 0)
        .withColumn("seats", seats)
        .withColumn("exact", F.col("target") / F.col("sum") * F.col("seats"))
        .withColumn("slack", F.ceil(F.col("target") / F.col("sum") * F.col("n") + 2))
        .withColumn("sure", F.greatest(F.lit(0), F.floor(F.col("exact") - F.col("slack"))))
    )
    ranked = (
        near.withColumn("open", F.col("seats") - F.sum("sure").over(whole))
        .select(*keys, "source", "sure", "open", "target",
                F.explode(F.sequence(F.col("sure"), F.col("sure") + 2 * F.col("slack") + 2)).alias("k"))
        .withColumn("at", F.row_number().over(whole.orderBy(
            F.desc(F.col("target") / (2 * F.col("k") + 1)), F.col("source").asc_nulls_last(), "k")))
    )
    return ranked.groupBy(*keys, "source").agg(
        (F.first("sure") + F.count(F.when(F.col("at") <= F.col("open"), 1))).cast("long").alias("quota"))


def _upto(shares: DataFrame, n_shards: int, block: int) -> DataFrame:
    """shard, source, quota: blocks of each source in this shard and all before it."""
    total = F.greatest(F.lit(1), F.round(F.col("sum") / block).cast("long"))
    each = shares.select("source", "target", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))).alias("shard"))
    return apportion(each, F.floor(total * (F.col("shard") + 1) / n_shards), by="shard")


def shard_quotas(documents: DataFrame, n_shards: int, *, block: int = BLOCK_WORDS, seed: int = 0) -> DataFrame:
    """Blocks of each source in each of ``n_shards`` shards: shard, source, quota."""
    sizes = cut(sized(documents, seed).groupBy("source").agg(F.sum("size").alias("size")))
    before = F.lag("quota").over(Window.partitionBy("source").orderBy("shard"))
    return _upto(cut(targets(sizes)), n_shards, block).withColumn("quota", F.col("quota") - F.coalesce(before, F.lit(0))).select("shard", "source", "quota")


def _beside(rows: DataFrame, plan: DataFrame, place: str = "place") -> DataFrame:
    """Rows with their source's columns of ``plan`` (by ``__of``)."""
    return beside(rows, plan, [("source", "__of")], F.col(place), limit=BROADCAST_SOURCES)


def _placed(documents: DataFrame, n_shards: int, block: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """The plan (one row a source), and every document with the plan's columns and the words before it in its source's line (low)."""
    docs = cut(sized(documents, seed).withColumn("bucket", F.conv(F.substring("place", 1, 4), 16, 10).cast("int")))
    shares = cut(targets(docs.groupBy("source").agg(F.sum("size").alias("size"))))
    quotas = _upto(shares, n_shards, block).groupBy("source").agg(F.transform(F.sort_array(F.collect_list(F.struct("shard", "quota"))), lambda x: x["quota"]).alias("upto"))  # n_shards numbers
    plan = shares.alias("s").join(quotas.alias("q"), F.col("s.source").eqNullSafe(F.col("q.source")), "left").select(
        F.col("s.source").alias("__of"), "source_size", "target", F.coalesce("upto", F.array_repeat(F.lit(0).cast("long"), n_shards)).alias("upto"))
    plan = plan.withColumn("quota", F.element_at("upto", -1)).withColumn("wanted", F.least(F.col("quota") * block, F.col("source_size") * REPEATS))
    plan = plan.withColumn("rounds", F.when(F.col("source_size") > 0, F.expr("wanted div source_size")).otherwise(F.lit(0)))
    plan = cut(plan.withColumn("rest", F.col("wanted") - F.col("rounds") * F.col("source_size")))
    run = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    heads = docs.groupBy("source", "bucket").agg(F.sum("size").alias("here")).select(
        F.col("source").alias("of2"), F.col("bucket").alias("bucket2"), F.coalesce(F.sum("here").over(run), F.lit(0)).alias("head"))
    inside = Window.partitionBy("source", "bucket").orderBy("place", "size", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = docs.withColumn("low", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(heads, F.col("source").eqNullSafe(F.col("of2")) & (F.col("bucket") == F.col("bucket2")))
    placed = _beside(placed, plan).withColumn("low", F.col("low") + F.col("head"))
    taken = F.col("rounds") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("low")))
    return plan, placed.withColumn("taken", taken.cast("long"))


def mix(documents: DataFrame, *, block: int = BLOCK_WORDS, seed: int = 0, n_shards: int = SHARDS) -> DataFrame:
    """What a mix takes of every document.

    Returns doc_id, size (words), source, source_size, target (words wanted of
    the source), quota (blocks, the sum of its quotas in all shards), taken
    (words, repeats counted), shards (those that take of it, and how many
    words). A source's words, laid out in seeded order, are read from the front,
    shard after shard, each as many blocks as its quota, round again where the
    quotas are more than one reading, at most three times. Hence a document is
    taken whole but for the one at the end, and a rerun takes the same.

    Null text has size 0; a null source is a source of its own; rows that repeat
    are documents of their own; empty input gives no rows. Only (id, source,
    size, place) is shuffled, never a text. Running sums go by 65,536 buckets of
    the seeded order, so a source that holds a third of all rows is spread over
    all of them. Only the source table is ordered as a whole.
    """
    _, placed = _placed(documents, n_shards, block, seed)
    overlap = f"greatest(0L, least(low + size + r * source_size, least(u * {block}, wanted)) - greatest(low + r * source_size, if(s = 0, 0L, least(upto[s - 1] * {block}, wanted))))"
    words_of = f"transform(upto, (u, s) -> named_struct('shard', s, 'words', aggregate(sequence(0, {REPEATS - 1}), 0L, (t, r) -> t + {overlap})))"
    return placed.select("doc_id", "size", "source", "source_size", "target", "quota", "taken", F.expr(f"filter({words_of}, x -> x.words > 0)").alias("shards"))


def mixed(documents: DataFrame, *, block: int = BLOCK_WORDS, seed: int = 0, n_shards: int = SHARDS) -> DataFrame:
    """The documents as the mix has them: each as often as it's taken, rounded.

    Columns as in ``documents``. A document without words comes once: it takes
    nothing from any target. In a source's line all documents before one place
    are read once more than those after it, so a source's place and number of
    readings decide where the rows lie, and no text is shuffled. Rows at that
    very place (one document, or rows that share its id and size) come as often
    as they are taken on average.
    """
    plan, placed = _placed(documents, n_shards, block, seed)
    placed = cut(placed.select("source", "place", "size", "rounds", "taken"))
    short = placed.where((F.col("size") > 0) & (F.col("taken") < (F.col("rounds") + 1) * F.col("size"))).groupBy("source").agg(F.min(F.struct("place", "size")).alias("at")).select(F.col("source").alias("__of"), "at")
    there = _beside(placed, short).where((F.col("place") == F.col("at.place")) & (F.col("size") == F.col("at.size"))).groupBy("source", "at").agg(
        F.round(F.sum("taken") / F.sum("size")).cast("int").alias("there"))
    ends = plan.join(there.withColumnRenamed("source", "of2"), F.col("__of").eqNullSafe(F.col("of2")), "left").select("__of", "rounds", "at", "there")
    ends = cut(ends.select("__of", F.struct("rounds", F.col("at.place").alias("place"), F.col("at.size").alias("size"), "there").alias("__mix")))
    rows = documents.withColumn("__place", _place(seed))
    size = F.size(words(F.col("text"))).cast("long")
    cut_at = F.col("__mix")
    copies = (
        F.when(~F.rlike(filled(F.col("text")), F.lit(r"[^\x20\x09-\x0D]")), F.lit(1))
        .when(cut_at["place"].isNull(), cut_at["rounds"].cast("int") + 1)  # no row is taken less than whole: all of the source's words are
        .when(F.col("__place") < cut_at["place"], cut_at["rounds"].cast("int") + 1)
        .when(F.col("__place") > cut_at["place"], cut_at["rounds"].cast("int"))
        .when(size < cut_at["size"], cut_at["rounds"].cast("int") + 1)
        .when(size == cut_at["size"], cut_at["there"]).otherwise(cut_at["rounds"].cast("int")))
    found = _beside(rows, ends, "__place").withColumn("__n", copies).where("__n > 0")
    return found.select(*[f"`{c}`" for c in documents.columns], F.explode(F.array_repeat(F.lit(True), F.col("__n"))).alias("__copy")).drop("__copy")
