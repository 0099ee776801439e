"""What the corpus operators share: word rules, held-out folds, array helpers."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.text import let  # noqa: F401
from marginalia.session import cut

#: Separators of the plain word rule: space and U+0009 to U+000D.
BLANKS = r"[\x20\x09-\x0D]+"
ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder and its path there, for Python workers: local and mounted paths, file, hdfs, s3 and gs.

    Spark's names for S3 are told to pyarrow by its own; a scheme that it doesn't know raises.
    """
    if ":" not in uri.split("/")[0]:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", uri))


def filled(text: Column) -> Column:
    """Null counts as the empty text."""
    return F.coalesce(text, F.lit(""))


def words(text: Column) -> Column:
    """Maximal runs of characters other than blanks."""
    return F.array_remove(F.split(filled(text), BLANKS), "")


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus).cast("int")


def only(df, *names: str):
    """The columns an operator reads; whatever else a table has can't clash."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def beside(rows: DataFrame, plan: DataFrame, on: Sequence[tuple[str, str]], salt: Column, *, limit: int, parts: int = 64, how: str = "inner") -> DataFrame:
    """Rows with the columns of a small table, joined on pairs of equal columns (nulls are equal), which the table's side loses.

    The table is counted; up to ``limit`` rows it's broadcast, beyond it's
    joined, each of its rows copied to so many parts that ``salt`` spreads the
    rows over: a key that holds a third of all rows goes to as many tasks.
    """
    pairs = list(on)
    if plan.count() <= limit:
        plan = F.broadcast(plan)
    else:
        plan = plan.select("*", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("__part"))
        rows = rows.withColumn("__salt", F.pmod(F.xxhash64(salt), F.lit(parts)).cast("int"))
        pairs.append(("__salt", "__part"))
    same = F.lit(True)
    for a, b in pairs:
        same = same & rows[a].eqNullSafe(plan[b])
    out = rows.join(plan, same, how)
    for _, b in pairs:
        out = out.drop(plan[b])
    return out.drop("__salt")


def hot_join(rows: DataFrame, table: DataFrame, key: str, share: int = 1000) -> DataFrame:
    """Inner join on a key that the table has once and that a large share of the rows may have (no nulls).

    Keys that more than one in ``share`` rows have are at most as many: their
    rows of the table are broadcast, so a hot key's rows stay where they are;
    the others are joined by key. Both sides should be cheap to read again.
    """
    total = rows.count()
    hot = rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > max(1, total // share)).select(key)
    warm = cut(table.join(F.broadcast(hot), key, "left_semi"))  # at most ``share`` rows
    if warm.isEmpty():
        return rows.join(table, key)
    own = F.broadcast(warm.select(key))
    return rows.join(F.broadcast(warm), key).unionByName(rows.join(own, key, "left_anti").join(table.join(own, key, "left_anti"), key))
