"""Heading-aware chunks of overlapping token windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions import text as T

HEADING_LINE = r"(?U)^(#{1,6})\s+(.*)$"


def sections(body: Column) -> Column:
    """array<struct<heading,text>>: lines under the nearest heading before them, in order; blank ones dropped.

    Headings are found first; each section is then one slice of the row's
    lines, so the work grows with the length of a note, and nothing is shuffled.
    """

    def made(lines: Column, heads: Column) -> Column:
        starts, n = F.concat(F.array(F.lit(-1)), heads), F.size(lines)

        def one(at: Column, k: Column) -> Column:
            heading = F.when(at < 0, "root").otherwise(T.strip(F.regexp_extract(F.get(lines, at), HEADING_LINE, 2)))
            own = F.slice(lines, at + 2, F.coalesce(F.get(heads, k), n) - at - 1)
            return F.struct(heading.alias("heading"), T.strip(F.array_join(own, "\n")).alias("text"))

        return F.filter(F.transform(starts, one), lambda s: s["text"] != "")

    places = lambda lines: F.filter(F.transform(lines, lambda x, i: F.when(F.startswith(x, F.lit("#")) & F.rlike(x, F.lit(HEADING_LINE)), i)), lambda i: i.isNotNull())
    return T.let(T.lines(body), lambda lines: T.let(places(lines), lambda heads: made(lines, heads)))


def token_windows(tokens: Column, size: int, overlap: int) -> Column:
    """Windows of ``size`` tokens, one every ``max(1, size - overlap)``; no windows for size 0 or no tokens.

    The last may lie wholly within the one before it.
    """
    if size <= 0:
        return F.array().cast("array<array<string>>")
    step = max(1, size - overlap)

    def cut(t: Column) -> Column:
        return F.when(F.size(t) > 0, F.transform(F.sequence(F.lit(0), F.size(t) - 1, F.lit(step)), lambda i: F.slice(t, i + 1, size))).otherwise(F.array().cast("array<array<string>>"))

    return T.let(tokens, cut)  # else tokens would be split anew for every window


def chunk_id(note_id: Column, heading: Column, nth: Column, text: Column) -> Column:
    return T.uuid5_url(F.concat_ws(":", note_id, heading, nth.cast("string"), text))


def chunk_notes(notes: DataFrame, size: int = 500, overlap: int = 80, redact: list[str] | None = None) -> DataFrame:
    """Chunks of parsed notes; windows are numbered anew in each section. ``redact`` masks patterns first."""
    body = T.redact(F.col("body"), redact) if redact else F.col("body")
    order = [F.col("seq")] if "seq" in notes.columns else []
    each = notes.select("*", F.posexplode(sections(body)).alias("section", "s"))
    wins = each.withColumn("w", token_windows(T.ws_tokens(F.col("s.text")), size, overlap)).select("*", F.posexplode("w").alias("nth", "tokens"))
    text = F.array_join("tokens", " ")
    return wins.select(
        *order, "section", "nth", chunk_id(F.col("note_id"), F.col("s.heading"), F.col("nth"), text).alias("chunk_id"), "note_id", text.alias("text"), "path",
        F.col("title").alias("note_title"), F.col("s.heading").alias("heading_path"), "tags", "links", "tasks", "frontmatter", "derived_fields", "mtime")
