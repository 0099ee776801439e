"""From note texts to parsed notes: frontmatter, links, tags, headings, tasks."""

from __future__ import annotations

import datetime
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.session import ship

LINK = r"\[\[([^|\]]+)(?:[|][^\]]+)?]]"
TAG = r"(?U)(?<![\p{L}\p{N}_])#([0-9A-Z_a-z/-]+)"
HEADING = r"(?mdU)^#{1,6}\s+(.*)$"
TASK = r"(?mdU)^\s*[*-]\s+\[[xX ]\]\s+(.*)$"
DATES = ("due", "deadline", "start", "created")
OPEN, CLOSE = "---\n", "\n---\n"


def links(body: Column) -> Column:
    """Targets of wiki links in order, repeats kept."""
    return F.regexp_extract_all(body, F.lit(LINK), 1)


def tags(body: Column) -> Column:
    """Distinct tags, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(body, F.lit(TAG), 1)))


def headings(body: Column) -> Column:
    return F.regexp_extract_all(body, F.lit(HEADING), 1)


def tasks(body: Column) -> Column:
    """Texts of check-list items; whether one is done isn't kept."""
    return F.regexp_extract_all(body, F.lit(TASK), 1)


def _close(text: Column) -> Column:
    return F.locate(CLOSE, text, len(OPEN) + 1)


def has_frontmatter(text: Column) -> Column:
    """An opening rule at the very start and a closing one after at least an empty line."""
    return F.startswith(text, F.lit(OPEN)) & (_close(text) > 0)


def frontmatter_text(text: Column) -> Column:
    """The block between the rules, null without one."""
    return F.when(has_frontmatter(text), F.substring(text, F.lit(len(OPEN) + 1), _close(text) - len(OPEN) - 1))


def body_text(text: Column) -> Column:
    """What follows the block; the whole text without one."""
    return F.when(has_frontmatter(text), F.substring(text, _close(text) + len(CLOSE), F.length(text))).otherwise(text)


def decode_yaml(block: str | None, dates: str) -> tuple[str, str, str | None]:
    """JSON of the mapping, JSON of the derived fields, an error."""
    import yaml

    loaded = None
    if block is not None:
        try:
            loaded = yaml.safe_load(block)
        except yaml.YAMLError:
            loaded = None
    matter = loaded if isinstance(loaded, dict) else {}
    derived: dict[str, str] = {}
    for k in DATES:
        v = matter.get(k)
        is_date = isinstance(v, datetime.date) and not isinstance(v, datetime.datetime)
        if isinstance(v, str | datetime.datetime) or (is_date and dates == "iso"):
            derived[f"{k}_date"] = str(v)
    if matter.get("status") is not None:
        derived["status"] = str(matter["status"]).lower()
    derived |= {k: str(matter[k]) for k in ("project", "context") if k in matter}
    try:
        plain = json.dumps(matter, sort_keys=True, ensure_ascii=False, default=str if dates == "iso" else None)
    except (TypeError, ValueError) as e:
        return "{}", json.dumps(derived), str(e)
    return plain, json.dumps(derived), None


def frontmatter_decoder(dates: str = "iso"):
    """Arrow UDF: YAML block to struct<frontmatter, derived, error>; SQL has no YAML."""

    @F.pandas_udf("frontmatter string, derived string, error string")
    def decode(blocks: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([decode_yaml(b, dates) for b in blocks], columns=["frontmatter", "derived", "error"])

    return decode


def parse_notes(files: DataFrame, dates: str = "iso") -> DataFrame:
    """Notes of ``files`` (path, text, mtime): one row each, in their order column ``seq`` if there's one.

    note_id is the head of the content hash, so two files with the same text
    have the same id. ``dates='iso'`` makes unquoted YAML dates text;
    ``'strict'`` sends such notes to ``error``, as a JSON encoder would.
    """
    ship(files.sparkSession)
    text = F.col("text")
    kept = [c for c in ("seq",) if c in files.columns]
    named = files.select(*kept, "path", "mtime", text, T.content_hash(text).alias("content_hash"), body_text(text).alias("body"), frontmatter_decoder(dates)(frontmatter_text(text)).alias("m"))
    name = F.element_at(F.split("path", "/"), -1)
    body = F.col("body")
    return named.select(
        *kept, F.substring("content_hash", 1, 16).alias("note_id"), "path", F.regexp_replace(name, r"(?<=.)\.[^.]*$", "").alias("title"), "body",
        F.col("m.frontmatter").alias("frontmatter"), F.from_json("m.derived", "map<string,string>").alias("derived_fields"),
        tags(body).alias("tags"), links(body).alias("links"), headings(body).alias("headings"), tasks(body).alias("tasks"), "mtime", "content_hash", F.col("m.error").alias("error"))
