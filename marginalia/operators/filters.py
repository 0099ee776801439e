"""Structured filters on chunk metadata, compiled to one Column."""

from __future__ import annotations

import json
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Metadata that generic equality can name.
FIELDS = ("path", "note_title", "heading_path", "tags", "links", "tasks", "mtime")


def path_prefix(prefix: str) -> Column:
    """On the bare column, so that it reaches the Parquet scan; paths are never null."""
    return F.startswith(F.col("path"), F.lit(str(prefix)))


def has_tags(wanted: list[str]) -> Column:
    if isinstance(wanted, str):
        raise ValueError("tags takes a list of tags, not a string")
    if not wanted:
        return F.lit(True)
    return F.size(F.array_except(F.array(*map(F.lit, wanted)), F.coalesce("tags", F.array().cast("array<string>")))) == 0


def in_dates(start: str | None = None, end: str | None = None) -> Column:
    """The first of due, deadline, start and created that isn't empty, between the bounds as text, both included."""
    first = F.coalesce(*[F.nullif(F.element_at("derived_fields", F.lit(f"{k}_date")), F.lit("")) for k in ("due", "deadline", "start", "created")])
    out = first.isNotNull()
    if start:
        out = out & (first >= F.lit(str(start)))
    if end:
        out = out & (first <= F.lit(str(end)))
    return F.coalesce(out, F.lit(False))


def json_equals(column: str, key: str, value: Any) -> Column:
    """Whether the top-level ``key`` of a JSON object equals ``value`` as Python compares: True == 1 == 1.0, None is missing.

    The type of the stored value guards the cast: '1' isn't 1.
    """
    path = "$[" + json.dumps(key) + "]"
    at = F.try_variant_get(F.try_parse_json(column), path, "variant")
    kind = F.schema_of_variant(at)
    if value is None:
        return at.isNull() | (kind == "VOID")
    if isinstance(value, bool | int | float):
        number = F.when(kind == "BOOLEAN", F.try_variant_get(F.try_parse_json(column), path, "boolean").cast("double")).when(
            F.rlike(kind, F.lit("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")), F.try_variant_get(F.try_parse_json(column), path, "double"))
        return F.coalesce(number == float(value), F.lit(False))
    if isinstance(value, str):
        return F.coalesce((kind == "STRING") & (F.try_variant_get(F.try_parse_json(column), path, "string") == value), F.lit(False))
    same = F.to_json(F.try_parse_json(F.lit(json.dumps(value, sort_keys=True))))
    return F.coalesce(F.rlike(kind, F.lit("^(ARRAY|OBJECT)")) & (F.to_json(at) == same), F.lit(False))


def equals(key: str, value: Any) -> Column:
    """The metadata field or the derived field of that name equals ``value``; None matches a missing one."""
    derived = F.element_at("derived_fields", F.lit(key)).eqNullSafe(F.lit(value if value is None or isinstance(value, str) else None)) if value is None or isinstance(value, str) else F.lit(False)
    if key not in FIELDS:
        own = F.lit(value is None)
    elif isinstance(value, list):
        own = F.col(key).eqNullSafe(F.array(*map(F.lit, value)).cast("array<string>")) if key in ("tags", "links", "tasks") else F.lit(False)
    elif key in ("tags", "links", "tasks"):
        own = F.col(key).isNull() if value is None else F.lit(False)
    elif key == "mtime":
        own = F.col(key).eqNullSafe(F.lit(value).cast("double")) if value is None or isinstance(value, int | float) else F.lit(False)
    else:
        own = F.col(key).eqNullSafe(F.lit(value)) if value is None or isinstance(value, str) else F.lit(False)
    return own | derived


def compile_filters(filters: dict[str, Any] | None) -> Column:
    """All of them together; none passes everything."""
    terms: list[Column] = []
    for key, value in (filters or {}).items():
        if key == "path_prefix":
            terms.append(path_prefix(value))
        elif key == "tags":
            terms.append(has_tags(value))
        elif key == "date_range":
            terms.append(in_dates(value.get("start"), value.get("end")))
        elif key == "frontmatter_contains":
            terms += [json_equals("frontmatter", k, v) for k, v in value.items()]
        else:
            terms.append(equals(key, value))
    return reduce(lambda a, b: a & b, terms, F.lit(True))
