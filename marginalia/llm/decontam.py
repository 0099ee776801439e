"""Benchmark decontamination with an Aho-Corasick automaton.

Texts are normalised to lower-case words (digits, a-z, everything beyond ASCII)
with one space around each. Every window of ten words of a benchmark item, or
the whole item if it has fewer, is a pattern with its spaces; one automaton
holds them all and reads each document once. Strings hold UTF-8 bytes, one
byte a character, so that lower-casing and splitting run at C speed.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import ASCII_LOWER, ASCII_UPPER, let, only
from marginalia.session import ship

WINDOW = 10
#: Bytes of normalised benchmark text in one automaton (about 60 times that in memory, at worst).
BLOCK_BYTES = 1_000_000
#: Words of an item beyond which it's cut into parts that overlap, so that one long item makes no larger block.
PART_WORDS = 20_000
_WORD = frozenset([*b"0123456789abcdefghijklmnopqrstuvwxyz", *range(128, 256)])
_TABLE = bytes(c if c in _WORD else 32 for c in range(256))


def normal(text: str | None) -> str:
    """' w1 w2 ... ' in UTF-8 bytes as latin-1, or ' ' without words."""
    if text is None:
        return " "
    joined = b" ".join(text.encode("utf-8", "surrogatepass").lower().translate(_TABLE).split())
    return (b" " + joined + b" ").decode("latin-1") if joined else " "


def windows(text: str | None, n: int = WINDOW) -> set[str]:
    if (flat := normal(text)) == " ":
        return set()
    found = flat[1:-1].split(" ")  # not split(): it takes some bytes beyond ASCII for blanks
    return {" " + " ".join(found[i : i + n]) + " " for i in range(max(1, len(found) - n + 1))}


def automaton(items: Iterable[tuple[str, str | None]], n: int = WINDOW) -> ahocorasick.Automaton | None:
    """Patterns to (length, ids of the items that have it); None if no item has a word."""
    owners: dict[str, set[str]] = {}
    for item, text in items:
        for w in windows(text, n):
            owners.setdefault(w, set()).add(item)
    if not owners:
        return None
    made = ahocorasick.Automaton()
    for w, ids in owners.items():
        made.add_word(w, (len(w), tuple(ids)))
    made.make_automaton()
    return made


def scan(made: ahocorasick.Automaton | None, text: str | None) -> tuple[str, list[tuple[int, int]], set[str]]:
    """Normal text, merged hit ranges in it (from a space to a space), items found."""
    flat = normal(text)
    hits: list[list[int]] = []
    items: set[str] = set()
    if made is not None:
        for end, (length, ids) in made.iter(flat):  # by end; starts may go back
            start = end - length + 1
            items.update(ids)
            while hits and start < hits[-1][1]:  # a shared space doesn't join two windows
                start = min(start, hits.pop()[0])
            hits.append([start, end])
    return flat, [(a, b) for a, b in hits], items


def original(text: str, flat: str, hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Hit ranges as code points of the text itself: start, end (exclusive)."""
    spans = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]
    out = []
    for a, b in hits:
        first = flat.count(" ", 0, a + 1) - 1
        out.append((spans[first][0], spans[first + flat.count(" ", a + 1, b + 1) - 1][1]))
    return out


def matches(documents: DataFrame, benchmark: DataFrame, *, n: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row a document: doc_id, n_words, hits (code points of the text), words (word ranges), items.

    The benchmark is a query set: its size is measured, and beyond
    ``block_bytes`` it's cut into as many blocks by hash, each with an automaton
    of its own that reads all documents; a document's rows are then united by id
    and text hash. Null text has no words; a null item id stands as the empty
    string; items that share an id are one item; an empty benchmark finds
    nothing. Document rows that repeat stay repeated.
    """
    spark = documents.sparkSession
    ship(spark)
    docs = only(documents, "doc_id", "text").withColumn("text_hash", F.xxhash64("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, text_hash long, n_words long, hits array<struct<start:long,end:long>>, words array<struct<first:long,end:long>>, items array<string>"
    found = None
    held = _blocks(benchmark, block_bytes, n)
    for k, own in enumerate(held):
        part = docs.mapInArrow(_scanner(own, n), schema).withColumn("block", F.lit(k))
        found = part if found is None else found.unionByName(part)
    if len(held) > 1:
        found = found.groupBy("doc_id", "text_hash", "n_words").agg(
            F.sort_array(F.flatten(F.collect_set("hits"))).alias("hits"), F.sort_array(F.flatten(F.collect_set("words"))).alias("words"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"), F.count_if(F.col("block") == 0).alias("times"),
        ).select("doc_id", "n_words", _union("hits", "start").alias("hits"), _union("words", "first").alias("words"), "items",
                 F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int"))))
    return found.select("doc_id", "n_words", "hits", "words", "items")


def _union(name: str, first: str):
    """Overlapping ranges of a sorted array as one."""
    return F.expr(f"""aggregate({name}, cast(array() as array<struct<{first}:bigint,end:bigint>>), (acc, x) ->
        if(size(acc) > 0 and x.{first} < element_at(acc, -1).end,
           concat(slice(acc, 1, size(acc) - 1), array(named_struct('{first}', element_at(acc, -1).{first}, 'end', greatest(element_at(acc, -1).end, x.end)))),
           concat(acc, array(named_struct('{first}', x.{first}, 'end', x.end)))))""")


_BUILT: dict[int, ahocorasick.Automaton | None] = {}


def _blocks(benchmark: DataFrame, block_bytes: int, n: int = WINDOW) -> list:
    """Broadcasts of (id, text), each of about ``block_bytes`` of text at most; the size is measured first.

    Long items go in parts that share n - 1 words: each window lies in one of them.
    """
    items = only(benchmark, "item_id", "text").select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    words = F.array_remove(F.split(F.translate(F.coalesce("text", F.lit("")), ASCII_UPPER, ASCII_LOWER), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")
    parts = let(words, lambda w: F.when(F.size(w) > PART_WORDS, F.transform(
        F.sequence(F.lit(0), F.size(w) - n, F.lit(PART_WORDS)), lambda i: F.array_join(F.slice(w, i + 1, PART_WORDS + n - 1), " "))).otherwise(F.array("text")))
    items = items.select("item", F.explode(parts).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // block_bytes) or 1
    parts = [items if blocks == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k) for k in range(blocks)]
    return [benchmark.sparkSession.sparkContext.broadcast([(r.item, r.text) for r in p.collect()]) for p in parts]


def _built(held, n: int) -> ahocorasick.Automaton | None:
    key = hash((n, *held.value))
    if key not in _BUILT:  # once for each Python worker
        _BUILT.clear()
        _BUILT[key] = automaton(held.value, n)
    return _BUILT[key]


def _scanner(held, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = _built(held, n)
        kinds = [pa.list_(pa.struct([(a, pa.int64()), ("end", pa.int64())])) for a in ("start", "first")]
        for batch in batches:
            n_words, spans, ranges, items = [], [], [], []
            for value in batch.column(1):
                text = value.as_py()
                flat, hits, found = scan(made, text)
                n_words.append(flat.count(" ") - 1)
                spans.append([{"start": a, "end": b} for a, b in original(text, flat, hits)] if hits else [])
                firsts = [flat.count(" ", 0, a + 1) - 1 for a, _ in hits]
                ranges.append([{"first": f, "end": f + flat.count(" ", a + 1, b + 1)} for f, (a, b) in zip(firsts, hits, strict=True)])
                items.append(sorted(found))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(n_words, pa.int64()), pa.array(spans, kinds[0]), pa.array(ranges, kinds[1]), pa.array(items, pa.list_(pa.string()))],
                names=["doc_id", "text_hash", "n_words", "hits", "words", "items"])

    return run


def clean(documents: DataFrame, benchmark: DataFrame, *, n: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows without any hit, all columns: a filter where the rows lie, one after the other for each block of the benchmark."""
    ship(documents.sparkSession)
    out, at = documents, documents.columns.index("text")
    for held in _blocks(benchmark, block_bytes, n):
        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            made = _built(held, n)
            for batch in batches:
                yield batch.filter(pa.array([not scan(made, t.as_py())[1] for t in batch.column(at)], pa.bool_()))

        out = out.mapInArrow(run, documents.schema)
    return out
