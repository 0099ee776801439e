import hashlib
import random
import re

import pytest

from marginalia.llm import decontam, entries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(text, items, n=10):
    w = words(text)
    hit, found = set(), set()
    for item, t in items:
        own = words(t)
        for win in {tuple(own[i : i + n]) for i in range(max(1, len(own) - n + 1))} if own else ():
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i : i + len(win)]) == win:
                    hit |= set(range(i, i + len(win)))
                    found.add("" if item is None else str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


@pytest.fixture(scope="module")
def items(plain_rows):
    long = " ".join(plain_rows[5][1].split()[2:20])
    return [(1, long), (2, "river, stone"), (3, None), (4, "..."), (10, long.upper()), (None, plain_rows[7][1]), (2, "the über"), (5, "no such passage as this one stands anywhere in any text at all")]


@pytest.mark.parametrize("block", [decontam.BLOCK_BYTES, 150])
def test_against_brute_force(spark, documents, plain_rows, items, block):
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r.doc_id, r.n_words, sum(x.end - x.first for x in r["words"]), len(r["items"]), hashlib.sha256(",".join(sorted(r["items"])).encode()).hexdigest())
                  for r in decontam.matches(documents, bench, block_bytes=block).collect()), key=str)
    assert got == sorted(((d, *brute(t, items)) for d, t, *_ in plain_rows), key=str)


def test_offsets(spark):
    text = "Intro — Über, the   RIVER! flows (slow) end"
    bench = spark.createDataFrame([(1, "über? the river flows")], "item_id long, text string")
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert decontam.matches(docs, bench).first().hits == []  # Ü isn't A-Z, so it stays as it is
    bench = spark.createDataFrame([(1, "the river flows slow")], "item_id long, text string")
    (hit,) = decontam.matches(docs, bench).first().hits
    assert text[hit.start : hit.end] == "the   RIVER! flows (slow"


def test_bytes_that_look_blank(spark):
    # U+0085 and U+00A0 as second bytes of other letters must not split words
    bench = spark.createDataFrame([(1, "à à à")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x à à à y")], "doc_id long, text string")
    r = decontam.matches(docs, bench).first()
    assert (r.n_words, [(x.first, x.end) for x in r["words"]]) == (5, [(1, 4)])


def test_empty_tables(spark, documents, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.matches(documents, none).where("size(hits) > 0").count() == 0
    assert decontam.matches(empty, none).count() == 0


def test_clean_keeps_columns(spark, documents, items):
    bench = spark.createDataFrame(items[:1], "item_id long, text string")
    left = decontam.clean(documents, bench)
    assert left.columns == documents.columns
    dirty = {r.doc_id for r in decontam.matches(documents, bench).where("size(hits) > 0").collect()}
    assert dirty and not dirty & {r.doc_id for r in left.select("doc_id").collect()}
    assert entries.queries()


def test_long_items_in_parts(spark, monkeypatch):
    r = random.Random(8)
    words = [f"w{r.randint(0, 400)}" for _ in range(95)]
    items = [(1, " ".join(words)), (2, "one two"), (3, None)]
    docs = [(i, " ".join(words[a : a + 12])) for i, a in enumerate(range(0, 84, 3))] + [(100, "so one two it is"), (101, " ".join(words[:9]))]
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    plain = sorted(map(str, decontam.matches(*frames).collect()))
    monkeypatch.setattr(decontam, "PART_WORDS", 20)
    assert sorted(map(str, decontam.matches(*frames).collect())) == plain
