import random

import pytest
import xxhash
from pyspark.sql import functions as F

from marginalia.llm import simhash


def fingerprint(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({9: 32, 10: 32, 11: 32, 12: 32, 13: 32}).split(" ")
    w = [x for x in w if x]
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def groups(ids, fps):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in root:
        for b in root:
            if a < b and bin(a ^ b).count("1") <= 4:
                root[find(a)] = find(b)
    least = {}
    for d, f in zip(ids, fps, strict=True):
        if d is not None:
            least[find(f)] = min(least.get(find(f), d), d)
    return [(d, f"{f:016x}", least.get(find(f))) for d, f in zip(ids, fps, strict=True)]


def test_against_brute_force(documents, plain_rows):
    want = groups([r[0] for r in plain_rows], [fingerprint(r[1]) for r in plain_rows])
    got = [tuple(r) for r in simhash.near_duplicates(documents).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("plan", [simhash.NARROW, simhash.WIDE])
@pytest.mark.parametrize("hot", [simhash.HOT, 3])
def test_links(spark, plan, hot):
    r = random.Random(5)
    seeds = [r.getrandbits(64) for _ in range(12)]
    fps = set(seeds)
    for s in seeds:
        for _ in range(25):
            x = s
            for b in r.sample(range(64), r.randint(1, 6)):
                x ^= 1 << b
            fps.add(x)
    fps |= {seeds[0] ^ b for b in range(64)}  # many that share their upper segments
    want = {tuple(sorted((signed(a), signed(b)))) for a in fps for b in fps if a < b and bin(a ^ b).count("1") <= 4}
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    got = [tuple(x) for x in simhash.links(df, plan, hot=hot).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100 + i, 200 - i) for i in range(10)] + [(1000, 1000 + i) for i in range(1, 30)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(61))
    assert all(got[100 + i] == got[200 - i] for i in range(10))
    assert all(got[1000 + i] == 1000 for i in range(30))


def test_empty_and_keep_one(documents, empty):
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.keep_one(documents)
    assert kept.columns == documents.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    firsts = {r.component_id for r in simhash.near_duplicates(documents).select(F.col("component_id")).collect()}
    assert len(ids) == len(set(ids)) and set(ids) == firsts


def test_keep_one_of_each_group_where_ids_repeat(spark):
    r = random.Random(8)
    text = {k: " ".join(f"{k}{r.randint(0, 10**6)}" for _ in range(60)) for k in "abcdefg"}
    rows = [(3, "a"), (5, "b"), (5, "a"), (None, "c"), (None, "d"), (None, "a"), (7, "e"), (7, "f"), (7, "f"), (9, "f"), (11, "g"), (12, "g"), (None, "g")]
    docs = spark.createDataFrame([(d, text[k], k) for d, k in rows], "doc_id long, text string, k string").repartition(3)
    kept = simhash.keep_one(docs).collect()
    assert sorted((str(x.doc_id), x.k) for x in kept) == [("11", "g"), ("3", "a"), ("5", "b"), ("7", "e"), ("7", "f"), ("None", "c"), ("None", "d")]
    assert all(x.text == text[x.k] for x in kept)


def test_hot_keys_are_joined_where_they_lie(spark):
    from marginalia.llm.common import hot_join

    rows = spark.createDataFrame([(1, i) for i in range(500)] + [(k, k) for k in range(2, 300)], "k long, i long")
    table = spark.createDataFrame([(k, f"v{k}") for k in range(0, 280)], "k long, v string")
    for share in (2, 10, 100_000):
        got = sorted((r.k, r.i, r.v) for r in hot_join(rows, table, "k", share).collect())
        assert got == sorted([(1, i, "v1") for i in range(500)] + [(k, k, f"v{k}") for k in range(2, 280)])
