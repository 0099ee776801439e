import re

import pytest

from marginalia.llm import mixing


def water(sizes, repeats=3):
    """sizes: (source, words) with sources in order, null last."""
    weight = {s: i % 3 + 1 for i, (s, _) in enumerate(sizes)}
    size, out, left = dict(sizes), {}, float(sum(n for _, n in sizes))
    free = [s for s, _ in sizes]
    while free:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > repeats * size[s]]
        if not over:
            return out | {s: level * weight[s] for s in free}
        for s in over:
            out[s] = float(repeats * size[s])
            left -= repeats * size[s]
            free.remove(s)
    return out


def sainte_lague(shares, seats):
    got = {s: 0 for s, _ in shares}
    for _ in range(seats):
        s = max(shares, key=lambda x: (x[1] / (2 * got[x[0]] + 1), -[y[0] for y in shares].index(x[0])))[0]
        got[s] += 1
    return got


def ordered(rows):
    total = {}
    for _, t, _, s, _ in rows:
        total[s] = total.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    return sorted(total.items(), key=lambda x: (x[0] is None, x[0] or ""))


@pytest.mark.parametrize("sizes", [[("a", 10), ("b", 10), ("c", 10)], [("a", 1000), ("b", 1), ("c", 3), ("d", 5), (None, 2)], [("a", 5)], [("a", 0), ("b", 0)], [("a", 0), ("b", 40), ("z", 2)]])
def test_targets(spark, sizes):
    df = spark.createDataFrame(sizes, "source string, size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    want = water(sizes)
    assert got.keys() == want.keys()
    assert all(abs(got[s] - want[s]) < 1e-9 * max(1, want[s]) for s in want)


@pytest.mark.parametrize("seats", [0, 1, 7, 100, 1001])
@pytest.mark.parametrize("shares", [[("a", 10.0), ("b", 20.0), ("c", 30.0)], [("a", 1.0), ("b", 1.0), ("c", 1.0)], [("a", 90.0), *[(f"s{i}", 0.4) for i in range(20)]], [("a", 0.0), ("b", 3.0)]])
def test_apportionment(spark, seats, shares):
    from pyspark.sql import functions as F

    got = {r.source: r.quota for r in mixing.apportion(spark.createDataFrame(shares, "source string, target double"), F.lit(seats)).collect()}
    want = sainte_lague([s for s in shares if s[1] > 0], seats)
    assert {s: q for s, q in got.items() if q} == {s: q for s, q in want.items() if q}


def test_mix(documents, plain_rows):
    got = mixing.mix(documents).collect()
    sizes = ordered(plain_rows)
    want = water(sizes)
    assert sorted((str(r.doc_id), r.size) for r in got) == sorted((str(r[0]), len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))) for r in plain_rows)
    for s, n in sizes:
        own = [r for r in got if r.source == s]
        assert all(r.source_size == n and abs(r.target - want[s]) < 1e-6 and 0 <= r.taken <= 3 * r.size for r in own)
        assert abs(sum(r.taken for r in own) - want[s]) <= 2 * mixing.BLOCK_WORDS
        # whole documents but for one at the end of the reading
        assert sum(r.taken % r.size != 0 for r in own if r.size) <= 1
    again = mixing.mix(documents.repartition(5)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)


def test_shard_quotas(documents):
    one = {r.source: r.quota for r in mixing.mix(documents).select("source", "quota").distinct().collect()}
    parts = mixing.shard_quotas(documents, 4).collect()
    assert all(r.quota >= 0 for r in parts)
    assert {s: sum(r.quota for r in parts if r.source == s) for s in one} == one


def test_mixed_repeats_rows(documents, empty):
    out = mixing.mixed(documents)
    assert out.columns == documents.columns
    assert mixing.mixed(empty).count() == 0 and mixing.mix(empty).count() == 0
    counted = {}
    for r in out.select("doc_id").collect():
        counted[r.doc_id] = counted.get(r.doc_id, 0) + 1
    want = {}
    for r in mixing.mix(documents).collect():
        want[r.doc_id] = want.get(r.doc_id, 0) + (round(r.taken / r.size) if r.size else 1)
    boundary = 5
    assert sum(abs(counted.get(d, 0) - n) for d, n in want.items()) <= boundary


def test_shards_take_their_quotas(documents):
    got = mixing.mix(documents, n_shards=5).collect()
    assert all(sum(x.words for x in r.shards) == r.taken for r in got)
    quota = {(r.source, r.shard): r.quota for r in mixing.shard_quotas(documents, 5).collect()}
    words = {}
    for r in got:
        for x in r.shards:
            words[r.source, x.shard] = words.get((r.source, x.shard), 0) + x.words
    # whole blocks, but where three readings of a source end
    assert all(words.get(k, 0) in (mixing.BLOCK_WORDS * q, max(0, mixing.BLOCK_WORDS * q - mixing.BLOCK_WORDS + 1)) or words.get(k, 0) <= mixing.BLOCK_WORDS * q for k, q in quota.items())
    total = {s: sum(q for (t, _), q in quota.items() if t == s) for s, _ in quota}
    for r in got:
        assert sum(n for (s, _), n in words.items() if s == r.source) == min(mixing.BLOCK_WORDS * total[r.source], 3 * r.source_size)


def test_many_sources_are_joined_in_parts(documents, monkeypatch):
    plain = sorted(map(str, mixing.mix(documents).collect())), sorted(map(str, mixing.mixed(documents).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert (sorted(map(str, mixing.mix(documents).collect())), sorted(map(str, mixing.mixed(documents).collect()))) == plain
