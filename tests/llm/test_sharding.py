import zlib

from marginalia.llm import sharding


def test_shards(documents, plain_rows):
    got = sharding.shard(documents, 5).collect()
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted((str(d), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t, *_ in plain_rows)
    total, largest = sum(r.size for r in got), max(r.size for r in got)
    for s in range(5):
        own = [r for r in got if r.shard == s]
        assert sorted(r.slot for r in own) == list(range(len(own)))
        assert abs(sum(r.size for r in own) - total / 5) <= largest
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
    again = sharding.shard(documents.repartition(2), 5).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)


def test_contiguous_and_balanced(spark):
    df = spark.createDataFrame([(i, "x" * (i % 50)) for i in range(4000)], "doc_id long, text string")
    got = sharding.shard(df, 40).collect()
    sizes = {}
    for r in got:
        sizes[r.shard] = sizes.get(r.shard, 0) + r.size
    assert len(sizes) == 40 and max(sizes.values()) - min(sizes.values()) <= 2 * (49 + 16)
    assert sorted(r.doc_id for r in got) == list(range(4000))


def test_few_and_none(spark, empty):
    assert sharding.shard(empty).count() == 0
    one = sharding.shard(spark.createDataFrame([(None, None)], "doc_id long, text string")).collect()
    assert [(r.size, r.text_crc32, r.slot) for r in one] == [(16, 0, 0)]
