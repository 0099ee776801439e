import random
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.operators import ftsquery, keyword, textscan
from tests.test_search import QUERIES, TEXTS

ODD = [
    "", None, "Plain ASCII_text 12.5", "end", "begin", "café NAÏVE İx ½ a²b µ Å ſ", "Çà İSTANBUL Ångström Ωσ ΟΔΟΣ Σ ΑΣ. ΑΣΑ Σ́ άΣ", "日本 x́y É", "́á̂b ́̂c a̡ͅb",
    "́", "x", "́x", "a�b \U0001d400\U00020000 \U0001f600x ", *[unicodedata.normalize("NFD", t) for t in ("Café naïve señal", "über Ångström", "çé ñ", "ΆΣ Ἀθῆναι")], "ПРИВЕТ Ёж",
]


def words(texts, packed):
    out = []
    for lo, hi, tokens in textscan.blocks(texts, packed):
        spelled = ["".join(map(chr, tokens.codes[a : a + n])) for a, n in zip(tokens.at, tokens.size, strict=True)]
        out += [spelled[a:b] for a, b in zip(tokens.first[:-1], tokens.first[1:], strict=True)]
        assert len(out) == hi and list(tokens.lengths()) == [len(x) for x in out[lo:]]
    return out


@pytest.mark.parametrize("block", [1, 60, 10**7])
def test_tokens_as_expressions_have_them(spark, monkeypatch, block):
    monkeypatch.setattr(textscan, "BLOCK", block)
    every = [chr(i) for i in range(0x110000) if not 0xD800 <= i <= 0xDFFF]
    rng = random.Random(5)
    some = [chr(i) for r in ((32, 127), (0xC0, 0x180), (0x2F0, 0x340), (0x390, 0x3CA)) for i in range(*r)]
    texts = [*ODD, *["".join(rng.choices(some, k=rng.randrange(30))) for _ in range(300)], "x".join(every[0x3000:0x3400]), " ".join(every[:0x3000])]
    if block > 100:
        texts += [" ".join(every), "a".join(every), "".join(every)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").orderBy("i")
    want = [r.t for r in df.select(T.fts_tokens(F.coalesce("text", F.lit(""))).alias("t")).collect()]
    packed = textscan.table(spark)
    for given in (pa.array(texts), pa.array(["ä", *texts])[1:]):  # also not from the start of its buffers
        got = words(given, packed)
        assert [i for i in range(len(texts)) if got[i] != want[i]] == []


def test_bytes_that_are_no_utf8(spark):
    raw = [b"a\xffb \xc3", b"\xa9c", "é".encode(), b"\xe4\xb8x\xf0\x9f", b"\xed\xa0\x80y", b"plain"]
    df = spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate(raw)], "i int, x binary").orderBy("i")
    want = [r.t for r in df.select(T.fts_tokens(F.col("x").cast("string")).alias("t")).collect()]
    assert words(pa.array(raw, pa.binary()).view(pa.string()), textscan.table(spark)) == want


@pytest.mark.parametrize("block", [1, 10**7])
def test_texts_like_their_index(spark, monkeypatch, block):
    """All of the query language, NEAR among it, over random texts too."""
    monkeypatch.setattr(textscan, "BLOCK", block)
    rng = random.Random(7)
    texts = [*TEXTS, *[" ".join(rng.choices(["one", "two", "three", "x", "plan", "Café"], k=rng.randrange(40))) for _ in range(60)]]
    df = spark.createDataFrame([(f"c{i:02}", t) for i, t in enumerate(texts)], "chunk_id string, text string").coalesce(2).cache()
    index, stats = keyword.postings(df).cache(), keyword.corpus_stats(keyword.doc_lengths(df)).cache()
    asked = [*QUERIES[::3], 'NEAR("one two" three x, 2)', "NEAR(one one, 1)", "NEAR(two one, 0) OR plan", '^"one two"', '"one two one"', "NEAR(on* two, 1) NOT cafe", "one NOT NEAR(two x, 1)"]
    for q in asked if block > 1 else ("one OR two NOT three", "NEAR(one two three, 1)"):
        try:
            ftsquery.parse(q)
        except ftsquery.FtsSyntaxError:
            continue
        want = {r.chunk_id: r.score for r in keyword.bm25(index, stats, q).collect()}
        got = {r.chunk_id: r.score for r in keyword.bm25_texts(df, q).collect()}
        assert got.keys() == want.keys(), q
        assert all(np.isclose(got[k], want[k], rtol=1e-12) for k in want), q


def test_no_expression_goes_through_the_tokens(spark, tmp_path):
    spark.createDataFrame([(1, "in the er"), (2, "er ha")], "doc_id long, text string").write.parquet(str(tmp_path / "t"))
    texts = spark.read.parquet(str(tmp_path / "t"))
    for q in ('"in the" er', "NEAR(er ha, 3)", "in the"):
        plan = keyword.bm25_texts(texts, q, "doc_id")._jdf.queryExecution().toString().lower()
        assert "mapinarrow" in plan and "regexp_extract_all" not in plan and "lambda" not in plan
