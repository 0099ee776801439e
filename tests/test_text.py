import hashlib
import re
import sqlite3
import uuid

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.operators import ftsquery

ODD = ["", " ", "a", " a  b\t\n", "x\r\ny\rz\n", "a\x0bb\x0cc\x1cd\x85e f g", "\n\n", "Über  Straße x", "\x1f q \x1e", "café NAÏVE İx", "a_b-c.d'e ½ a²b", "ПРИВЕТ Ωμ", "x y"]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(list(enumerate(ODD)), "i int, t string")


def column(df, expr):
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def test_like_python(odd):
    t = F.col("t")
    assert column(odd, T.ws_tokens(t)) == [x.split() for x in ODD]
    assert column(odd, T.lines(t)) == [x.splitlines() for x in ODD]
    assert column(odd, T.strip(t)) == [x.strip() for x in ODD]
    assert column(odd, T.normalize_query(t))[3] == "a b"
    assert column(odd, T.content_hash(t)) == [hashlib.sha256(x.encode()).hexdigest() for x in ODD]
    assert column(odd, T.uuid5_url(t)) == [str(uuid.uuid5(uuid.NAMESPACE_URL, x)) for x in ODD]
    assert column(odd, T.universal_newlines(t)) == [re.sub("\r\n?", "\n", x) for x in ODD]


def sqlite_tokens(text):
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table t using fts5(x)")
    db.execute("create virtual table v using fts5vocab(t, instance)")
    db.execute("insert into t values (?)", (text,))
    return [r[0] for r in db.execute("select term from v order by offset")]


def test_tokens_like_sqlite(odd):
    want = [sqlite_tokens(x) for x in ODD]
    assert column(odd, T.fts_tokens(F.col("t"))) == want
    assert [ftsquery.tokens(x) for x in ODD] == want


@settings(max_examples=60, deadline=None)
@given(st.text(st.characters(max_codepoint=0x2AF, exclude_categories=["Cs"]), max_size=30))
def test_query_tokens_like_sqlite(text):
    text = text.replace("\0", "")
    assert ftsquery.tokens(text) == sqlite_tokens(text)


def test_redact(spark):
    df = spark.createDataFrame([("call 555 now",)], "t string")
    assert df.select(T.redact(F.col("t"), ["[0-9]+", "now"])).first()[0] == "call [redacted] [redacted]"


def test_spaces_and_lines_as_one_pattern_has_them(spark):
    every = "".join(f"a{chr(i)}b" for i in [*range(1, 0x300), *range(0x1670, 0x1690), 0x180E, *range(0x1FF0, 0x2070), 0x3000, 0xFEFF])
    texts = [every, every[::-1], *T.SPACES, "x" + T.SPACES, T.SPACES + "y", T.SPACES, "", None, "a b\tc", "a\nb\n", "\n", "a\r\nb\rc\x0bd", " é x "]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    x = F.col("text")
    parts = F.split(x, T.LINE_END, -1)
    rows = df.select(
        T.strip(x).eqNullSafe(F.regexp_replace(x, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")).alias("strip"), T.ws_tokens(x).eqNullSafe(F.array_remove(F.split(x, T.SPACE), "")).alias("words"),
        T.lines(x).eqNullSafe(F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)).alias("lines")).collect()
    assert all(r.strip and r.words and r.lines for r in rows), rows


def test_no_pattern_looks_for_the_ends_of_a_text(spark):
    assert "regexp_replace" not in T.strip(F.col("text"))._jc.toString()
