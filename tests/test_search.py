import sqlite3

import pytest
from pyspark.sql import functions as F

from marginalia.operators import filters, ftsquery, fusion, keyword, vector

TEXTS = [
    "one two three", "one two", "two three one", "one", "three two one two", "plan planning planned", "plan plan the", "Café naïve", "a_b one", "the the the", "", "four one x x x two", "near one x x x x x x x x x x two", "the plan of one",
]
QUERIES = [
    "one", "one two", '"one two"', "one + two", "plan*", "^one", "one ^two", "one OR two", "one NOT two", "one AND two", "one NOT two three", "one OR two three", "one OR two NOT three", "one NOT two NOT three",
    "(one OR two) AND three", "NEAR(one two)", "NEAR(one two, 3)", "NEAR(one two three, 1)", '"one tw" *', "text:one", "text : one", "{text chunk_id}: one", "- chunk_id : one", "chunk_id:one", "a_b", "cafe", "café", "plan plan",
    "plan OR plan", '"?!"', '"" one', "Or", "NEAR one", '"one two" + three', "pla*ning", "the", "one OR (two AND three)", "ONE Two", "'x'", "zzz", "text:(one OR two)",
]
BAD = ["what?", "don't", "12.5", "a,b", "(a", '"', "foo-bar", "system: x", "AND", "NOT x", "one AND", "(one OR two) three", "three (one)", "()", ";", "near(", "NEAR(one two, x)", "one NOT"]


@pytest.fixture(scope="module")
def lite():
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table f using fts5(chunk_id unindexed, text)")
    db.executemany("insert into f(chunk_id, text) values (?, ?)", [(f"c{i}", t) for i, t in enumerate(TEXTS)])
    return db


@pytest.fixture(scope="module")
def index(spark):
    df = spark.createDataFrame([(f"c{i}", t) for i, t in enumerate(TEXTS)], "chunk_id string, text string")
    return keyword.postings(df).cache(), keyword.corpus_stats(keyword.doc_lengths(df)).cache()


def lite_rows(db, q):
    return {r[0]: -r[1] for r in db.execute("select chunk_id, bm25(f) from f where f match ?", (q,))}


@pytest.mark.parametrize("q", QUERIES)
def test_like_sqlite(lite, index, q):
    try:
        want = lite_rows(lite, q)
    except sqlite3.OperationalError:
        with pytest.raises(ftsquery.FtsSyntaxError):
            ftsquery.parse(q)
        return
    got = {r.chunk_id: r.score for r in keyword.bm25(*index, q).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


@pytest.mark.parametrize("q", BAD)
def test_errors_like_sqlite(lite, q):
    with pytest.raises(sqlite3.OperationalError):
        lite_rows(lite, q)
    with pytest.raises(ftsquery.FtsSyntaxError):
        ftsquery.parse(q)


def test_plain_words(index):
    got = {r.chunk_id for r in keyword.bm25(*index, "one, (two)?", syntax="plain").collect()}
    assert got == {"c0", "c1", "c2", "c4", "c11", "c12"}


META = [
    ("c1", "p/a.md", ["x", "y"], {"due_date": "2026-02-24", "status": "todo"}, '{"n": 1, "s": "1", "b": true, "l": [1, {"k": 2}], "z": null, "f": 2.5, "we ird.k": "v"}'),
    ("c2", "p/b.md", ["x"], {"due_date": "", "start_date": "2026-02-28 10:00", "status": "done"}, "{}"), ("c3", "q/c.md", [], {"due_date": "2026-03-10"}, '{"n": 2}'), ("c4", "q/d.md", None, {}, "{}"),
]
CASES = [
    ({}, "c1 c2 c3 c4"), ({"path_prefix": "p/"}, "c1 c2"), ({"tags": ["x"]}, "c1 c2"), ({"tags": ["x", "y"]}, "c1"), ({"tags": []}, "c1 c2 c3 c4"), ({"date_range": {"start": "2026-02-01", "end": "2026-02-28"}}, "c1"),
    ({"date_range": {"start": "2026-02-25"}}, "c2 c3"), ({"date_range": {}}, "c1 c2 c3"), ({"date_range": {"start": "", "end": "2026-02-24"}}, "c1"), ({"status": "todo"}, "c1"), ({"status": None}, "c1 c2 c3 c4"), ({"nothing": None}, "c1 c2 c3 c4"),
    ({"nothing": "x"}, ""), ({"path": "q/c.md"}, "c3"), ({"tags": ["x"], "status": "done"}, "c2"), ({"frontmatter_contains": {"n": 1}}, "c1"), ({"frontmatter_contains": {"n": True}}, "c1"), ({"frontmatter_contains": {"n": 1.0}}, "c1"),
    ({"frontmatter_contains": {"s": 1}}, ""), ({"frontmatter_contains": {"s": "1"}}, "c1"), ({"frontmatter_contains": {"b": 1}}, "c1"), ({"frontmatter_contains": {"b": True}}, "c1"), ({"frontmatter_contains": {"l": [1, {"k": 2}]}}, "c1"),
    ({"frontmatter_contains": {"z": None}}, "c1 c2 c3 c4"), ({"frontmatter_contains": {"n": None}}, "c2 c4"), ({"frontmatter_contains": {"f": 2.5}}, "c1"), ({"frontmatter_contains": {"we ird.k": "v"}}, "c1"), ({"mtime": 1.0}, "c1 c2 c3 c4"),
]


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [(i, c, p, "t", "root", t, ["l"], [], d, f, 1.0, f"one {c}") for i, (c, p, t, d, f) in enumerate(META)]
    return spark.createDataFrame(rows, "seq long, chunk_id string, path string, note_title string, heading_path string, tags array<string>, links array<string>, tasks array<string>, derived_fields map<string,string>, frontmatter string, mtime double, text string").cache()


@pytest.mark.parametrize(("given", "want"), CASES)
def test_filters(chunks, given, want):
    assert [r.chunk_id for r in chunks.where(filters.compile_filters(given)).orderBy("chunk_id").collect()] == want.split()


def test_tags_need_a_list():
    with pytest.raises(ValueError, match="list"):
        filters.compile_filters({"tags": "xy"})


def test_search_filters_after_the_best(chunks):
    index, stats = keyword.postings(chunks), keyword.corpus_stats(keyword.doc_lengths(chunks))
    find = lambda **k: [r.chunk_id for r in keyword.search(chunks, index, stats, "one", **k).collect()]
    assert find(limit=4) == ["c1", "c2", "c3", "c4"]
    assert find(limit=1, filters={"path": "q/d.md"}) == []
    assert find(limit=1, filters={"path": "q/d.md"}, exact_filter=True) == ["c4"]
    assert [r.chunk_id for r in keyword.search(chunks, index, stats, " * ", 2, {"tags": ["x"]}).collect()] == ["c1", "c2"]


def test_vectors(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [3.0, 3.0]), ("c", [0.0, 1.0]), ("d", [0.0, 0.0]), ("e", [2.0])], "chunk_id string, embedding array<float>")
    assert [(r.chunk_id, round(r.score, 6)) for r in vector.topk(df, [1.0, 0.0], 3, "dot").collect()] == [("b", 3.0), ("e", 2.0), ("a", 1.0)]
    assert {r.chunk_id: round(r.score, 6) for r in vector.topk(df.where("chunk_id < 'e'"), [1.0, 0.0], 4, "cosine").collect()} == {"a": 1.0, "b": 0.707107, "c": 0.0, "d": 0.0}
    with pytest.raises(Exception, match="2 dimensions"):
        vector.check_dimension(df, 2).collect()
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "query_id long, query_embedding array<float>")
    many = [{(r.query_id, r.chunk_id, r.rank) for r in vector.topk_many(df.where("chunk_id < 'd'"), q, 1, "cosine", max_queries=m).collect()} for m in (1, 10)]
    assert many[0] == many[1] == {(1, "a", 1), (2, "c", 1)}


def test_fusion(spark):
    lane = lambda rows: spark.createDataFrame(rows, "chunk_id string, score double, text string, path string, heading_path string")
    a = lane([("c1", 0.9, "t1", "p1", "h1"), ("c2", 0.8, "t2", "p2", None)])
    b = lane([("c2", 9.0, "k2", "p2", None), ("c3", 8.0, "k3", None, "h3")])
    lanes = [fusion.ranked(x, i, [F.desc("score")]) for i, x in enumerate((a, b))]
    got = fusion.best(fusion.rrf(lanes, keep=["text", "path", "heading_path"]), 10).collect()
    assert [(r.chunk_id, r.text, round(r.score, 9)) for r in got] == [("c2", "t2", round(1 / 62 + 1 / 61, 9)), ("c1", "t1", round(1 / 61, 9)), ("c3", "k3", round(1 / 62, 9))]
    ranked = spark.createDataFrame([(1, "c2", "p2", None), (2, "c3", None, "h3")], "rank int, chunk_id string, path string, heading_path string")
    assert fusion.answer_draft(ranked).first()[0] == "- p2 :: root\n- None :: h3"
    assert fusion.answer_draft(ranked.where("false")).first()[0] == fusion.NOTHING
    assert [tuple(r) for r in fusion.citations(ranked).collect()] == [("c2", "p2", "root"), ("c3", None, "h3")]


def test_combining_marks_like_sqlite(spark):
    import unicodedata

    from marginalia.functions import text as T

    texts = [unicodedata.normalize("NFD", t) for t in ("Café naïve señal", "über Ångström", "çé ñ", "́abc á́b ͠x y̧z")]
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table f using fts5(text)")
    db.execute("create virtual table v using fts5vocab(f, instance)")
    got = [r.t for r in spark.createDataFrame(list(enumerate(texts)), "i int, text string").orderBy("i").select(T.fts_tokens(F.col("text")).alias("t")).collect()]
    for i, text in enumerate(texts):
        db.execute("insert into f(rowid, text) values (?, ?)", (i + 1, text))
        want = [r[0] for r in db.execute("select term from v where doc = ? order by offset", (i + 1,))]
        assert got[i] == want, text


def test_postings_are_gathered_in_the_row(spark):
    df = spark.createDataFrame([("a", "b a b"), ("c", None), ("d", "")], "chunk_id string, text string")
    assert sorted((r.term, r.chunk_id, r.positions, r.tf, r.dl) for r in keyword.postings(df).collect()) == [("a", "a", [1], 1, 3), ("b", "a", [0, 2], 2, 3)]
    assert "Exchange" not in keyword.postings(df)._jdf.queryExecution().executedPlan().toString()
    assert [r.term for r in keyword.postings(df, only=lambda t: t == "a").collect()] == ["a"]


def test_many_queries_in_blocks(spark, monkeypatch):
    df = spark.createDataFrame([(f"c{i}", t) for i, t in enumerate(TEXTS)], "chunk_id string, text string")
    q = spark.createDataFrame([(1, "one two two"), (2, "plan the"), (3, "zzz"), (4, None)], "query_id int, text string")
    index, stats = keyword.postings(df), keyword.corpus_stats(keyword.doc_lengths(df))
    ask = lambda: sorted(map(tuple, keyword.bm25_many(index, stats, q, 3).collect()))
    whole = ask()
    want = {r.chunk_id: r.score for r in keyword.bm25(index, stats, "one OR two").collect()}
    assert len(whole) == 6 and all(abs(want[c] - s) < 1e-6 for i, c, s, _ in whole if i == 1)
    monkeypatch.setattr(keyword, "MANY_TERMS", 1)
    assert ask() == whole


def test_whole_counts_a_ruled_out_part(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, "a b"), (3, "b c"), (4, "a"), (5, "x x"), (6, "x x"), (7, "x x")], "doc_id long, text string")
    ask = lambda whole: {r.doc_id: r.score for r in keyword.bm25_texts(df, "a OR b NOT c", "doc_id", whole=whole).collect()}
    part, whole, both = ask(False), ask(True), {r.doc_id: r.score for r in keyword.bm25_texts(df, "a OR b", "doc_id").collect()}
    assert part.keys() == whole.keys() == {1, 2, 4}
    assert whole[1] == both[1] > part[1] and whole[2] == part[2] and whole[4] == part[4]


def test_texts_without_an_index_like_sqlite(spark, lite):
    df = spark.createDataFrame([(f"c{i}", t) for i, t in enumerate(TEXTS)], "chunk_id string, text string").cache()
    for q in ("one", '"one two"', "plan*", "^one", "one OR two NOT three", "NEAR(one two, 3)", '"" one', "plan OR plan", "zzz", '"?!"'):
        got, want = {r.chunk_id: r.score for r in keyword.bm25_texts(df, q).collect()}, lite_rows(lite, q)
        assert got.keys() == want.keys(), q
        assert all(abs(got[k] - want[k]) < 1e-9 for k in want), q


def test_texts_are_tokenized_once(spark, tmp_path):
    rows = [(1, "a b"), (1, "a b"), (2, None), (None, "b a a")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "t"))
    found = keyword.bm25_texts(spark.read.parquet(str(tmp_path / "t")), "a", "doc_id")
    assert sorted((r.doc_id or 0) for r in found.collect()) == [0, 1, 1]
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan") == 1 and plan.count("ReusedExchange") == 1


def test_tokens_by_kind_of_text(spark):
    from marginalia.functions import text as T

    texts = ["Plain ASCII_text 12.5", "Çà İSTANBUL \u212bngström naïve ſ Ωσ ΟΔΟΣ", "日本 x\u0301y É", "", None, "½ Ⅷ ²x"]
    want = [ftsquery.tokens(t) if t is not None else None for t in texts]
    want[2] = ["日本", "xy", "e"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").orderBy("i")
    assert [r.t for r in df.select(T.fts_tokens(F.col("text")).alias("t")).collect()] == want
    assert ftsquery.tokens("\u212b") == ["a"]


@pytest.mark.parametrize("metric", ["dot", "cosine"])
def test_many_vectors_like_one_by_one(spark, monkeypatch, metric):
    import random

    rng = random.Random(3)
    rows = [(f"v{i}", [float(rng.choice([-1, 0, 0.5, 2.25, rng.random()])) for _ in range(rng.choice([6, 6, 6, 4, 0]))] if i % 17 else None) for i in range(150)]
    rows += [("n1", [1.0, None, 1.0]), ("n2", [float("nan"), 1.0]), ("n3", [float("inf"), 1.0, 0.0]), ("z1", [0.0] * 6), (None, [1.0] * 6), ("v150", rows[1][1]), ("a", rows[1][1])]
    df = spark.createDataFrame(rows, "chunk_id string, embedding array<float>").repartition(3)
    asked = [(1, [0.5, 1.0, -1.0, 0.25, 2.0, 1.0]), (2, [1.0, 1.0]), (3, None), (4, [0.0] * 6), (5, [1.0] * 9)]
    q = spark.createDataFrame(asked, "query_id long, query_embedding array<float>")
    both = df.crossJoin(q).select("query_id", "chunk_id", vector.METRICS[metric](F.col("embedding"), F.col("query_embedding")).alias("score"))
    show = lambda d: sorted(map(str, d.select("query_id", "rank", "chunk_id", "score").collect()))
    for k in (1, 7, 400):
        want = show(keyword.rank_within(both, ["query_id"], [F.desc("score"), F.asc("chunk_id")], k))
        for cells in (1, 60, 10**6):
            monkeypatch.setattr(vector, "CELLS", cells)
            assert show(vector.topk_many(df, q, k, metric)) == want
    rounded = keyword.rank_within(both.withColumn("score", F.round("score", 1)), ["query_id"], [F.desc("score"), F.asc("chunk_id")], 5)
    assert show(vector.topk_many(df, q, 5, metric, digits=1)) == show(rounded)


def test_many_queries_over_texts(spark, monkeypatch):
    df = spark.createDataFrame([*((f"c{i:02}", t) for i, t in enumerate(TEXTS)), ("d", None), (None, "one"), ("e", "one"), ("a", "one")], "chunk_id string, text string").repartition(3)
    q = spark.createDataFrame([(1, "one two two"), (2, "plan the"), (3, "zzz"), (4, None), (5, "Café one")], "query_id int, text string")
    show = lambda d: sorted(map(str, d.select("query_id", "chunk_id", "score", "rank").collect()))
    index, stats = keyword.postings(df), keyword.corpus_stats(keyword.doc_lengths(df))
    for k in (1, 3, 50):
        want = show(keyword.bm25_many(index, stats, q, k))
        for pairs, cells, terms in ((10**6, 10**6, 10**6), (1, 10**6, 10**6), (10**6, 8, 1)):
            monkeypatch.setattr(keyword, "PAIRS", pairs)
            monkeypatch.setattr(keyword, "CELLS", cells)
            monkeypatch.setattr(keyword, "MANY_TERMS", terms)
            assert show(keyword.bm25_many_texts(df, q, k)) == want
        monkeypatch.setattr(keyword, "MANY_TERMS", 10**6)
    assert keyword.bm25_many_texts(df, q.where("query_id = 4"), 3).count() == keyword.bm25_many_texts(df.where("false"), q, 3).count() == 0
