import importlib
import sys

import duckdb
import pytest

import __spark_entry__ as driver
from marginalia.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "benchmark", "events", "labels", "pages", "conversations", "nation", "region")


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return db


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(frame.itertuples(index=False, name=None), key=str)


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_like_sql(spark, duck, name):
    got, want = catalogue.QUERIES[name](spark, SF).toPandas(), duck.execute(catalogue.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert driver.entry(spark).count() == 10
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_without_the_corpus_operators(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("marginalia.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "marginalia.llm", None)
    try:
        alone = importlib.reload(driver)
        assert set(alone.queries()) == set(catalogue.QUERIES)
    finally:
        monkeypatch.undo()
        importlib.reload(driver)
