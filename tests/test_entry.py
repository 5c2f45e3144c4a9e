"""Every registered query against its SQL, and the driver contract."""

import duckdb
import pytest

import __spark_entry__
from millrace.plans import catalog, sources, texts, tools  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)].copy()
    for c in frame.columns:
        if str(frame[c].dtype).startswith("float"):
            frame[c] = frame[c].round(9)
    return sorted(map(tuple, frame.astype(object).where(frame.notna(), None).astype(str).values.tolist()))


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query_matches_sql(spark, db, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    if name not in catalog.ORACLES:
        assert len(got)
        return
    want = db.sql(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() >= 0
    assert set(catalog.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_search_has_no_shuffle(spark):
    plan = catalog.QUERIES["search_text"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Contains" in plan
