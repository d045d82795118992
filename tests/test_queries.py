"""Every query with SQL gives what DuckDB gives, on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from veritrail import catalog as C
from veritrail import queries as Q

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    def cell(x):
        if x is None or (not isinstance(x, (list, str)) and pd.isna(x)):
            return None
        if isinstance(x, float):
            return round(x, 7)
        return str(x)[:10] if hasattr(x, "isoformat") and getattr(x, "hour", 0) == 0 and getattr(x, "minute", 0) == 0 else str(x)

    out = [tuple(cell(x) if not isinstance(x, (int, float)) or isinstance(x, bool) else round(float(x), 7) if x == x else None for x in r) for r in df[sorted(df.columns)].itertuples(index=False)]
    return sorted(out, key=repr)


@pytest.mark.skipif(not DATA.is_dir(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(C.SQL))
def test_same_as_sql(spark, duck, name):
    assert rows(Q.QUERIES[name](spark, str(DATA)).toPandas()) == rows(duck.execute(Q.SQL[name]).df())


@pytest.mark.skipif(not DATA.is_dir(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(set(C.QUERIES) - set(C.SQL)))
def test_runs(spark, name):
    assert Q.QUERIES[name](spark, str(DATA)).count() > 0


def test_long_urls_are_normalised_whole(spark, monkeypatch):
    pages = spark.createDataFrame([(1, "http://x/" + "a" * 70 + "/END-of_it")], "page_id long, url string")
    monkeypatch.setattr(Q, "table", lambda *_: pages)
    assert Q.QUERIES["name_normalize"](spark, "").first().norm == "http x " + "a" * 70 + " end of it"


def test_entry_works():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and "trust_by_rel_type" in e.queries()
