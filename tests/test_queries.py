"""Every registered query of the library's own operators against its DuckDB oracle."""

import math
import os
from pathlib import Path

import duckdb
import pytest

from lakewright import queries as base

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return round(v, 6)
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([plain(r[i]) for i in order]) for r in data)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(base.oracle_sql()))
def test_oracle(spark, duck, name):
    df = base.queries()[name](spark, DATA)
    result = duck.execute(base.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(columns, result.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_cut_references(spark, duck, tmp_path):
    """A title may end within a character reference; the query reads it as its SQL does."""
    titles = ["A &quot;b&quot; &quot", "c &amp; d &amp", "e &am", "f &lt", "&copy; g &#38; h &lt;i"]
    rows = [(i, f'<html><nav><ul><li><a href="/x{i}">x</a></li></ul></nav><article><h1>{t}</h1><p>p</p></article>') for i, t in enumerate(titles)]
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    df = base.queries()["matched_elements"](spark, str(tmp_path))
    result = con.execute(base.oracle_sql()["matched_elements"])
    columns = [d[0] for d in result.description]
    assert rows_of(df, columns) == sorted(map(repr, result.fetchall()))


def rows_of(df, columns):
    return sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
