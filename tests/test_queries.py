"""Every query with SQL agrees with DuckDB on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


def shown(v):
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return str([shown(x) for x in v])
    if type(v).__name__ == "Decimal":
        return repr(round(float(v), 6))
    return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_agrees(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(tuple(map(shown, r)) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    sql = entry.oracle_sql()[name]
    names = [r[0] for r in duck.execute("DESCRIBE " + sql).fetchall()]
    rows = duck.execute(sql).fetchall()
    assert columns == sorted(names)
    order = [names.index(c) for c in columns]
    assert got == sorted(tuple(shown(r[i]) for i in order) for r in rows)


def test_full_text_of_several_blocks(spark, duck, monkeypatch):
    from engram.operators import search

    monkeypatch.setattr(search, "BLOCK", 16)
    test_agrees(spark, duck, "search_full_text")


def test_entry(spark):
    assert entry.entry(spark).count() > 0
