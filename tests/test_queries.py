"""Every registered query of the engine against its SQL in DuckDB, or its rows where SQL cannot express it."""

from __future__ import annotations

import math

import duckdb
import pytest

from tickspark.plans import oracles, queries

SF = "/root/testdata/sf0.001"
SQL = oracles.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{SF}/events.parquet')")
    return con


def plain(rows):
    def value(x):
        if x is None or (isinstance(x, float) and math.isnan(x)):
            return ("", 0.0)
        if isinstance(x, (int, float)) and not isinstance(x, bool):
            return ("", float(x) + 0.0 + 1e9)
        return (str(x), 0.0)

    # what is exact (texts and whole numbers) orders the rows; rounded figures only break ties
    return [r for _, r in sorted((([str(x) for x in r if not isinstance(x, float)], tuple(value(x) for x in r)) for r in rows))]


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, duck, name):
    df = queries.queries()[name](spark, SF)
    columns = sorted(df.columns)
    rows = df.select(columns).collect()
    if name not in SQL:
        assert df.columns
        return
    found = duck.execute(SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    wanted = [tuple(r[names.index(c)] for c in columns) for r in found.fetchall()]
    a, b = plain(rows), plain(wanted)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert [v[0] for v in x] == [v[0] for v in y]
        assert [v[1] for v in x] == pytest.approx([v[1] for v in y], abs=1e-5)


def test_entry_point():
    import __spark_entry__ as entry

    assert set(queries.queries()) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql()) and set(entry.oracle_sql()) <= set(entry.queries())
