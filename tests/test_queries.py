"""Every registered query of the library against its SQL, on the smallest tables."""

import os

import duckdb
import numpy as np
import pytest

from heliodor.plans import oracle, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in sorted(os.listdir(SF)):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


def cell(v):
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    return repr(v + 0.0) if isinstance(v, float) else str(v)


def rows(columns, got):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(cell(r[k]) for k in order) for r in got)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    t = queries.QUERIES[name](spark, SF)
    got = t.collect()
    if name not in oracle.SQL:
        assert got
        return
    want = duck.execute(oracle.SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(t.columns) == sorted(columns)
    found, wanted = rows(t.columns, got), rows(columns, want.fetchall())
    assert found == wanted, [x for x in zip(found, wanted, strict=False) if x[0] != x[1]][:3]


def test_every_sql_has_a_query():
    assert set(oracle.SQL) <= set(queries.QUERIES)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
