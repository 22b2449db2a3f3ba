"""Every market-data query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from depthlake.plans.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


def rows(table):
    return sorted((tuple(repr(float(x)) if isinstance(x, float) else str(x) for x in r.values()) for r in table.to_pylist()))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    found = QUERIES[name](spark, DATA)
    columns = sorted(found.columns)
    table = found.select(*columns).toArrow()
    if name not in ORACLE_SQL:
        assert len(table)
        return
    with duckdb.connect() as db:
        for t in ("events",):
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
        known = db.sql(ORACLE_SQL[name]).arrow().read_all()
    assert sorted(known.column_names) == columns
    assert rows(table) == rows(known.select(columns))


def test_entry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and set(QUERIES) <= set(e.queries())
