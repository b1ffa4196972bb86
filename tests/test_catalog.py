"""Every registered query with SQL against DuckDB on the small tables."""

import os

import duckdb
import pytest

from quillon.plans import catalog


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf_dir}/{f}')")
    return con


def canonical(rows):
    number = lambda v: None if v is None or v != v else round(float(v), 9) if not isinstance(v, str) else v
    return sorted(repr(tuple(map(number, r))) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, sf_dir, con, name):
    got = catalog.queries()[name](spark, sf_dir)
    names = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(chr(34) + n + chr(34) for n in names)} FROM ({catalog.oracle_sql()[name]})").fetchall()
    assert canonical(map(tuple, got.select(*names).collect())) == canonical(want)
