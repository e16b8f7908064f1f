"""Every registered query of the library against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from isoframe.plans.catalogue import ORACLES, QUERIES

DATA = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
ONLY = os.environ.get("ORACLE_ONLY")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    return c


def plain(rows):
    cell = lambda x: round(x, 6) + 0.0 if isinstance(x, float) else x
    return sorted((tuple(cell(x) for x in r) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, con, name):
    if ONLY and ONLY not in name:
        pytest.skip("not chosen")
    got = QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    want = con.execute(f"select {', '.join(chr(34) + c + chr(34) for c in columns)} from ({ORACLES[name]})")
    kinds = [str(d[1]) for d in want.description]
    rows = want.fetchall()
    mine = [tuple(r) for r in got.select(*columns).collect()]
    assert mine, "no rows"
    assert plain(mine) == plain(rows)
    kind = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    spark_kinds = [kind.get(dict(got.dtypes)[c], dict(got.dtypes)[c]) for c in columns]
    assert spark_kinds == kinds


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_without_sql(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0
