"""The driver contract and a few registered queries against their oracle at the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as entry
from loftline.plans import catalog
from loftline.plans.data import TABLES

SF = "/root/testdata/sf0.001"


def norm(v):
    """Floats as text, with one zero and one not-a-number."""
    if isinstance(v, float):
        return "nan" if v != v else repr(v + 0.0)
    return [norm(x) for x in v] if isinstance(v, list) else repr(v)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 100


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


ORACLES = catalog.oracles()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    cur = duck.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    want = sorted(str({n: norm(v) for n, v in sorted(zip(names, r))}) for r in cur.fetchall())
    assert sorted(str({n: norm(v) for n, v in sorted(r.asDict().items())}) for r in df.collect()) == want
