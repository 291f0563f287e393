"""Every registered query of the library against its DuckDB oracle on sf0.001."""

import duckdb
import pytest

import __spark_entry__ as entry
from storelens.plans.registry import ORACLES, QUERIES
from storelens.sources.tables import TABLES

from conftest import SF_SMALL

KEYS = sorted(k for k in ORACLES if k in QUERIES)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def _norm(rows):
    return sorted(tuple("" if v is None else (f"{v:.9g}" if isinstance(v, float) else str(v)) for v in r) for r in rows)


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, con, key):
    df = QUERIES[key](spark, SF_SMALL)
    cols = sorted(df.columns)
    got = _norm(df.select(*cols).collect())
    res = con.execute(ORACLES[key])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    idx = [names.index(c) for c in cols]
    want = _norm([tuple(r[i] for i in idx) for r in res.fetchall()])
    assert got == want


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "external_id" in df.columns
