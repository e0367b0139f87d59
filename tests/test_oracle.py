"""Every registered query against its SQL oracle (DuckDB) on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from epilake.plans.catalog import all_oracles, all_queries
from epilake.sources.tables import TABLES

QUERIES = all_queries()  # the training-data queries have tests of their own in tests/llm
ORACLES = all_oracles()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    yield con
    con.close()


def _norm(v):
    if v is None:
        return (0, "")
    if isinstance(v, bool):
        return (1, str(v))
    if isinstance(v, (int, float)):
        f = float(v)
        return (1, "nan") if math.isnan(f) else (1, f"{f:.9g}")
    if hasattr(v, "isoformat"):
        return (1, v.isoformat())
    return (1, str(v))


def _canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in rows)


# DuckDB result types as the Spark type each query must produce
DUCK_TO_SPARK = {"INTEGER": "int", "BIGINT": "bigint", "DOUBLE": "double", "VARCHAR": "string",
                 "DATE": "date", "BOOLEAN": "boolean"}


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_matches_oracle(spark, duck, key):
    df = QUERIES[key](spark, SF_SMALL)
    srows = [tuple(r) for r in df.collect()]
    rel = duck.sql(ORACLES[key])
    stypes = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    dtypes = {n: DUCK_TO_SPARK.get(str(t), str(t)) for n, t in zip(rel.columns, rel.types)}
    assert stypes == dtypes
    cur = duck.execute(ORACLES[key])
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    assert _canon(df.columns, srows) == _canon(dcols, drows)


def test_queries_without_oracle_run(spark):
    """Queries that SQL cannot state (none at present) must at least run."""
    for key in sorted(set(QUERIES) - set(ORACLES)):
        assert QUERIES[key](spark, SF_SMALL).count() >= 0


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "expected_malaria" in df.columns
