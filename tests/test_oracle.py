"""Every catalogued query against its SQL, run by DuckDB on the same tables."""

import math

import duckdb
import pytest

from marginalia.plans.catalog import CATALOG

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def oracle(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(rows, names):
    def one(v):
        return "null" if v is None or isinstance(v, float) and math.isnan(v) else f"{v:.9g}" if isinstance(v, float) else str(v)

    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(one(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(CATALOG))
def test_query(spark, sf_dir, oracle, name):
    fn, sql = CATALOG[name]
    got = fn(spark, sf_dir)
    rows = [tuple(r) for r in got.collect()]
    if sql is None:
        assert got.columns
        return
    want = oracle.execute(sql)
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    described = {r[0]: r[1] for r in oracle.execute(f"DESCRIBE {sql}").fetchall()}
    assert {c: TYPES[t] for c, t in got.dtypes} == described
    assert canonical(rows, got.columns) == canonical(oracle.execute(sql).fetchall(), names)
