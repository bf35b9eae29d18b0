"""The queries that SQL can express, against DuckDB on the same tables."""

import pytest

from marginalia.llm.registry import ORACLES, query
from tests.test_oracle import TYPES, canonical, oracle  # noqa: F401


@pytest.fixture(scope="module")
def sf_dir():
    return "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, sf_dir, oracle, name):  # noqa: F811
    got = query(name)(spark, sf_dir)
    rows = [tuple(r) for r in got.collect()]
    want = oracle.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    described = {r[0]: r[1] for r in oracle.execute(f"DESCRIBE {ORACLES[name]}").fetchall()}
    assert {c: TYPES[t] for c, t in got.dtypes} == described
    assert canonical(rows, got.columns) == canonical(oracle.execute(ORACLES[name]).fetchall(), names)
