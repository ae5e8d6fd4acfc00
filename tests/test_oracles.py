"""Every query of the linkage part that SQL can express, against DuckDB on the same tables."""

from __future__ import annotations

import pytest

from quern.plans import basics, linkage  # noqa: F401
from quern.plans.registry import ORACLES, QUERIES
from tests.compare import check, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, con, name):
    check(QUERIES[name](spark, SF), con, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_only(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.columns and df.limit(5).count() >= 1
