"""Spark query vs DuckDB oracle on the driver's tables (the correctness gate)."""

import os

import pytest

from citeweave.plans.oracle_check import check
from citeweave.plans.registry import load_all

SF = os.environ.get("CITEWEAVE_ORACLE_SF", "/root/testdata/sf0.001")
NAMES = sorted(n for n, q in load_all().items() if q.sql)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, name):
    r = check(spark, name, SF)
    assert r["status"] == "ok", r


def test_every_query_is_registered_with_a_callable():
    import __spark_entry__ as e

    qs, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(qs) and len(qs) >= 80
