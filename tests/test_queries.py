"""Every registered query against its SQL twin, and the plans of the row-reading ones."""

from __future__ import annotations

import os

import pytest

from verification.compare import connect, mismatch
from verification.oracles import all_oracles
from verification.queries import FEATURES, all_queries, lineitem

SF_DIR = os.environ.get("RIDGELINE_TEST_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def connection():
    return connect(SF_DIR)


def test_every_query_has_an_oracle():
    assert set(all_queries()) == set(all_oracles())


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query(spark, connection, name):
    actual = all_queries()[name](spark, SF_DIR).toPandas()
    assert mismatch(actual, connection.execute(all_oracles()[name]).df()) is None


def plan_of(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def test_moment_scan_reads_only_its_columns(spark):
    from pyspark.sql import functions as F

    from ridgeline.operators.design import design
    from ridgeline.operators.moments import block_moments

    frame = design(lineitem(spark, SF_DIR).where("l_quantity > 10"), "charge", FEATURES[:2], F.col("l_orderkey") % 3)
    plan = plan_of(block_moments(frame))
    schema = plan[plan.index("ReadSchema") :]
    assert "l_extendedprice" in schema and "l_shipdate" not in schema and "l_returnflag" not in schema
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,10.0)]" in plan
    assert plan.count("Exchange") == 1
