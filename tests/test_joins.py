"""Joins of the network's queries are broadcast by what their sides hold, not by their files' sizes."""

from pathlib import Path

import pytest

from sluice.operators.fixpoint import kept
from sluice.plans import queries as plans

DATA = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
def test_a_small_file_of_many_names_is_not_broadcast_by_its_size(spark):
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")}
    try:
        plans.QUERIES["full_names"](spark, str(DATA))
        a, b = (kept(spark.range(20_000).selectExpr("concat('http://net.example/', id) AS s", f"id AS {c}")) for c in "ab")
        joined = a.join(b, "s")
        assert "BroadcastHashJoin" not in joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == 20_000
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
