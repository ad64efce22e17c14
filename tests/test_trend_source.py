"""The panel's rows, one for every year of a property, are never broadcast to meet the universe."""

from __future__ import annotations

import __spark_entry__ as entry


def test_panel_and_universe_meet_a_partition_at_a_time(spark, sf):
    plan = entry.queries()["j12_p37_trend_source"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "Broadcast" not in plan
