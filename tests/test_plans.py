"""Physical plans: no pair comparison, no Python, per-group limits before the shuffle."""

from __future__ import annotations

from pathlib import Path

import pytest

from __spark_entry__ import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test data not present")


def plan(spark, name):
    return queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name",
    ["c01_nearest_anchor", "c02_row_intervals", "f10_peer_deltas", "g11_match_records", "g12_codes_by_containment",
     "g14_best_street_match", "g15_resolve_zone_keys", "g17_map_zones", "j08_assign_clusters", "l05_dispatch_plan"],
)
def test_no_nested_loops_and_no_python(spark, name):
    text = plan(spark, name)
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEvalPython"):
        assert bad not in text


@pytest.mark.parametrize("name", ["g20_top_codes", "e16_failure_digest"])
def test_group_limits_run_before_the_shuffle(spark, name):
    assert "WindowGroupLimit" in plan(spark, name)


def test_scans_read_only_the_needed_columns(spark):
    text = plan(spark, "g18_count_votes")
    assert "ReadSchema: struct<l_orderkey:bigint,l_suppkey:bigint>" in text


@pytest.mark.parametrize("name, scans, exchanges", [
    ("c01_nearest_anchor", 2, 1), ("c02_row_intervals", 4, 3), ("c03_last_header_above", 4, 3), ("c04_token_runs", 2, 3),
    ("c07_month_grid", 6, 6), ("c07_icon_grid", 6, 6),
])
def test_ordered_merges_read_their_input_once_or_twice(spark, name, scans, exchanges):
    text = plan(spark, name)
    assert text.count("FileScan") <= scans and text.count("Exchange hash") <= exchanges


def test_yearly_build_shares_one_frame(spark):
    assert plan(spark, "j11_yearly_build").count("Exchange hash") <= 45
    assert plan(spark, "f11_percent_vs_median").count("Scan ") <= 10
