"""Hand-computed edge cases of the KPI rules."""

from __future__ import annotations

import datetime as dt

import pytest

from funnelcast.operators import kpis as K
from funnelcast.operators import reports as A
from funnelcast.spec import DEFAULT_SPEC


def _monthly_panel(spark, values_by_month, years=(2021, 2022)):
    """A panel with one row per month whose APP follows ``values_by_month`` (same every year)."""
    rows = []
    for y in years:
        for m in range(1, 13):
            rows.append((dt.date(y, m, 1), y, m, int(values_by_month[m - 1]), 0))
    return spark.createDataFrame(rows, "date date, year int, month int, APP bigint, RE bigint")


def test_peak_season_wraps_december_to_january(spark):
    # above average in Nov, Dec, Jan, Feb only -> the run wraps the year end
    vals = [130, 120, 80, 80, 80, 80, 80, 80, 80, 80, 125, 140]
    run = K.peak_season_run(_monthly_panel(spark, vals)).first()
    assert (run["start_month"], run["end_month"], run["run_length"]) == ("Nov", "Feb", 4)
    assert run["peak_month"] == "Dec"


def test_peak_season_all_months_capped_at_twelve(spark):
    run = K.peak_season_run(_monthly_panel(spark, [100] * 12)).first()
    assert run["run_length"] == 12 and run["start_month"] == "Jan" and run["end_month"] == "Dec"


def test_trough_ratio_floors_divisor_at_one(spark):
    vals = [0, 50, 50, 50, 50, 50, 50, 50, 50, 50, 50, 200]
    t = K.trough_ratio(_monthly_panel(spark, vals)).first()
    assert t["weakest_month"] == "Jan" and t["strongest_month"] == "Dec"
    assert t["peak_trough_ratio"] == pytest.approx(200.0)  # 200 / max(0, 1)


def test_cagr_needs_three_years(spark):
    two = _monthly_panel(spark, [10] * 12, years=(2021, 2022))
    assert K.cagr(two).count() == 0
    rows = []
    for y, v in ((2020, 100), (2021, 110), (2022, 121)):
        rows += [(dt.date(y, m, 1), y, m, v, 0) for m in range(1, 13)]
    three = spark.createDataFrame(rows, "date date, year int, month int, APP bigint, RE bigint")
    c = K.cagr(three).first()
    assert c["years"] == 2 and c["cagr_pct"] == pytest.approx(10.0) and c["total_growth_pct"] == pytest.approx(21.0)


def _funnel_panel(spark, totals):
    stages = DEFAULT_SPEC.stages
    row = (dt.date(2024, 1, 1), "A", "GV", "outgoing", "oGV", *totals)
    schema = "date date, entity string, product string, direction string, programme string, " + ", ".join(f"{s} bigint" for s in stages)
    return spark.createDataFrame([row], schema)


def test_funnel_zero_previous_and_zero_first_stage(spark):
    f = {r["stage"]: r for r in A.funnel_overall(_funnel_panel(spark, (0, 0, 5, 5, 2, 1, 0))).collect()}
    assert f["ACH"]["conversion_from_previous_pct"] == 100.0       # previous (APP) is 0
    assert f["ACC"]["conversion_from_previous_pct"] == 100.0 and f["ACC"]["dropoff_pct"] == 0.0
    assert f["ACC"]["dropoff_count"] == -5                          # previous - current even on a zero base
    assert f["ACC"]["conversion_from_APP_pct"] == 500.0             # first total 0 -> divisor 1
    assert sum(r["is_biggest_dropoff"] for r in f.values()) == 1


def test_efficiency_null_when_no_realizations(spark):
    e = K.funnel_efficiency(_funnel_panel(spark, (10, 8, 6, 4, 0, 0, 0))).first()
    assert e["end_to_end_pct"] == 0.0 and e["applications_per_realization"] is None
    b = K.funnel_bottleneck(_funnel_panel(spark, (10, 8, 6, 4, 0, 0, 0))).first()
    assert (b["from_stage"], b["to_stage"], b["dropoff_count"]) == ("APD", "RE", 4)
