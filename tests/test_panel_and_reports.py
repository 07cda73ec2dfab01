"""Panel construction and the report aggregations."""

from __future__ import annotations

import datetime as dt

import pytest

from funnelcast.functions.vocab import FUNNEL_STAGES
from funnelcast.operators import reports as A
from funnelcast.spec import DEFAULT_SPEC


def test_panel_shape(panel_small):
    cols = panel_small.columns
    assert cols[:9] == ["date", "year", "month", "month_name", "quarter", "entity", "product", "direction", "programme"]
    assert cols[9:] == list(FUNNEL_STAGES)
    assert panel_small.count() == 1385  # §7.2 measured figure at sf0.001
    assert panel_small.select("date").distinct().count() == 80


def test_panel_totals_non_increasing(panel_small):
    row = panel_small.groupBy().sum(*FUNNEL_STAGES).first()
    totals = [row[f"sum({s})"] for s in FUNNEL_STAGES]
    assert totals == sorted(totals, reverse=True)


def test_period_variant_has_row_inversions(spark):
    from funnelcast.sources.testpanel import build_test_panel

    p = build_test_panel(spark, "/root/testdata/sf0.001", "period")
    assert p.where("RE > APD").count() > 0
    row = p.groupBy().sum(*FUNNEL_STAGES).first()
    totals = [row[f"sum({s})"] for s in FUNNEL_STAGES]
    assert totals == sorted(totals, reverse=True)


def test_monthly_trend_values(panel_small):
    rows = A.monthly_trend(panel_small).orderBy("date").collect()
    assert rows[0]["mom_growth_pct"] is None and rows[0]["yoy_growth_pct"] is None
    assert rows[12]["yoy_growth_pct"] == pytest.approx((rows[12]["APP"] / rows[0]["APP"] - 1) * 100)
    assert rows[1]["rolling_3m"] == pytest.approx((rows[0]["APP"] + rows[1]["APP"]) / 2)
    assert rows[-1]["cumulative_APP"] == sum(r["APP"] for r in rows)


def test_funnel_overall_one_flag_and_first_stage(panel_small):
    f = A.funnel_overall(panel_small).collect()
    assert [r["stage"] for r in f] == list(FUNNEL_STAGES)
    assert f[0]["conversion_from_previous_pct"] == 100.0 and f[0]["dropoff_count"] == 0
    assert sum(r["is_biggest_dropoff"] for r in f) == 1
    worst = max(f[1:], key=lambda r: r["dropoff_count"])
    assert worst["is_biggest_dropoff"]


def test_seasonality_index_mean_about_one(panel_small):
    prof = A.seasonality_profile(panel_small).collect()
    assert len(prof) == 12
    # months are equally represented except the partial last year, so the mean index is close to 1
    mean_index = sum(r["seasonal_index"] for r in prof) / 12
    assert abs(mean_index - 1.0) < 0.1
    assert {r["season_label"] for r in prof} <= {"High", "Medium", "Low"}


def test_contribution_sums_to_100(panel_small):
    rows = A.monthly_contribution(panel_small).groupBy("year").sum("contribution_pct").collect()
    for r in rows:
        assert r[1] == pytest.approx(100.0)


def test_yearly_first_growth_null(panel_small):
    rows = A.yearly_summary(panel_small).collect()
    assert rows[0]["yoy_growth_pct"] is None
    assert all(r["yoy_growth_pct"] is not None for r in rows[1:])


def test_funnel_by_unknown_dimension(panel_small):
    with pytest.raises(KeyError):
        A.funnel_by_dimension(panel_small, "nope")


def test_peak_months_min_rank(spark):
    from pyspark.sql import Row

    rows = [Row(date=dt.date(2020, m, 1), APP=v) for m, v in [(1, 5), (2, 9), (3, 9), (4, 1)]]
    p = spark.createDataFrame(rows)
    out = A.peak_months(p, top_n=3, spec=DEFAULT_SPEC).collect()
    assert [(r["rank"], r["applications"]) for r in out] == [(1, 9), (1, 9), (3, 5)]
    assert out[0]["month"] == "Feb 2020"
