"""Driver contract (entry / queries / oracle_sql) and generated findings."""

from __future__ import annotations

import pytest

import __spark_entry__ as E
from funnelcast.operators import findings as FI
from funnelcast.operators import forecast as FC
from funnelcast.plans.training import forecast_year
from tests.conftest import SF001


def test_entry_runs_and_has_stable_schema(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert {"date", "APP", "yoy_growth_pct", "rolling_12m"} <= set(df.columns)


def test_every_oracle_has_a_query():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 90


@pytest.mark.parametrize("name", ["monthly_trend", "funnel_overall", "dq_report", "backtest_metrics", "envelope_to_panel_flat",
                                  "kpi_forecast", "events_funnel_overall", "map_status"])
def test_oracle_agrees_at_small_scale(spark, duck, name):
    from tools.oracle_check import compare

    sdf = E.queries()[name](spark, SF001).toPandas()
    ddf = duck.execute(E.oracle_sql()[name]).df()
    ok, msg = compare(sdf, ddf)
    assert ok, msg


def test_findings_structure(panel_small):
    run = forecast_year(panel_small, 2002, models=FC.BASELINE_MODELS)
    rows = FI.generate_findings(panel_small, run).orderBy("order_no").collect()
    assert len(rows) >= 8
    assert {"Forecast", "Growth", "Seasonality", "Funnel", "Entities", "Products", "Model"} <= {r["category"] for r in rows}
    for r in rows:
        assert r["headline"] and r["headline"].endswith(".")
        assert r["kind"] in {"positive", "negative", "neutral"}
    assert [r["order_no"] for r in rows] == sorted(r["order_no"] for r in rows)


def test_findings_without_forecast(panel_small):
    rows = FI.generate_findings(panel_small).collect()
    assert rows and all(r["category"] not in {"Forecast", "Model"} for r in rows)
    assert not any(r["headline"] is None or "nan" in r["headline"].lower() for r in rows)
