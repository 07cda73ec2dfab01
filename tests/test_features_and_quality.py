"""Features (F1-F16, metamorphic leakage tests) and validation."""

from __future__ import annotations

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from funnelcast.operators import features as FE
from funnelcast.operators import quality as V


def _months(n, start=(2020, 1)):
    y, m = start
    out = []
    for _ in range(n):
        out.append(dt.date(y, m, 1))
        m += 1
        if m == 13:
            y, m = y + 1, 1
    return out


def _series(spark, values, start=(2020, 1)):
    return spark.createDataFrame([(d, float(v)) for d, v in zip(_months(len(values), start), values)], "date date, y double")


def _hist(spark, values):
    return {r["date"]: r for r in FE.history_features(FE.time_features(_series(spark, values))).collect()}


def test_exact_lags_on_a_counter(spark):
    rows = _hist(spark, list(range(24)))
    r = rows[_months(24)[13]]
    assert r["lag_1"] == 12 and r["lag_12"] == 1 and r["lag_2"] == 11
    assert r["roll_mean_3"] == pytest.approx(11.0) and r["roll_std_3"] == pytest.approx(1.0)
    assert r["trend_slope_6"] == pytest.approx(1.0)
    assert r["mom_growth"] == pytest.approx((12 - 11) / 11 * 100)
    assert r["yoy_growth"] == 0.0  # lag 13 is 0: a zero base gives 0, not an error


def test_no_leakage_tampering_target_and_future(spark):
    base = [10 + i + 5 * math.sin(i) for i in range(30)]
    target = _months(30)[20]
    ref = _hist(spark, base)[target]
    tampered = list(base)
    tampered[20] = 1e6                      # the target month itself
    tampered[25] = -5e5                     # a later month
    got = _hist(spark, tampered)[target]
    for f in FE.HISTORY_FEATURES + FE.TIME_FEATURES:
        assert got[f] == pytest.approx(ref[f]), f


def test_calendar_flags(spark):
    rows = {r["date"].month: r for r in FE.time_features(_series(spark, [5.0] * 12)).collect()}
    assert rows[12]["is_year_end"] == 1.0 and rows[12]["is_break_season"] == 1.0 and rows[12]["season_code"] == 0.0
    assert rows[3]["is_exam_season"] == 1.0 and rows[3]["is_year_end"] == 0.0 and rows[3]["season_code"] == 1.0
    assert rows[7]["is_semester_start"] == 1.0 and rows[7]["days_in_month"] == 31.0
    assert rows[1]["month_index"] == 0.0 and rows[12]["month_index"] == 11.0


def test_single_point_rolling_std_is_zero(spark):
    rows = _hist(spark, [3.0, 4.0, 5.0])
    assert rows[_months(3)[1]]["roll_std_3"] == 0.0


def test_densify_interpolates_interior_gap(spark):
    s = spark.createDataFrame([(dt.date(2020, 1, 1), 10.0), (dt.date(2020, 4, 1), 40.0)], "date date, y double")
    out = [(r["date"].month, r["y"], r["interpolated"]) for r in FE.densify_monthly(s).orderBy("date").collect()]
    assert out == [(1, 10.0, False), (2, 20.0, True), (3, 30.0, True), (4, 40.0, False)]


def test_training_matrix_rows_and_no_nulls_in_history(panel_small):
    m = FE.training_matrix(panel_small)
    assert m.count() == 80 - 12
    row = m.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in FE.HISTORY_FEATURES]).first()
    assert all(v == 0 for v in row)


def _panel(spark, rows):
    schema = "date date, entity string, product string, direction string, programme string, " \
             "APP bigint, ACH bigint, ACC bigint, APD bigint, RE bigint, FI bigint, CO bigint"
    return spark.createDataFrame(rows, schema)


def _report(df):
    return {r["check"]: r for r in df.collect()}


def test_validation_catches_inverted_funnel_and_gap(spark):
    rows = [(dt.date(2024, 1, 1), "A", "GV", "outgoing", "oGV", 10, 12, 5, 4, 3, 2, 1),
            (dt.date(2024, 3, 1), "A", "GV", "outgoing", "oGV", 10, 12, 5, 4, 3, 2, 1)]
    rep = _report(V.validate(_panel(spark, rows), start="2024-01-01", end="2024-03-31"))
    assert rep["funnel_aggregate"]["n"] == 1 and rep["funnel_aggregate"]["detail"] == "ACH>APP"
    assert rep["month_gaps"]["n"] == 1 and rep["month_gaps"]["detail"] == "2024-02"
    assert rep["nonempty"]["passed"] is False


def test_per_row_inversion_only_warns(spark):
    rows = [(dt.date(2024, 1, 1), "A", "GV", "outgoing", "oGV", 10, 8, 6, 1, 3, 0, 0),
            (dt.date(2024, 1, 1), "B", "GV", "outgoing", "oGV", 10, 8, 6, 5, 0, 0, 0)]
    rep = _report(V.validate(_panel(spark, rows)))
    assert rep["funnel_rows"]["n"] == 1 and rep["funnel_rows"]["severity"] == "warning"
    assert rep["funnel_aggregate"]["n"] == 0
    assert rep["stat_rows"]["passed"] is True


def test_missing_columns_stop_early(spark):
    df = spark.createDataFrame([(1,)], "x int")
    rep = V.validate(df).collect()
    assert len(rep) == 1 and rep[0]["check"] == "required_columns" and rep[0]["passed"] is False


def test_reconcile_totals_zero_delta(panel_small):
    assert all(r["delta"] == 0 for r in V.reconcile_totals(panel_small).collect())


def test_feature_correlation_with_constant_and_missing_columns(spark):
    rows = [(0.1, 1.0, None, 3.0, 2.0), (0.1, 3.0, None, None, 5.0), (0.1, 2.0, None, 1.0, 3.0), (0.1, 9.0, None, 3.0, None)]
    m = spark.createDataFrame(rows, "a double, b double, c double, d double, y double").repartition(4)
    got = FE.feature_correlation(m, ("a", "b", "c", "d")).collect()
    assert [r["feature"] for r in got] == ["d", "b", "a", "c"]  # undefined ones last
    r = {x["feature"]: x["correlation"] for x in got}
    assert r["b"] == pytest.approx(0.98198051)
    assert r["d"] == pytest.approx(-1.0) and math.isnan(r["a"]) and r["c"] is None


def test_feature_correlation_over_a_flat_target(spark):
    m = spark.createDataFrame([(1.0, 4.0), (2.0, 4.0)], "a double, y double")
    assert math.isnan(FE.feature_correlation(m, ("a",)).first()["correlation"])
    assert FE.feature_correlation(m.limit(0), ("a",)).first()["correlation"] is None
