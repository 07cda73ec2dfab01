"""Semantic check against published figures: a 48-month monthly series and the scores published for it.

The five window-only baselines, the backtest protocol (initial 24 months, step 1,
1-step horizon -> 24 origins), the seven metrics, the seasonal profile and the
trend-adjusted activity thresholds must reproduce the published numbers.
"""

from __future__ import annotations

import datetime as dt

import pytest

from funnelcast.operators import evaluation as EV
from funnelcast.operators import forecast as FC
from funnelcast.operators import reports as A
from funnelcast.operators.holtwinters import holt_winters_forecasts
from funnelcast.plans import training as TR

# FIXED VALUES: the published monthly series (Jan 2022 .. Dec 2025, applications per month)
SERIES = (
    1038, 615, 1184, 1208, 1537, 1225, 1042, 1167, 1102, 1191, 1485, 1080,
    845, 940, 2050, 1622, 1507, 1406, 1223, 1296, 1263, 1130, 1242, 987,
    1018, 1277, 2109, 1796, 2036, 1463, 1303, 1252, 1349, 1412, 1432, 1192,
    1193, 1293, 1804, 2245, 1744, 1158, 1253, 2025, 1660, 1716, 1781, 1357,
)

# FIXED VALUES: published 1-step walk-forward scores (MAE, RMSE, MAPE, sMAPE, error_std, max_abs_error, bias)
PUBLISHED = {
    "seasonal_naive_drift": (211.8694, 277.707, 13.037, 13.296, 179.5343, 747.4013, 47.2433),
    "seasonal_naive": (237.9167, 294.0886, 14.9366, 16.1205, 172.8692, 773.0, 154.9167),
    "naive_last": (283.1667, 372.4421, 17.5694, 17.5278, 241.9292, 832.0, 15.4167),
    "moving_average_6": (301.25, 389.4413, 18.6817, 19.4498, 246.8056, 956.1667, 69.0139),
    "moving_average_3": (325.3056, 426.2811, 20.8627, 20.807, 275.4849, 1015.0, 38.5278),
}
METRICS = ("MAE", "RMSE", "MAPE", "sMAPE", "error_std", "max_abs_error", "bias")


def _dates():
    return [dt.date(2022 + i // 12, i % 12 + 1, 1) for i in range(len(SERIES))]


@pytest.fixture(scope="module")
def history(spark):
    rows = [(d, float(v), i + 1, len(SERIES)) for i, (d, v) in enumerate(zip(_dates(), SERIES))]
    return spark.createDataFrame(rows, "date date, y double, rn int, n int")


def test_baseline_scores_match_published(history):
    bt = FC.backtest_baselines(history, initial=24, step=1, horizon=1)
    got = {r["model"]: r for r in EV.backtest_metrics(bt).collect()}
    for model, expected in PUBLISHED.items():
        assert got[model]["origins_evaluated"] == 24 and got[model]["n"] == 24
        for metric, value in zip(METRICS, expected):
            assert got[model][metric] == pytest.approx(value, abs=1e-3), (model, metric)


def test_selection_among_baselines(history):
    bt = FC.backtest_baselines(history, initial=24)
    sel = EV.model_selection(EV.backtest_metrics(bt)).where("selected").first()
    assert sel["model"] == "seasonal_naive_drift"  # best MAE, nothing else inside the 5 % band


def test_seasonal_profile_matches_published(spark):
    panel = spark.createDataFrame([(d, v) for d, v in zip(_dates(), SERIES)], "date date, APP bigint")
    prof = {r["month"]: r for r in A.seasonality_profile(panel).collect()}
    assert prof[1]["mean_applications"] == pytest.approx(1023.5)
    assert prof[1]["median_applications"] == pytest.approx(1028.0)
    assert prof[2]["std_applications"] == pytest.approx(321.712, abs=1e-3)
    assert prof[1]["seasonal_index"] == pytest.approx(0.742, abs=5e-4)
    assert prof[1]["season_label"] == "Low" and prof[1]["observations"] == 4


def test_trend_adjusted_thresholds_match_published(spark, history):
    fc = spark.createDataFrame([(dt.date(2026, m, 1), 1000.0 + m) for m in range(1, 13)], "date date, forecast double")
    th = EV.activity_thresholds(history.select("date", "y"), fc).first()
    assert th["n_ratios"] == 37
    assert th["ta_low"] == pytest.approx(0.8434, abs=1e-4)
    assert th["ta_high"] == pytest.approx(1.1182, abs=1e-4)


# FIXED VALUES: two published feature rows (time features then history features) of the series above
PUBLISHED_FEATURES = {
    dt.date(2023, 1, 1): (
        2023.0, 1.0, 1.0, 0.0, 12.0, 0.49999999999999994, 0.8660254037844387, 0.8660254037844386, 0.5000000000000001,
        1.0, 0.0, 1.0, 0.0, 31.0,
        1080.0, 1485.0, 1191.0, 1042.0, 1038.0, 1252.0, 209.27732796459344, 1177.8333333333333, 160.25906110628088,
        1156.1666666666667, 231.84823928726755, 1537.0, 615.0, -27.27272727272727, 0.0, 1.0404624277456647,
        0.9341213781173417, 35.228571428571385, 1038.0,
    ),
    dt.date(2024, 12, 1): (
        2024.0, 12.0, 4.0, 0.0, 35.0, -2.4492935982947064e-16, 1.0, -4.898587196589413e-16, 1.0,
        1.0, 0.0, 0.0, 1.0, 31.0,
        1432.0, 1412.0, 1349.0, 1463.0, 987.0, 1397.6666666666667, 43.31666346030512, 1368.5, 81.3603097339237,
        1452.8333333333333, 356.90203222461565, 2109.0, 987.0, 1.41643059490085, 15.297906602254429,
        1.4508611955420465, 0.9856602041986923, 7.685714285714093, 1033.5,
    ),
}


def test_feature_rows_match_published(history):
    from funnelcast.operators import features as FE

    feats = FE.history_features(FE.time_features(history.select("date", "y")))
    rows = {r["date"]: r for r in feats.collect()}
    names = FE.TIME_FEATURES + FE.HISTORY_FEATURES
    for day, expected in PUBLISHED_FEATURES.items():
        for name, value in zip(names, expected):
            assert rows[day][name] == pytest.approx(value, rel=1e-9, abs=1e-9), (day, name)


# FIXED VALUES: published scores of Holt-Winters (MAE, RMSE, MAPE) and its forecast of the next year (total, peak, peak month)
PUBLISHED_HW = (198.02, 241.17, 12.88)
PUBLISHED_YEAR = (21112, 2166, 3)


def test_holt_winters_reaches_the_published_scores_and_is_selected(history):
    bt = TR.backtest(history, models=TR.WINDOW_CANDIDATES)
    metrics = EV.backtest_metrics(bt)
    got = metrics.where("model = 'holt_winters'").first()
    assert [got[m] for m in ("MAE", "RMSE", "MAPE")] == pytest.approx(PUBLISHED_HW, rel=1e-3)
    assert EV.model_selection(metrics).where("selected").first()["model"] == "holt_winters"


def test_holt_winters_forecasts_the_published_year(history):
    year = holt_winters_forecasts(history, FC.final_origins(history), (), 12).collect()
    values = {r["step"]: round(r["y_pred"]) for r in year}
    peak = max(values, key=values.get)
    assert sum(values.values()) == pytest.approx(PUBLISHED_YEAR[0], rel=2e-3)
    assert (values[peak], peak) == (pytest.approx(PUBLISHED_YEAR[1], rel=5e-3), PUBLISHED_YEAR[2])
