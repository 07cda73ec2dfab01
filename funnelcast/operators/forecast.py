"""Baseline forecasters (M1-M4, M12) and the rolling-origin backtest.

Everything works on a *history frame* ``(keys..., date, y, rn, n)``: a dense
monthly series per key with its 1-based row number and length. An *origin* is
the number of training rows (the reference's integer origin), so the training
slice of origin ``o`` is ``rn <= o`` and step ``s`` targets ``rn = o + s``.

No loop over origins or series: each history row carries the state a baseline
would have if that row were the last training month (trailing window frames),
origins are a filter on those rows, steps an ``explode``, and actuals and
seasonal look-backs are equi-joins on ``(keys, rn)``. The series keys are the
partitioning for every window and join, so fleets scale out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from funnelcast.functions import vocab
from funnelcast.operators.features import densify_monthly, target_series
from funnelcast.spec import DEFAULT_SPEC, FunnelSpec

BASELINE_MODELS = ("naive_last", "moving_average_3", "moving_average_6", "seasonal_naive", "seasonal_naive_drift")


def _keys(series_keys) -> list[str]:
    return list(series_keys or ())


def history_series(panel: DataFrame, spec: FunnelSpec = DEFAULT_SPEC, series_keys=()) -> DataFrame:
    """Target per series and month on a complete month grid (interpolated), with ``rn`` and ``n``."""
    keys = _keys(series_keys)
    dense = densify_monthly(target_series(panel, spec, keys), keys).drop("interpolated")
    w = Window.partitionBy(*keys).orderBy("date")
    return dense.withColumns(
        {"rn": F.row_number().over(w), "n": F.count(F.lit(1)).over(Window.partitionBy(*keys))}
    )


def origins(history: DataFrame, initial: int = 24, step: int = 1, horizon: int = 1) -> DataFrame:
    """Origin rows of the walk-forward: ``initial, initial+step, ... <= n - horizon`` per series."""
    cond = (F.col("rn") >= initial) & (F.col("rn") <= F.col("n") - horizon) & (F.pmod(F.col("rn") - initial, F.lit(step)) == 0)
    return history.where(cond)


def check_origins(history: DataFrame, initial: int = 24, horizon: int = 1, step: int = 1, min_points: int = 12,
                  series_keys=()) -> None:
    """Raise when any series offers fewer than ``min_points`` origins (the source's guard).

    One small aggregate (a row per series) answers it; nothing else is collected.
    """
    keys = _keys(series_keys)
    per = history.groupBy(*keys).agg(F.max("n").alias("n"))
    n_orig = F.greatest(F.floor((F.col("n") - horizon - initial) / step) + 1, F.lit(0))
    worst = per.agg(F.min(n_orig).alias("m"), F.min("n").alias("n")).first()
    if worst["m"] is None or worst["m"] < min_points:
        raise ValueError(
            f"Backtest needs at least {min_points} origins but a series offers {worst['m'] or 0} "
            f"({worst['n']} months, initial {initial}); lower the initial training window."
        )


def final_origins(history: DataFrame) -> DataFrame:
    """The last row of every series: the origin for forecasting the future."""
    return history.where(F.col("rn") == F.col("n"))


def _baseline_state(history: DataFrame, series_keys, period: int = 12, damping: float = vocab.DRIFT_DAMPING) -> DataFrame:
    keys = _keys(series_keys)
    w = Window.partitionBy(*keys).orderBy("rn")
    recent = F.sum("y").over(w.rowsBetween(-(period - 1), 0))
    previous = F.sum("y").over(w.rowsBetween(-(2 * period - 1), -period))
    growth = F.when(
        (F.col("rn") >= 2 * period) & (previous > 0), F.lit(1.0) + (recent / previous - F.lit(1.0)) * F.lit(damping)
    ).otherwise(F.lit(1.0))
    return history.withColumns(
        {
            "_last": F.col("y"),
            "_ma3": F.avg("y").over(w.rowsBetween(-2, 0)),
            "_ma6": F.avg("y").over(w.rowsBetween(-5, 0)),
            "_growth": growth,
        }
    )


def baseline_forecasts(
    history: DataFrame, origin_rows: DataFrame | None = None, series_keys=(), horizon: int = 1, period: int = 12,
    models=BASELINE_MODELS,
) -> DataFrame:
    """``(keys..., origin, origin_date, step, model, y_pred)`` for the five baselines.

    ``origin_rows`` selects the origins (default: every row); ``horizon`` is an int or
    a column over ``origin_date`` (per-origin horizons). Seasonal naive cycles
    the last ``period`` values; with fewer rows it repeats the last value.
    """
    keys = _keys(series_keys)
    state = _baseline_state(history, keys, period)
    if origin_rows is not None:
        state = state.join(origin_rows.select(*keys, "rn"), [*keys, "rn"], "left_semi")
    h = F.lit(horizon) if isinstance(horizon, int) else horizon
    fan = state.select(
        *keys,
        F.col("rn").alias("origin"),
        F.col("date").alias("origin_date"),
        "_last", "_ma3", "_ma6", "_growth",
    ).withColumn("step", F.explode(F.sequence(F.lit(1), h))).withColumn(
        "_season_rn",
        F.when(F.col("origin") >= period, F.col("origin") - period + 1 + F.pmod(F.col("step") - 1, F.lit(period))),
    )
    look = history.select(*keys, F.col("rn").alias("_season_rn"), F.col("y").alias("_season_y"))
    fan = fan.join(look, [*keys, "_season_rn"], "left")
    seasonal = F.coalesce(F.col("_season_y"), F.col("_last"))
    preds = {
        "naive_last": F.col("_last"),
        "moving_average_3": F.col("_ma3"),
        "moving_average_6": F.col("_ma6"),
        "seasonal_naive": seasonal,
        "seasonal_naive_drift": seasonal * F.col("_growth"),
    }
    stacked = F.array(*[F.struct(F.lit(m).alias("model"), preds[m].alias("y_pred")) for m in models])
    return fan.select(*keys, "origin", "origin_date", "step", F.inline(stacked)).withColumn(
        "y_pred", F.greatest(F.col("y_pred"), F.lit(0.0))
    )


def attach_actuals(predictions: DataFrame, history: DataFrame, series_keys=()) -> DataFrame:
    """Join the observed value of each target month: ``rn = origin + step``."""
    keys = _keys(series_keys)
    actual = history.select(*keys, F.col("rn").alias("_t_rn"), "date", F.col("y").alias("y_true"))
    p = predictions.withColumn("_t_rn", F.col("origin") + F.col("step"))
    return p.join(actual, [*keys, "_t_rn"]).select(
        "model", *keys, "origin", "origin_date", "date", "step", "y_true", "y_pred"
    )


def future_dates(predictions: DataFrame) -> DataFrame:
    """Target month of a forecast row: ``origin_date + step`` months."""
    return predictions.withColumn("date", F.add_months("origin_date", F.col("step")))


def backtest_baselines(
    history: DataFrame, series_keys=(), initial: int = 24, step: int = 1, horizon: int = 1,
) -> DataFrame:
    """Walk-forward predictions of the five baselines: ``(model, keys, origin, origin_date, date, step, y_true, y_pred)``."""
    keys = _keys(series_keys)
    o = origins(history, initial, step, horizon)
    preds = baseline_forecasts(history, o, keys, horizon)
    return attach_actuals(preds, history, keys)
