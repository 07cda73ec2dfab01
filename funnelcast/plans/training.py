"""Train-and-select and the forecast table (M13, M14, M23, M24) as one lazy plan.

``history -> candidates (baselines, Holt-Winters, feature-based learners) ->
backtest -> metrics -> selection -> forecast of each series' selected model ->
intervals -> activity labels -> table``. Learners are fitted once for all origins
(:mod:`funnelcast.operators.origin_models`); the last origin's fit is the refitted
winner. A (series, model) that could not be evaluated has a status row. A fleet (``series_keys``) goes through the same
plan: every step is partitioned by the keys, so selection happens per series in
one job and there is no loop over series, origins or (for window-expressible
models) model names.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from funnelcast.operators import evaluation as EV
from funnelcast.operators import forecast as FC
from funnelcast.operators import origin_models as OM
from funnelcast.operators.holtwinters import holt_winters_forecasts, holt_winters_from_states, holt_winters_states
from funnelcast.plans.materialize import materialize
from funnelcast.spec import DEFAULT_SPEC, FunnelSpec

WINDOW_CANDIDATES = FC.BASELINE_MODELS + ("holt_winters",)
LEARNERS = tuple(OM.LEARNERS)
CANDIDATES = WINDOW_CANDIDATES + LEARNERS
#: Linear learners cost little for each series and origin; a large fleet may leave the tree ensembles out.
FLEET_CANDIDATES = WINDOW_CANDIDATES + ("linear_regression", "ridge")


@dataclass
class Fits:
    """Fits over a superset of the origins, shared by backtest and forecast (None: not wanted or not fitted yet)."""

    hw_states: DataFrame | None = None
    learners: DataFrame | None = None
    rows: DataFrame | None = None


def candidate_forecasts(history: DataFrame, origin_rows: DataFrame, series_keys=(), horizon=1,
                        models=WINDOW_CANDIDATES, hw_states: DataFrame | None = None, fits: Fits | None = None) -> DataFrame:
    """Model registry (M13): union of every enabled candidate's forecasts for the given origins.

    ``fits`` lets several origin sets share one fit; learners need it (their features read the panel). One step from
    an observed origin uses the observed lagged context, longer horizons feed predictions back.
    """
    keys = list(series_keys or ())
    fits = fits or Fits(hw_states)
    wanted = origin_rows.select(*keys, F.col("rn").alias("origin"))
    base = [m for m in models if m in FC.BASELINE_MODELS]
    parts = []
    if base:
        parts.append(FC.baseline_forecasts(history, origin_rows, series_keys, horizon, models=base))
    if "holt_winters" in models:
        if fits.hw_states is None:
            hw = holt_winters_forecasts(history, origin_rows, series_keys, horizon)
        else:
            picked = fits.hw_states.join(wanted, [*keys, "origin"], "left_semi")
            hw = holt_winters_from_states(picked, keys, horizon)
        parts.append(hw.drop("alpha", "beta", "gamma"))
    learners = [m for m in models if m in LEARNERS]
    if learners:
        if fits.learners is None or fits.rows is None:
            raise ValueError("learners need their fits and feature rows")
        own = fits.learners.where(F.col("model").isin(learners)).join(wanted, [*keys, "origin"], "left_semi")
        if isinstance(horizon, int) and horizon == 1:
            ahead = OM.one_step_forecasts(own, fits.rows, keys)
        else:
            ahead = OM.recursive_forecast(own, fits.rows, history, keys, horizon)
        parts.append(ahead.select(*keys, "origin", "origin_date", "step", "model", "y_pred"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def backtest(history: DataFrame, series_keys=(), initial: int = 24, step: int = 1, horizon: int = 1,
             models=WINDOW_CANDIDATES, hw_states: DataFrame | None = None, fits: Fits | None = None) -> DataFrame:
    """M14 rolling-origin backtest of all candidates with actuals attached."""
    o = FC.origins(history, initial, step, horizon)
    preds = candidate_forecasts(history, o, series_keys, horizon, models, hw_states, fits)
    return FC.attach_actuals(preds, history, series_keys)


def candidate_status(history: DataFrame, predictions: DataFrame, series_keys=(), models=WINDOW_CANDIDATES, initial: int = 24,
                     step: int = 1, horizon: int = 1, min_points: int = 12) -> DataFrame:
    """``(keys..., model, months, origins, evaluated, status, reason)`` for every series and candidate.

    ``too_few_origins``: the series offers fewer than ``min_points`` origins (the guard of the backtest); ``failed`` and
    ``incomplete``: none or only some of its origins have a prediction; else ``ok``.
    """
    keys = list(series_keys or ())
    months = F.count(F.lit(1)).cast("int")
    per = history.groupBy(*keys).agg(months.alias("months")) if keys else history.groupBy().agg(months.alias("months"))
    offered = F.greatest(F.floor((F.col("months") - horizon - initial) / step) + 1, F.lit(0)).cast("int")
    asked = per.withColumn("origins", offered).withColumn("model", F.explode(F.array(*[F.lit(m) for m in models])))
    done = predictions.groupBy("model", *keys).agg(F.count_distinct("origin").cast("int").alias("evaluated"))
    s = asked.join(done, ["model", *keys], "left").withColumn("evaluated", F.coalesce("evaluated", F.lit(0)))
    status = (F.when(F.col("origins") < min_points, "too_few_origins").when(F.col("evaluated") == 0, "failed")
              .when(F.col("evaluated") < F.col("origins"), "incomplete").otherwise("ok"))
    reason = (F.when(F.col("origins") < min_points, F.format_string(f"%d origins from %d months, {min_points} needed", "origins", "months"))
              .when(F.col("evaluated") < F.col("origins"), F.format_string("%d of %d origins evaluated", "evaluated", "origins")))
    return s.select("model", *keys, "months", "origins", "evaluated", status.alias("status"), reason.alias("reason"))


def _identity(df: DataFrame) -> DataFrame:
    return df


def train_and_select(panel: DataFrame, spec: FunnelSpec = DEFAULT_SPEC, series_keys=(), models=CANDIDATES,
                     initial: int = 24, step: int = 1, horizon: int = 1, checkpoint_stages: bool = False,
                     share_product: str | None = None, min_points: int = 12) -> dict[str, DataFrame]:
    """History -> backtest -> metrics -> selection (lazy frames; nothing collected).

    ``status`` has a row for every series and candidate; only series that offer ``min_points`` origins are selected for.

    ``checkpoint_stages`` cuts lineage after the history and the backtest (reliable
    checkpoints in the shared folder), so the many small frames read downstream by
    reports and findings never re-run the backtest.
    """
    keys = list(series_keys or ())
    cut = materialize if checkpoint_stages else _identity
    history = cut(FC.history_series(panel, spec, series_keys))
    fits = Fits()
    if "holt_winters" in models:
        # one Holt-Winters fit serves the backtest origins and the final (forecasting) origin
        every = FC.origins(history, initial, step, horizon).unionByName(FC.final_origins(history))
        fits.hw_states = cut(holt_winters_states(history, every, series_keys))
    learners = [m for m in models if m in LEARNERS]
    if learners:
        fits.rows = cut(OM.learner_rows(panel, spec, series_keys, share_product))
        fits.learners = cut(OM.fit_origins(fits.rows, series_keys, learners, initial, step))
    preds = cut(backtest(history, series_keys, initial, step, horizon, models, fits=fits))
    status = cut(candidate_status(history, preds, series_keys, models, initial, step, horizon, min_points))
    ready = status.where(F.col("evaluated") > 0).where(F.col("status") != "too_few_origins").select("model", *keys)
    metrics = EV.backtest_metrics(preds.join(ready, ["model", *keys], "left_semi"), series_keys)
    selection = cut(EV.model_selection(metrics, series_keys))
    return {"history": history, "backtest": preds, "metrics": metrics, "selection": selection,
            "status": status,
            "quantiles": cut(EV.residual_quantiles(preds, series_keys)), "fits": fits}


def forecast_year(panel: DataFrame, year: int, spec: FunnelSpec = DEFAULT_SPEC, series_keys=(), models=CANDIDATES,
                  horizon: int = 12, initial: int = 24, checkpoint_stages: bool = False, share_product: str | None = None) -> dict[str, DataFrame]:
    """Forecast each series' selected model far enough to cover ``year``; label and tabulate."""
    keys = list(series_keys or ())
    cut = materialize if checkpoint_stages else _identity
    run = train_and_select(panel, spec, keys, models, initial, checkpoint_stages=checkpoint_stages, share_product=share_product)
    history = run["history"]
    chosen = run["selection"].where("selected").select(*keys, "model")
    total = EV.lead_steps(F.col("origin_date"), year) + F.lit(horizon)
    fits = run["fits"]
    if fits.learners is not None:  # only the winners' fits are walked over the year
        fits = replace(fits, learners=fits.learners.join(chosen, [*keys, "model"] if keys else "model", "left_semi"))
    future = candidate_forecasts(history, FC.final_origins(history), keys, total, models, fits=fits)
    future = future.join(chosen, [*keys, "model"], "left_semi")
    future = FC.future_dates(future)
    bands = cut(EV.forecast_intervals(future, run["quantiles"], keys))
    in_year = bands.where(F.year("date") == year)
    thresholds = EV.activity_thresholds(history, in_year, keys, spec)
    labelled = EV.assign_activity_levels(in_year, thresholds, keys)
    table = EV.prediction_table(labelled, year, keys)
    return {**run, "forecast": bands, "thresholds": thresholds, "labelled": labelled, "table": table,
            "summary": EV.prediction_summary(table, thresholds, year, keys)}


def refitted_winners(run: dict) -> dict[str, DataFrame]:
    """What serving needs of a run, as tables: selection, quantiles, history and the winners' fits at the last origin.

    Learners are rows like any other, so the winner of every series is saved and read back as Parquet (S11).
    """
    keys = [c for c in run["history"].columns if c not in ("date", "y", "rn", "n")]
    chosen = run["selection"].where("selected").select(*keys, "model")
    last = FC.final_origins(run["history"]).select(*keys, F.col("rn").alias("origin"))
    out = {n: run[n] for n in ("selection", "quantiles", "history", "status")}
    fits = run["fits"]
    if fits.learners is not None:
        out["winner_fits"] = fits.learners.join(chosen, [*keys, "model"], "left_semi").join(last, [*keys, "origin"], "left_semi")
        out["feature_rows"] = fits.rows
    return out
