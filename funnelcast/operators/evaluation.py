"""Backtest scoring, model selection, intervals, activity labels and the forecast table.

M15 metrics, M16 residual quantiles, M17 selection, M18 best per family,
M19 intervals, M20-M22 activity labels, M24 prediction table, M25 comparison
views, M26 history + forecast union, A27 label distribution.

All of these run on small frames (one row per model, per month or per series)
and are partitioned by ``series_keys`` so a fleet selects and labels every
series in the same job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from funnelcast.functions import vocab
from funnelcast.functions.columns import literal_map
from funnelcast.spec import DEFAULT_SPEC, FunnelSpec


def _keys(series_keys) -> list[str]:
    return list(series_keys or ())


def _w(keys) -> Window:
    return Window.partitionBy(*keys)


def keyed_join(left: DataFrame, right: DataFrame, keys, how: str = "inner") -> DataFrame:
    """Equi-join on the series keys.

    With no keys (the one total series) ``right`` is a one-row aggregate: its columns
    are attached as scalar subqueries (evaluated once, merged by the optimizer), so no
    cartesian or nested-loop join appears in the plan.
    """
    keys = _keys(keys)
    if keys:
        return left.join(right, keys, how)
    return left.select("*", *[right.select(c).scalar().alias(c) for c in right.columns if c not in left.columns])


# --------------------------------------------------------------------------- M15
def backtest_metrics(predictions: DataFrame, series_keys=()) -> DataFrame:
    """Per model (and series): MAE, RMSE, MAPE (zero actuals masked), sMAPE, error_std (population,
    of absolute errors), max_abs_error, bias = mean(true - pred), n, origins, family, explainability."""
    keys = _keys(series_keys)
    e = F.col("y_true") - F.col("y_pred")
    ae = F.abs(e)
    den = (F.abs("y_true") + F.abs("y_pred")) / 2.0
    m = predictions.groupBy("model", *keys).agg(
        F.avg(ae).alias("MAE"),
        F.sqrt(F.avg(e * e)).alias("RMSE"),
        (F.avg(F.when(F.col("y_true") != 0, ae / F.abs("y_true"))) * 100.0).alias("MAPE"),
        (F.avg(F.when(den != 0, ae / den)) * 100.0).alias("sMAPE"),
        F.stddev_pop(ae).alias("error_std"),
        F.max(ae).alias("max_abs_error"),
        F.avg(e).alias("bias"),
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("origin").alias("origins_evaluated"),
    )
    return m.withColumns(
        {
            "family": F.coalesce(F.try_element_at(literal_map(vocab.MODEL_FAMILY), F.col("model")), F.lit("other")),
            "explainability": F.coalesce(
                F.try_element_at(literal_map(vocab.EXPLAINABILITY_RANK), F.col("model")), F.lit(3)
            ).cast("int"),
        }
    )


# --------------------------------------------------------------------------- M16
def residual_quantiles(predictions: DataFrame, series_keys=(), confidence: float = 0.95) -> DataFrame:
    """Per model: the (1-c)/2 and (1+c)/2 quantiles of ``y_true - y_pred`` (linear interpolation)."""
    keys = _keys(series_keys)
    a = 1.0 - confidence
    e = F.col("y_true") - F.col("y_pred")
    return predictions.groupBy("model", *keys).agg(
        F.percentile(e, F.lit(a / 2.0)).alias("lower_q"),
        F.percentile(e, F.lit(1.0 - a / 2.0)).alias("upper_q"),
        F.count(F.lit(1)).alias("n_residuals"),
    )


# --------------------------------------------------------------------------- M17
def model_selection(metrics: DataFrame, series_keys=(), primary: str = "MAE", tolerance_pct: float = vocab.TOLERANCE_PCT) -> DataFrame:
    """Accuracy first, then stability and explainability inside the tolerance band.

    Models within ``tolerance_pct`` of the best ``primary`` are tied; inside the
    tied set the score is 0.5 * accuracy (distance to the best over the band
    width, clipped) + 0.3 * min-max(error_std) + 0.2 * min-max(explainability),
    a constant column scoring 0. Lowest score wins (ties: lower primary, then
    name). Non-tied rows keep NULL scores. Partitioned by ``series_keys``.
    """
    keys = _keys(series_keys)
    w = _w(keys)
    best = F.min(primary).over(w)
    threshold = best * (1.0 + tolerance_pct / 100.0)
    t = metrics.withColumns(
        {
            "explainability_rank": F.coalesce(
                F.try_element_at(literal_map(vocab.EXPLAINABILITY_RANK), F.col("model")).cast("double"),
                F.col("explainability").cast("double"),
            ),
            "_best": best,
            "_thr": threshold,
        }
    ).withColumn("within_tolerance", F.col(primary) <= F.col("_thr"))
    tw = Window.partitionBy(*keys, "within_tolerance")

    def minmax(c: str) -> Column:
        lo, hi = F.min(c).over(tw), F.max(c).over(tw)
        span = hi - lo
        return F.when(span > 0, (F.col(c) - lo) / span).otherwise(F.lit(0.0))

    band = F.col("_thr") - F.col("_best")
    acc = F.when(band > 0, F.least(F.greatest((F.col(primary) - F.col("_best")) / band, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    tied = F.col("within_tolerance")
    t = t.withColumns(
        {
            "accuracy_norm": F.when(tied, acc),
            "stability_norm": F.when(tied, minmax("error_std")),
            "explainability_norm": F.when(tied, minmax("explainability_rank")),
        }
    )
    wts = vocab.SELECTION_WEIGHTS
    t = t.withColumn(
        "composite_score",
        F.col("accuracy_norm") * wts["accuracy"] + F.col("stability_norm") * wts["stability"]
        + F.col("explainability_norm") * wts["explainability"],
    )
    pick = Window.partitionBy(*keys).orderBy(
        F.col("composite_score").asc_nulls_last(), F.col(primary).asc(), F.col("model").asc()
    )
    return t.withColumn("selected", F.row_number().over(pick) == 1).drop("_best", "_thr")


# --------------------------------------------------------------------------- M18
def best_per_family(metrics: DataFrame, series_keys=(), primary: str = "MAE") -> DataFrame:
    keys = _keys(series_keys)
    w = Window.partitionBy(*keys, "family").orderBy(F.col(primary).asc(), F.col("model").asc())
    return metrics.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


# --------------------------------------------------------------------------- M19
def forecast_intervals(forecasts: DataFrame, quantiles: DataFrame | None, series_keys=(), min_residuals: int = 5) -> DataFrame:
    """``point + q * sqrt(step)`` bands from backtest residual quantiles; fewer than
    ``min_residuals`` residuals (or none) -> a flat +/-20 % band. All clipped at 0."""
    keys = _keys(series_keys)
    f = forecasts
    if quantiles is not None:
        f = f.join(quantiles, ["model", *keys], "left")
    else:
        f = f.withColumns({"lower_q": F.lit(None).cast("double"), "upper_q": F.lit(None).cast("double"),
                           "n_residuals": F.lit(0).cast("bigint")})
    enough = F.coalesce(F.col("n_residuals"), F.lit(0)) >= min_residuals
    widen = F.sqrt(F.col("step").cast("double"))
    point = F.col("y_pred")
    lower = F.when(enough, point + F.col("lower_q") * widen).otherwise(point * 0.8)
    upper = F.when(enough, point + F.col("upper_q") * widen).otherwise(point * 1.2)
    zero = F.lit(0.0)
    return f.withColumns(
        {"forecast": F.greatest(point, zero), "lower": F.greatest(lower, zero), "upper": F.greatest(upper, zero)}
    ).drop("lower_q", "upper_q", "n_residuals")


# --------------------------------------------------------------------------- M20 - M22
def _label(value: Column, low: Column, high: Column) -> Column:
    L = vocab.ACTIVITY_LABELS
    return F.when(value >= high, L["high"]).when(value <= low, L["low"]).otherwise(L["medium"])


def activity_thresholds(history: DataFrame, forecasts: DataFrame, series_keys=(), spec: FunnelSpec = DEFAULT_SPEC,
                        value: str = "forecast") -> DataFrame:
    """Cut points of the three labelling methods per series.

    ``trend_adjusted``: quartiles of history / centred 12-month mean (only full
    windows); forecasts are scored against their own mean. Fewer than 8 ratios ->
    history / trailing mean with the last-12 level. ``historical_quartiles``:
    quartiles of raw history. ``forecast_quartiles``: quartiles of the forecast.
    """
    keys = _keys(series_keys)
    w = Window.partitionBy(*keys).orderBy("date")
    centred = w.rowsBetween(-6, 5)
    level = F.when(F.count("y").over(centred) == 12, F.avg("y").over(centred))
    trailing = F.avg("y").over(w.rowsBetween(-11, 0))
    rev = Window.partitionBy(*keys).orderBy(F.col("date").desc())
    h = history.withColumns(
        {
            "_ratio": F.col("y") / F.nullif(level, F.lit(0.0)),
            "_trail": F.when(trailing > 0, F.col("y") / trailing).otherwise(F.lit(1.0)),
            "_recent": F.row_number().over(rev) <= 12,
        }
    )
    lo, hi = spec.low_quantile, spec.high_quantile
    hist = h.groupBy(*keys).agg(
        F.count("_ratio").alias("n_ratios"),
        F.percentile("_ratio", F.lit(lo)).alias("_r_lo"),
        F.percentile("_ratio", F.lit(hi)).alias("_r_hi"),
        F.percentile("_trail", F.lit(lo)).alias("_t_lo"),
        F.percentile("_trail", F.lit(hi)).alias("_t_hi"),
        F.avg(F.when(F.col("_recent"), F.col("y"))).alias("_recent_mean"),
        F.percentile("y", F.lit(lo)).alias("hist_low"),
        F.percentile("y", F.lit(hi)).alias("hist_high"),
    )
    fc = forecasts.groupBy(*keys).agg(
        F.avg(value).alias("_fc_mean"),
        F.percentile(value, F.lit(lo)).alias("fc_low"),
        F.percentile(value, F.lit(hi)).alias("fc_high"),
    )
    enough = F.col("n_ratios") >= 8
    j = keyed_join(hist, fc, keys)
    return j.select(
        *keys,
        F.when(enough, F.col("_r_lo")).otherwise(F.col("_t_lo")).alias("ta_low"),
        F.when(enough, F.col("_r_hi")).otherwise(F.col("_t_hi")).alias("ta_high"),
        F.when(enough, F.col("_fc_mean")).otherwise(F.col("_recent_mean")).alias("ta_level"),
        "n_ratios", "hist_low", "hist_high", "fc_low", "fc_high",
    )


def assign_activity_levels(forecasts: DataFrame, thresholds: DataFrame, series_keys=(), value: str = "forecast") -> DataFrame:
    """Attach the three label columns (primary = trend_adjusted)."""
    keys = _keys(series_keys)
    f = keyed_join(forecasts, thresholds, keys)
    scored = F.when(F.col("ta_level") > 0, F.col(value) / F.col("ta_level")).otherwise(F.col(value))
    return f.withColumns(
        {
            "activity_level": _label(scored, F.col("ta_low"), F.col("ta_high")),
            "activity_level_vs_history": _label(F.col(value), F.col("hist_low"), F.col("hist_high")),
            "activity_level_within_year": _label(F.col(value), F.col("fc_low"), F.col("fc_high")),
        }
    )


# --------------------------------------------------------------------------- M24
def lead_steps(last_observed: Column, year: int) -> Column:
    """Months to forecast before January of ``year`` so the whole year is covered."""
    months = (F.lit(year) - F.year(last_observed)) * 12 + (F.lit(1) - F.month(last_observed)) - 1
    return F.greatest(months, F.lit(0))


def prediction_table(labelled: DataFrame, year: int, series_keys=()) -> DataFrame:
    """Business table for the target year, by month: rounded values, labels, min-rank and share of year."""
    keys = _keys(series_keys)
    t = labelled.where(F.year("date") == year)
    pred = F.rint("forecast").cast("bigint")
    t = t.withColumn("Predicted Applications", pred)
    wk = Window.partitionBy(*keys)
    t = t.withColumns(
        {
            "rank_in_year": F.rank().over(Window.partitionBy(*keys).orderBy(F.col("Predicted Applications").desc())).cast("int"),
            "share_of_year_pct": F.col("Predicted Applications") / F.nullif(F.sum("Predicted Applications").over(wk), F.lit(0)) * 100.0,
        }
    )
    return t.select(
        *keys,
        F.date_format("date", "MMM yyyy").alias("Month"),
        "Predicted Applications",
        F.col("activity_level").alias("Activity Level"),
        F.date_format("date", "yyyy-MM-dd").alias("date"),
        F.month("date").alias("month_number"),
        F.rint("lower").cast("bigint").alias("lower_95"),
        F.rint("upper").cast("bigint").alias("upper_95"),
        "activity_level_vs_history",
        F.col("activity_level_within_year").alias(f"activity_level_within_{year}"),
        "model",
        "rank_in_year",
        "share_of_year_pct",
    ).orderBy(*keys, F.col("date"))


def prediction_summary(table: DataFrame, thresholds: DataFrame, year: int, series_keys=()) -> DataFrame:
    """One row per series: total, peak (rank 1, first by month), trough, High months, thresholds."""
    keys = _keys(series_keys)
    p = F.col("Predicted Applications")
    agg = table.groupBy(*keys).agg(
        F.sum(p).cast("bigint").alias("total_predicted_applications"),
        F.min_by("Month", F.struct(F.col("rank_in_year"), F.col("month_number"))).alias("peak_month"),
        F.max(p).alias("peak_value"),
        F.min_by("Month", F.struct(p, F.col("month_number"))).alias("trough_month"),
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.when(F.col("Activity Level") == "High", F.struct("month_number", "Month")))),
                lambda s: s["Month"],
            ),
            ", ",
        ).alias("high_activity_months"),
        F.first("model").alias("model"),
    )
    th = thresholds.select(*keys, F.col("ta_low").alias("low_threshold"), F.col("ta_high").alias("high_threshold"))
    j = keyed_join(agg, th, keys)
    return j.withColumns({"forecast_year": F.lit(year), "method": F.lit("trend_adjusted")})


# --------------------------------------------------------------------------- M25, M26, A27
def model_comparison(metrics: DataFrame, metric: str = "MAE") -> DataFrame:
    return metrics.orderBy(F.col(metric).asc(), F.col("model").asc())


def single_model_backtest(predictions: DataFrame, model: str) -> DataFrame:
    return predictions.where(F.col("model") == model).orderBy("date")


def history_forecast_union(history: DataFrame, forecasts: DataFrame, series_keys=()) -> DataFrame:
    """Actuals and forecast band in one frame with a ``kind`` column; the last actual is
    repeated as a forecast point so the plotted band joins the history line."""
    keys = _keys(series_keys)
    hist = history.select(*keys, "date", F.col("y").alias("value"), F.lit("actual").alias("kind"))
    last = history.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("date").desc()))).where("_r = 1")
    bridge = last.select(*keys, "date", F.col("y").alias("value"), F.lit("forecast").alias("kind"),
                         F.col("y").alias("lower"), F.col("y").alias("upper"))
    fc = forecasts.select(*keys, "date", F.col("forecast").alias("value"), F.lit("forecast").alias("kind"), "lower", "upper")
    return hist.unionByName(bridge, allowMissingColumns=True).unionByName(fc, allowMissingColumns=True)


def label_distribution(labelled: DataFrame) -> DataFrame:
    """Count of each label per labelling method."""
    cols = {"trend_adjusted": "activity_level", "historical_quartiles": "activity_level_vs_history",
            "forecast_quartiles": "activity_level_within_year"}
    long = labelled.select(
        F.inline(F.array(*[F.struct(F.lit(m).alias("method"), F.col(c).alias("label")) for m, c in cols.items()]))
    )
    return long.groupBy("method", "label").agg(F.count(F.lit(1)).alias("months"))
