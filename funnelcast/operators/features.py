"""Leakage-free monthly features (F1-F16) as window passes over series frames.

A *series frame* is ``(series_keys..., date, y)`` with one row per month. Every
operator partitions its windows by ``series_keys``, so a fleet of thousands of
series is spread over the cluster; an empty key list is the one total series.

Leakage is impossible by construction: every history frame ends at ``-1``
(``rowsBetween(-k, -1)``), i.e. a feature for month *t* only reads rows with
date < *t*. The same window expressions serve training rows and future rows
(rows whose ``y`` is still NULL), so training and serving share one code path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from funnelcast.functions import vocab
from funnelcast.functions.columns import literal_map, safe_div
from funnelcast.spec import DEFAULT_SPEC, FunnelSpec

TIME_FEATURES = (
    "year", "month", "quarter", "season_code", "month_index", "month_sin", "month_cos", "month_sin2",
    "month_cos2", "is_break_season", "is_exam_season", "is_semester_start", "is_year_end", "days_in_month",
)
HISTORY_FEATURES = (
    "lag_1", "lag_2", "lag_3", "lag_6", "lag_12",
    "roll_mean_3", "roll_std_3", "roll_mean_6", "roll_std_6", "roll_mean_12", "roll_std_12",
    "roll_max_12", "roll_min_12", "mom_growth", "yoy_growth", "lag1_over_lag12", "lag1_over_roll12",
    "trend_slope_6", "same_month_mean",
)
OPERATIONAL_FEATURES = vocab.OPERATIONAL_FEATURES
FEATURE_COLUMNS = TIME_FEATURES + HISTORY_FEATURES + OPERATIONAL_FEATURES


def _keys(series_keys) -> list[str]:
    return list(series_keys or ())


def _w(series_keys) -> Window:
    return Window.partitionBy(*_keys(series_keys)).orderBy("date")


# --------------------------------------------------------------------------- series
def target_series(panel: DataFrame, spec: FunnelSpec = DEFAULT_SPEC, series_keys=()) -> DataFrame:
    """``(keys..., date, y)``: the target summed per series and month."""
    keys = _keys(series_keys)
    return panel.groupBy(*keys, "date").agg(F.sum(spec.target).cast("double").alias("y"))


# --------------------------------------------------------------------------- F3
def densify_monthly(series: DataFrame, series_keys=(), value: str = "y") -> DataFrame:
    """Complete month grid per series (its own min..max), gaps linearly interpolated.

    Interior gaps only (the grid spans the series' own first..last month), so the
    back/forward fill of the source never triggers. Adds ``interpolated``.
    """
    keys = _keys(series_keys)
    bounds = series.groupBy(*keys).agg(F.min("date").alias("_s"), F.max("date").alias("_e"))
    grid = bounds.select(*keys, F.explode(F.sequence("_s", "_e", F.expr("INTERVAL 1 MONTH"))).alias("date"))
    joined = grid.join(series, [*keys, "date"], "left")
    w = _w(keys)
    rn = F.row_number().over(w)
    joined = joined.withColumn("_rn", rn)
    known_rn = F.when(F.col(value).isNotNull(), F.col("_rn"))
    back = w.rowsBetween(Window.unboundedPreceding, 0)
    fwd = w.rowsBetween(0, Window.unboundedFollowing)
    j = joined.withColumns(
        {
            "_pv": F.last(value, ignorenulls=True).over(back),
            "_pi": F.last(known_rn, ignorenulls=True).over(back),
            "_nv": F.first(value, ignorenulls=True).over(fwd),
            "_ni": F.first(known_rn, ignorenulls=True).over(fwd),
        }
    )
    span = F.col("_ni") - F.col("_pi")
    interp = F.col("_pv") + (F.col("_nv") - F.col("_pv")) * (F.col("_rn") - F.col("_pi")) / F.nullif(span, F.lit(0))
    filled = F.coalesce(F.col(value).cast("double"), interp, F.col("_nv"), F.col("_pv"))
    return j.select(*keys, "date", filled.alias(value), F.col(value).isNull().alias("interpolated"))


# --------------------------------------------------------------------------- F1, F2
def time_features(frame: DataFrame, series_keys=()) -> DataFrame:
    """Calendar features; ``month_index`` counts months since the series' first month."""
    keys = _keys(series_keys)
    d = F.col("date")
    m = F.month(d)
    origin = F.min("date").over(Window.partitionBy(*keys)) if keys else F.min("date").over(Window.partitionBy())
    season_code = F.element_at(
        literal_map({k: vocab.SEASON_CODES[v] for k, v in vocab.SEASON_BY_MONTH.items()}), m
    )
    two_pi_m = F.lit(2.0 * 3.141592653589793) * m / F.lit(12.0)
    four_pi_m = F.lit(4.0 * 3.141592653589793) * m / F.lit(12.0)
    flag = lambda months: F.when(m.isin(*months), 1.0).otherwise(0.0)
    return frame.withColumns(
        {
            "year": F.year(d).cast("double"),
            "month": m.cast("double"),
            "quarter": F.quarter(d).cast("double"),
            "season_code": season_code.cast("double"),
            "month_index": ((F.year(d) - F.year(origin)) * 12 + (m - F.month(origin))).cast("double"),
            "month_sin": F.sin(two_pi_m),
            "month_cos": F.cos(two_pi_m),
            "month_sin2": F.sin(four_pi_m),
            "month_cos2": F.cos(four_pi_m),
            "is_break_season": flag(vocab.BREAK_MONTHS),
            "is_exam_season": flag(vocab.EXAM_MONTHS),
            "is_semester_start": flag(vocab.SEMESTER_START_MONTHS),
            "is_year_end": F.when(m == 12, 1.0).otherwise(0.0),
            "days_in_month": F.dayofmonth(F.last_day(d)).cast("double"),
        }
    )


# --------------------------------------------------------------------------- F4 - F10
def _history_columns(series_keys, y: str = "y") -> dict[str, Column]:
    w = _w(series_keys)
    cols: dict[str, Column] = {f"lag_{k}": F.lag(y, k).over(w) for k in vocab.LAG_MONTHS}
    for k in vocab.ROLLING_WINDOWS:
        frame = w.rowsBetween(-k, -1)
        cols[f"roll_mean_{k}"] = F.avg(y).over(frame)
        cols[f"roll_std_{k}"] = F.when(F.count(y).over(frame) > 1, F.stddev_samp(y).over(frame)).otherwise(0.0)
    last12 = w.rowsBetween(-12, -1)
    cols["roll_max_12"] = F.max(y).over(last12)
    cols["roll_min_12"] = F.min(y).over(last12)
    last6 = w.rowsBetween(-6, -1)
    rn = F.row_number().over(w).cast("double")
    cols["_rn"] = rn
    cols["_lag_13"] = F.lag(y, 13).over(w)
    cols["_n6"] = F.count(y).over(last6)
    month_w = Window.partitionBy(*_keys(series_keys), F.month("date")).orderBy("date").rowsBetween(
        Window.unboundedPreceding, -1
    )
    cols["same_month_mean"] = F.avg(y).over(month_w)
    return cols


def history_features(series: DataFrame, series_keys=(), y: str = "y") -> DataFrame:
    """Lags, trailing rolling stats, growth ratios, 6-month slope, same-month mean (prior rows only).

    Expects a dense series (run :func:`densify_monthly` first) so row lags are calendar lags.
    """
    w = _w(series_keys)
    df = series.withColumns(_history_columns(series_keys, y))
    growth = lambda a, b: F.coalesce((F.col(a) - F.col(b)) / F.nullif(F.col(b), F.lit(0.0)) * 100.0, F.lit(0.0))
    ratio = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0.0)), F.lit(1.0))
    df = df.withColumns(
        {
            "mom_growth": growth("lag_1", "lag_2"),
            "yoy_growth": growth("lag_1", "_lag_13"),
            "lag1_over_lag12": ratio("lag_1", "lag_12"),
            "lag1_over_roll12": ratio("lag_1", "roll_mean_12"),
            # least-squares slope is shift invariant, so the row number is a valid x
            "trend_slope_6": F.when(
                F.col("_n6") >= 3, F.regr_slope(F.col(y), F.col("_rn")).over(w.rowsBetween(-6, -1))
            ).otherwise(0.0),
        }
    )
    return df.drop("_rn", "_lag_13", "_n6")


# --------------------------------------------------------------------------- F11 - F15
def operational_features(
    panel: DataFrame, spec: FunnelSpec = DEFAULT_SPEC, series_keys=(), share_direction: str = "outgoing",
    share_product: str | None = None,
) -> DataFrame:
    """Monthly operational context per series, already lagged one month (state entering month t).

    One grouped pass per (keys, date) for ratios and mixes (conditional sums
    replace the pivots); entity concentration (HHI) and active entities come from
    a (keys, date, entity) pass. The lag is positional over the months the panel has.
    """
    keys = _keys(series_keys)
    t = spec.target
    by_month = panel.groupBy(*keys, "date").agg(
        F.sum(t).alias("_t"),
        F.sum(spec.realized).alias("_re"),
        F.sum("ACH" if "ACH" in spec.stages else spec.stages[1]).alias("_ach"),
        F.sum(F.when(F.col("direction") == share_direction, F.col(t)).otherwise(0)).alias("_dir"),
        F.sum(F.when(F.col("product") == (share_product or spec.share_product), F.col(t)).otherwise(0)).alias("_prod"),
    )
    ent = panel.groupBy(*dict.fromkeys([*keys, "entity"]), "date").agg(F.sum(t).alias("_x"))
    share = F.col("_x") / F.nullif(F.sum("_x").over(Window.partitionBy(*keys, "date")), F.lit(0))
    conc = ent.withColumn("_share", share.cast("double")).groupBy(*keys, "date").agg(
        F.coalesce(F.sum(F.pow("_share", 2)), F.lit(0.0)).alias("op_entity_hhi"),
        F.nullif(F.count_distinct(F.when(F.col("_x") > 0, F.col("entity"))), F.lit(0)).cast("double").alias("op_active_entities"),
    )
    cur = by_month.join(conc, [*keys, "date"]).select(
        *keys,
        "date",
        (safe_div("_re", "_t") * 100.0).alias("op_app_to_re_pct"),
        (safe_div("_ach", "_t") * 100.0).alias("op_app_to_ach_pct"),
        F.col("_re").cast("double").alias("op_realizations"),
        (safe_div("_dir", "_t") * 100.0).alias("op_outgoing_share"),
        (safe_div("_prod", "_t") * 100.0).alias("op_gv_share"),
        "op_entity_hhi",
        "op_active_entities",
    )
    w = _w(keys)
    return cur.select(*keys, "date", *[F.lag(c, 1).over(w).alias(c) for c in OPERATIONAL_FEATURES])


# --------------------------------------------------------------------------- F16
def training_matrix(
    panel: DataFrame, spec: FunnelSpec = DEFAULT_SPEC, series_keys=(), min_history_months: int = 12,
    share_product: str | None = None,
) -> DataFrame:
    """``(keys..., date, y, 40 features)`` per series, warm-up rows dropped.

    Series are densified first (the source does not; see SURVEY D6). A series
    with no more than ``min_history_months`` months contributes no rows.
    """
    keys = _keys(series_keys)
    series = densify_monthly(target_series(panel, spec, keys), keys).drop("interpolated")
    feats = history_features(time_features(series, keys), keys)
    ops = operational_features(panel, spec, keys, share_product=share_product)
    joined = feats.join(ops, [*keys, "date"], "left")
    rn = F.row_number().over(_w(keys))
    out = joined.withColumn("_rn", rn).where(F.col("_rn") > min_history_months).drop("_rn")
    return out.select(*keys, "date", "y", *FEATURE_COLUMNS)


def _pearson(x: Column, y: Column) -> Column:
    """Pearson correlation over the rows that have both; NaN where either is constant (or one row), NULL without rows.

    ``F.corr`` divides by the product of the deviations, which ANSI mode turns into an error at zero. Constancy is
    read from the extremes: deviations merged from several tasks need not come out as exactly zero.
    """
    px, py = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    varies = (F.min(px) < F.max(px)) & (F.min(py) < F.max(py))
    r = F.try_divide(F.covar_pop(px, py), F.stddev_pop(px) * F.stddev_pop(py))
    return F.when(F.count(px) > 0, F.coalesce(F.when(varies, r), F.lit(float("nan"))))


def feature_correlation(matrix: DataFrame, features=FEATURE_COLUMNS, y: str = "y") -> DataFrame:
    """Pearson correlation of each feature with the target, ordered by absolute value; undefined ones last.

    One aggregate computes every correlation in a single pass; the row is unpivoted.
    """
    row = matrix.agg(*[_pearson(F.col(f).cast("double"), F.col(y).cast("double")).alias(f) for f in features])
    long = row.select(
        F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("correlation")) for f in features]))
    )
    return long.withColumn("abs_correlation", F.abs("correlation")).orderBy(
        F.when(~F.isnan("abs_correlation"), F.col("abs_correlation")).desc_nulls_last(), F.col("feature")
    )
