"""Report aggregations over a panel (trend, seasonality, funnel, entity, product).

Every function is ``(panel, spec) -> DataFrame`` and lazy. Values come back
unrounded; :func:`funnelcast.plans.analysis.report_tables` applies the report
rounding. Scale notes:

* Every report first aggregates the panel to its own grain (month, year, entity,
  programme). Those grains are bounded by the calendar and the dimension
  vocabularies, not by the raw row count, so the ordered windows that follow
  (lag, rolling, running sums) run on a few hundred rows.
* Shares of a grand total use a scalar subquery (``DataFrame.scalar``), computed
  once and inlined, rather than an unpartitioned window or a cross join.
* Ties that pandas resolves by frame order (``idxmax``) are resolved explicitly
  with ``row_number`` and the natural key as second sort column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from funnelcast.functions.columns import (
    growth_pct,
    month_abbr_of_number,
    month_name,
    pct,
    safe_div,
    with_calendar,
)
from funnelcast.functions.vocab import MONTH_ABBR
from funnelcast.spec import DEFAULT_SPEC, FunnelSpec


def _stage_sums(spec: FunnelSpec, stages=None):
    return [F.sum(s).cast("bigint").alias(s) for s in (stages or spec.stages)]


def _first_by(partition, order_desc, tiebreak):
    return Window.partitionBy(*partition).orderBy(F.col(order_desc).desc(), F.col(tiebreak).asc())


# --------------------------------------------------------------------------- A1
def monthly_series(panel: DataFrame, spec: FunnelSpec = DEFAULT_SPEC) -> DataFrame:
    """Stage totals per month plus calendar columns (no densification, as in the source)."""
    monthly = panel.groupBy("date").agg(*_stage_sums(spec))
    return with_calendar(monthly).select("date", *spec.stages, "year", "month", "month_name", "quarter")


# --------------------------------------------------------------------------- A2
def monthly_trend(panel: DataFrame, spec: FunnelSpec = DEFAULT_SPEC) -> DataFrame:
    """Monthly totals with MoM / YoY growth, trailing 3/12-month means, running total, realised share."""
    t = spec.target
    w = Window.orderBy("date")
    monthly = panel.groupBy("date").agg(*_stage_sums(spec))
    out = with_calendar(monthly).drop("quarter").withColumns(
        {
            "period": F.date_format("date", "yyyy-MM"),
            "mom_growth_pct": growth_pct(F.col(t), F.lag(t, 1).over(w)),
            "yoy_growth_pct": growth_pct(F.col(t), F.lag(t, 12).over(w)),
            "rolling_3m": F.avg(t).over(w.rowsBetween(-2, 0)),
            "rolling_12m": F.avg(t).over(w.rowsBetween(-11, 0)),
            f"cumulative_{t}": F.sum(t).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("bigint"),
            "app_to_re_pct": F.when(F.col(spec.first) > 0, pct(spec.end_stage, spec.first)),
        }
    )
    return out


# --------------------------------------------------------------------------- A3
def yearly_summary(panel: DataFrame, spec: FunnelSpec = DEFAULT_SPEC) -> DataFrame:
    """Two-level aggregate month -> year with YoY growth and the peak month's name."""
    t = spec.target
    monthly = panel.groupBy("year", "date").agg(*_stage_sums(spec, [t, spec.end_stage] if spec.end_stage != t else [t]))
    peak = (
        monthly.withColumn("rn", F.row_number().over(_first_by(["year"], t, "date")))
        .where("rn = 1")
        .select("year", month_name("date").alias("peak_month"))
    )
    summary = monthly.groupBy("year").agg(
        F.sum(t).cast("bigint").alias("total_applications"),
        F.avg(t).alias("avg_monthly_applications"),
        F.max(t).alias("peak_month_applications"),
        F.min(t).alias("min_month_applications"),
        F.stddev_samp(t).alias("std_monthly_applications"),
        F.count(t).alias("months_observed"),
        F.sum(spec.end_stage).cast("bigint").alias("total_realizations"),
    )
    w = Window.orderBy("year")
    summary = summary.withColumns(
        {
            "app_to_re_pct": pct("total_realizations", "total_applications"),
            "yoy_growth_pct": growth_pct(F.col("total_applications"), F.lag("total_applications", 1).over(w)),
        }
    )
    return summary.join(peak, "year", "left").orderBy("year")


# --------------------------------------------------------------------------- A4
def seasonality_profile(panel: DataFrame, spec: FunnelSpec = DEFAULT_SPEC) -> DataFrame:
    """Per calendar month: mean/median/std/min/max/n, seasonal index and High/Medium/Low label."""
    t = spec.target
    monthly = panel.groupBy("date").agg(F.sum(t).alias("y")).withColumns(
        {"month": F.month("date"), "month_name": month_name("date")}
    )
    overall_mean = monthly.select(F.avg("y")).scalar()
    profile = monthly.groupBy("month", "month_name").agg(
        F.avg("y").alias("mean_applications"),
        F.median("y").alias("median_applications"),
        F.stddev_samp("y").alias("std_applications"),
        F.min("y").cast("bigint").alias("min_applications"),
        F.max("y").cast("bigint").alias("max_applications"),
        F.count("y").alias("observations"),
    )
    # the quartiles of the (at most 12) monthly means, as scalar subqueries
    cuts = profile.select(
        F.percentile("mean_applications", F.lit(spec.low_quantile)).alias("low_q"),
        F.percentile("mean_applications", F.lit(spec.high_quantile)).alias("high_q"),
    )
    low_q = cuts.select("low_q").scalar()
    high_q = cuts.select("high_q").scalar()
    return profile.withColumns(
        {
            "seasonal_index": safe_div(F.col("mean_applications"), overall_mean),
            "season_label": F.when(F.col("mean_applications") >= high_q, "High")
            .when(F.col("mean_applications") <= low_q, "Low")
            .otherwise("Medium"),
        }
    ).orderBy("month")


# --------------------------------------------------------------------------- A5
def peak_months(panel: DataFrame, top_n: int = 5, spec: FunnelSpec = DEFAULT_SPEC) -> DataFrame:
    """Top-N months by volume; ``rank`` is min-rank, cut ties by earlier month."""
    t = spec.target
    monthly = panel.groupBy("date").agg(F.sum(t).cast("bigint").alias("applications"))
    ranked = monthly.withColumns(
        {
            "rank": F.rank().over(Window.orderBy(F.col("applications").desc())),
            "month": F.date_format("date", "MMM yyyy"),
        }
    )
    return ranked.orderBy(F.col("applications").desc(), F.col("date").asc()).limit(top_n).select(
        F.col("rank").cast("int").alias("rank"), "month", "applications"
    )


# --------------------------------------------------------------------------- A6
def funnel_overall(panel: DataFrame, spec: FunnelSpec = DEFAULT_SPEC) -> DataFrame:
    """One row per stage: count, conversions, drop-off and the single biggest leak."""
    totals = panel.agg(*_stage_sums(spec))
    rows = F.array(
        *[
            F.struct(
                F.lit(i + 1).alias("stage_order"),
                F.lit(s).alias("stage"),
                F.lit(spec.label(s)).alias("stage_label"),
                F.coalesce(F.col(s), F.lit(0).cast("bigint")).alias("count"),
            )
            for i, s in enumerate(spec.stages)
        ]
    )
    first_total = F.coalesce(F.col(spec.first), F.lit(0).cast("bigint"))
    long = totals.select(first_total.alias("top"), F.inline(rows))
    w = Window.orderBy("stage_order")
    prev = F.lag("count", 1).over(w)
    long = long.withColumn("prev", prev)
    has_prev = F.col("prev").isNotNull() & (F.col("prev") != 0)
    out = long.withColumns(
        {
            "conversion_from_previous_pct": F.when(has_prev, F.col("count") / F.col("prev") * 100.0).otherwise(100.0),
            f"conversion_from_{spec.first}_pct": F.col("count")
            / F.when(F.col("top") == 0, F.lit(1)).otherwise(F.col("top"))
            * 100.0,
            "dropoff_count": F.coalesce(F.col("prev") - F.col("count"), F.lit(0).cast("bigint")),
            "dropoff_pct": F.when(has_prev, (F.col("prev") - F.col("count")) / F.col("prev") * 100.0).otherwise(0.0),
        }
    )
    # rank the transitions (stage 2 onwards) by lost volume; the first stage never leaks
    leak_order = Window.orderBy((F.col("stage_order") > 1).desc(), F.col("dropoff_count").desc(), F.col("stage_order").asc())
    out = out.withColumn(
        "is_biggest_dropoff", (F.col("stage_order") > 1) & (F.row_number().over(leak_order) == 1)
    )
    return out.select(
        "stage_order",
        "stage",
        "stage_label",
        "count",
        "conversion_from_previous_pct",
        f"conversion_from_{spec.first}_pct",
        "dropoff_count",
        "dropoff_pct",
        "is_biggest_dropoff",
    ).orderBy("stage_order")


# --------------------------------------------------------------------------- A7
def funnel_by_dimension(panel: DataFrame, dimension: str, spec: FunnelSpec = DEFAULT_SPEC) -> DataFrame:
    """Stage totals and step / end-to-end rates per value of ``dimension``."""
    if dimension not in panel.columns:
        raise KeyError(f"no dimension {dimension!r} in the panel; it has {', '.join(panel.columns)}")
    stages = list(spec.stages)
    grouped = panel.groupBy(dimension).agg(*_stage_sums(spec))
    rates = {f"conv_{a}_to_{b}_pct": pct(b, a) for a, b in zip(stages, stages[1:])}
    if spec.realized in stages:
        rates["app_to_re_pct"] = pct(spec.realized, spec.first)
    if spec.completed in stages:
        rates["app_to_co_pct"] = pct(spec.completed, spec.first)
    return grouped.withColumns(rates).orderBy(F.col(spec.first).desc(), F.col(dimension).asc())


# --------------------------------------------------------------------------- growth helper
def _first_last_year_growth(panel: DataFrame, key: str, t: str) -> tuple[DataFrame, F.Column, F.Column]:
    """Per-key growth from the panel's first to last year (NULL when either side is missing or 0)."""
    years = panel.select(F.min("year").alias("y0"), F.max("year").alias("y1"))
    y0 = years.select("y0").scalar()
    y1 = years.select("y1").scalar()
    per_key = panel.groupBy(key).agg(
        F.sum(F.when(F.col("year") == y0, F.col(t))).alias("first_year_total"),
        F.sum(F.when(F.col("year") == y1, F.col(t))).alias("last_year_total"),
    )
    growth = per_key.select(
        key,
        F.when(y1 > y0, pct(F.col("last_year_total") - F.col("first_year_total"), "first_year_total")).alias("growth_pct"),
    )
    return growth, y0, y1


# --------------------------------------------------------------------------- A8
def entity_performance(panel: DataFrame, spec: FunnelSpec = DEFAULT_SPEC) -> DataFrame:
    """Rank entities by volume with share, conversion, consistency (CV) and growth."""
    t = spec.target
    totals = panel.groupBy("entity").agg(*_stage_sums(spec))
    grand = panel.select(F.sum(t)).scalar()
    monthly = panel.groupBy("entity", "date").agg(F.sum(t).alias("y"))
    stability = monthly.groupBy("entity").agg(
        F.avg("y").alias("avg_monthly_applications"), F.stddev_samp("y").alias("std_y")
    ).withColumn("consistency_cv", safe_div("std_y", "avg_monthly_applications")).drop("std_y")
    growth, y0, y1 = _first_last_year_growth(panel, "entity", t)
    out = (
        totals.withColumns(
            {
                "mc_share_pct": pct(F.col(t), grand),
                "app_to_re_pct": pct(spec.end_stage, t),
            }
        )
        .join(stability, "entity", "left")
        .join(growth, "entity", "left")
        .withColumn(
            "growth_period",
            F.when(y1 > y0, F.concat(y0.cast("string"), F.lit("->"), y1.cast("string"))),
        )
    )
    out = out.withColumn("rank", F.row_number().over(Window.orderBy(F.col(t).desc(), F.col("entity").asc())))
    return out.select("rank", "entity", *spec.stages, "mc_share_pct", "app_to_re_pct", "avg_monthly_applications",
                      "consistency_cv", "growth_pct", "growth_period").orderBy("rank")


# --------------------------------------------------------------------------- A9
def product_performance(panel: DataFrame, spec: FunnelSpec = DEFAULT_SPEC) -> DataFrame:
    """Per programme: totals, share, conversion, strongest calendar month (by sum) and growth."""
    t = spec.target
    totals = panel.groupBy("programme", "product", "direction").agg(*_stage_sums(spec))
    grand = panel.select(F.sum(t)).scalar()
    by_month = panel.groupBy("programme", "month").agg(F.sum(t).alias("y"))
    peak = (
        by_month.withColumn("rn", F.row_number().over(_first_by(["programme"], "y", "month")))
        .where("rn = 1")
        .select("programme", month_abbr_of_number("month").alias("peak_month"))
    )
    growth, _, _ = _first_last_year_growth(panel, "programme", t)
    out = (
        totals.withColumns({"mc_share_pct": pct(F.col(t), grand), "app_to_re_pct": pct(spec.end_stage, t)})
        .join(peak, "programme", "left")
        .join(growth, "programme", "left")
    )
    return out.orderBy(F.col(t).desc(), F.col("programme").asc())


# --------------------------------------------------------------------------- A10
def monthly_contribution(panel: DataFrame, spec: FunnelSpec = DEFAULT_SPEC) -> DataFrame:
    """Each (year, month) as a share of its year, deviation from an even split, rank in year."""
    t = spec.target
    monthly = panel.groupBy("year", "month").agg(F.sum(t).cast("bigint").alias(t))
    wy = Window.partitionBy("year")
    out = monthly.withColumns(
        {
            "month_name": month_abbr_of_number("month"),
            "contribution_pct": pct(F.col(t), F.sum(t).over(wy)),
        }
    )
    out = out.withColumns(
        {
            "vs_even_split_pp": F.col("contribution_pct") - F.lit(100.0 / 12.0),
            "rank_in_year": F.rank().over(Window.partitionBy("year").orderBy(F.col(t).desc())).cast("int"),
        }
    )
    return out.orderBy("year", "month")


# --------------------------------------------------------------------------- A11
def contribution_matrix(panel: DataFrame, spec: FunnelSpec = DEFAULT_SPEC) -> DataFrame:
    """Year x calendar-month matrix of contribution shares (columns Jan..Dec)."""
    contrib = monthly_contribution(panel, spec)
    return contrib.groupBy("year").agg(
        *[F.max(F.when(F.col("month") == i + 1, F.col("contribution_pct"))).alias(m) for i, m in enumerate(MONTH_ABBR)]
    ).orderBy("year")


# --------------------------------------------------------------------------- A12
def year_overlay(panel: DataFrame, spec: FunnelSpec = DEFAULT_SPEC, years=None) -> DataFrame:
    """Calendar month x year of the target, one column per year (for overlaid yearly curves).

    ``years`` may be given, then a row of any other year is an error; otherwise the distinct
    years are read from the panel (a bounded list: one value per calendar year).
    """
    t = spec.target
    if years is not None:
        outside = F.raise_error(F.concat(F.lit("a year outside the overlay: "), F.col("year").cast("string")))
        panel = panel.withColumn("year", F.when(F.col("year").isin(*years), F.col("year")).otherwise(outside.cast("int")))
    monthly = panel.groupBy("year", "month").agg(F.sum(t).cast("bigint").alias("y"))
    pivoted = monthly.groupBy("month").pivot("year", list(years) if years is not None else None)
    return pivoted.agg(F.first("y")).orderBy("month")
