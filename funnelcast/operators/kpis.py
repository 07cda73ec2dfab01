"""Headline KPIs and the derived facts behind the findings.

Each function takes the panel (or a report table built from it) and returns a
small DataFrame. Picks that pandas resolves with ``idxmax`` / ``iloc[0]`` (first
row in frame order) are made deterministic with ``row_number`` over the report's
own sort order plus its natural key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from funnelcast.functions.columns import safe_div
from funnelcast.operators import reports as A
from funnelcast.spec import DEFAULT_SPEC, FunnelSpec


def _pick(df: DataFrame, *order) -> DataFrame:
    """The first row of ``df`` under ``order`` (a one-row frame, no driver round trip)."""
    return df.withColumn("_rn", F.row_number().over(Window.orderBy(*order))).where("_rn = 1").drop("_rn")


# --------------------------------------------------------------------------- A14
def kpi_overview(panel: DataFrame, spec: FunnelSpec = DEFAULT_SPEC) -> DataFrame:
    """Total, monthly mean, latest YoY, peak and trough month, number of High season months."""
    t = spec.target
    monthly = panel.groupBy("date").agg(F.sum(t).cast("bigint").alias("y"))
    yearly = A.yearly_summary(panel, spec)
    latest = _pick(yearly, F.col("year").desc())
    profile = A.seasonality_profile(panel, spec)
    peak = _pick(monthly, F.col("y").desc(), F.col("date").asc())
    trough = _pick(monthly, F.col("y").asc(), F.col("date").asc())
    return monthly.agg(
        F.sum("y").cast("bigint").alias("total_applications"),
        F.avg("y").alias("avg_monthly_applications"),
        F.count(F.lit(1)).alias("months"),
    ).select(
        "*",
        latest.select("year").scalar().alias("latest_year"),
        latest.select("yoy_growth_pct").scalar().alias("latest_yoy_growth_pct"),
        peak.select(F.date_format("date", "MMM yyyy")).scalar().alias("peak_month"),
        peak.select("y").scalar().alias("peak_value"),
        trough.select(F.date_format("date", "MMM yyyy")).scalar().alias("trough_month"),
        trough.select("y").scalar().alias("trough_value"),
        profile.select(F.count_if(F.col("season_label") == "High")).scalar().alias("high_season_months"),
    )


# --------------------------------------------------------------------------- A15
def topn_share(panel: DataFrame, spec: FunnelSpec = DEFAULT_SPEC, sizes=(5, 10)) -> DataFrame:
    """Share of the target held by the top-N entities, plus the leader."""
    ent = A.entity_performance(panel, spec)
    aggs = [F.sum(F.when(F.col("rank") <= n, F.col("mc_share_pct"))).alias(f"top{n}_share_pct") for n in sizes]
    leader = ent.where("rank = 1")
    return ent.agg(*aggs, F.count(F.lit(1)).alias("n_entities")).select(
        "*",
        leader.select("entity").scalar().alias("leader"),
        leader.select(spec.target).scalar().alias("leader_applications"),
        leader.select("mc_share_pct").scalar().alias("leader_share_pct"),
    )


# --------------------------------------------------------------------------- A16
def best_conversion(panel: DataFrame, spec: FunnelSpec = DEFAULT_SPEC) -> DataFrame:
    """Entity with the highest first->realized conversion (first in volume order on ties)."""
    ent = A.entity_performance(panel, spec).where(F.col("app_to_re_pct").isNotNull())
    return _pick(ent, F.col("app_to_re_pct").desc(), F.col("rank").asc()).select(
        "entity", spec.target, spec.end_stage, "app_to_re_pct", "rank"
    )


# --------------------------------------------------------------------------- A17
def entity_topn(panel: DataFrame, n: int = 10, spec: FunnelSpec = DEFAULT_SPEC) -> DataFrame:
    """The first ``n`` rows of the entity ranking (a top-k report)."""
    return A.entity_performance(panel, spec).where(F.col("rank") <= n)


# --------------------------------------------------------------------------- A18
def cagr(panel: DataFrame, spec: FunnelSpec = DEFAULT_SPEC, min_years: int = 3) -> DataFrame:
    """Compound annual growth and total growth from the first to the last year (needs >= 3 years)."""
    yearly = A.yearly_summary(panel, spec).select("year", "total_applications")
    ends = yearly.agg(
        F.min_by("total_applications", "year").alias("first_total"),
        F.max_by("total_applications", "year").alias("last_total"),
        F.min("year").alias("first_year"),
        F.max("year").alias("last_year"),
        F.count(F.lit(1)).alias("n_years"),
    )
    span = F.col("last_year") - F.col("first_year")
    ratio = safe_div("last_total", "first_total")
    return ends.where((F.col("n_years") >= min_years) & (span > 0) & (F.col("first_total") > 0)).select(
        "first_year",
        "last_year",
        span.alias("years"),
        "first_total",
        "last_total",
        ((F.pow(ratio, F.lit(1.0) / span) - 1) * 100).alias("cagr_pct"),
        ((ratio - 1) * 100).alias("total_growth_pct"),
    )


# --------------------------------------------------------------------------- A19
def peak_season_run(panel: DataFrame, spec: FunnelSpec = DEFAULT_SPEC) -> DataFrame:
    """Longest circular run of months with seasonal index >= 1 (wraps Dec->Jan, capped at 12).

    Gaps-and-islands on the profile doubled to 24 rows; the first longest run wins.
    """
    prof = A.seasonality_profile(panel, spec).select("month", "month_name", "seasonal_index")
    doubled = prof.select("*", F.explode(F.array(F.lit(0), F.lit(12))).alias("offset")).withColumn(
        "i", F.col("month") - 1 + F.col("offset")
    )
    above = doubled.where(F.col("seasonal_index") >= 1.0)
    islands = above.withColumn("grp", F.col("i") - F.row_number().over(Window.orderBy("i")))
    runs = islands.groupBy("grp").agg(F.min("i").alias("start"), F.count(F.lit(1)).alias("raw_len"))
    runs = runs.withColumn("run_length", F.least(F.col("raw_len"), F.lit(12)))
    best = _pick(runs, F.col("run_length").desc(), F.col("start").asc())
    # month position (0-11) -> name, a 12-entry map evaluated once as a scalar subquery
    names = prof.select(F.map_from_entries(F.collect_list(F.struct(F.col("month") - 1, "month_name")))).scalar()
    strongest = _pick(prof, F.col("seasonal_index").desc(), F.col("month").asc())
    return best.select(
        F.element_at(names, F.pmod("start", F.lit(12)).cast("int")).alias("start_month"),
        F.element_at(names, F.pmod(F.col("start") + F.col("run_length") - 1, F.lit(12)).cast("int")).alias("end_month"),
        F.col("run_length").cast("bigint").alias("run_length"),
        strongest.select("month_name").scalar().alias("peak_month"),
        strongest.select("seasonal_index").scalar().alias("peak_index"),
    )


# --------------------------------------------------------------------------- A20
def trough_ratio(panel: DataFrame, spec: FunnelSpec = DEFAULT_SPEC) -> DataFrame:
    """Weakest and strongest calendar month and the ratio of their means (divisor floored at 1)."""
    prof = A.seasonality_profile(panel, spec)
    weak = _pick(prof, F.col("seasonal_index").asc(), F.col("month").asc())
    strong = _pick(prof, F.col("seasonal_index").desc(), F.col("month").asc())
    return weak.select(
        F.col("month_name").alias("weakest_month"),
        F.col("seasonal_index").alias("weakest_index"),
        strong.select("month_name").scalar().alias("strongest_month"),
        strong.select("seasonal_index").scalar().alias("strongest_index"),
        (strong.select("mean_applications").scalar() / F.greatest(F.col("mean_applications"), F.lit(1.0))).alias(
            "peak_trough_ratio"
        ),
    )


# --------------------------------------------------------------------------- A21
def funnel_bottleneck(panel: DataFrame, spec: FunnelSpec = DEFAULT_SPEC) -> DataFrame:
    """The biggest leak and the stage it leaks from."""
    f = A.funnel_overall(panel, spec)
    w = Window.orderBy("stage_order")
    f = f.withColumns(
        {
            "from_stage": F.lag("stage").over(w),
            "from_label": F.lag("stage_label").over(w),
            "from_count": F.lag("count").over(w),
        }
    )
    return f.where("is_biggest_dropoff").select(
        "from_stage", F.col("stage").alias("to_stage"), "from_label", F.col("stage_label").alias("to_label"),
        "from_count", "dropoff_count", "dropoff_pct",
    )


# --------------------------------------------------------------------------- A22
def funnel_efficiency(panel: DataFrame, spec: FunnelSpec = DEFAULT_SPEC) -> DataFrame:
    """End-to-end first->realized rate and inputs needed per output (NULL when the rate is 0)."""
    f = A.funnel_overall(panel, spec)
    rate_col = f"conversion_from_{spec.first}_pct"
    first = f.where(F.col("stage_order") == 1).select(F.col("count").alias("applications"))
    realized = f.where(F.col("stage") == spec.realized).select(F.col("count").alias("realizations"), F.col(rate_col).alias("rate"))
    return realized.select(
        first.select("applications").scalar().alias("applications"),
        "realizations",
        F.col("rate").alias("end_to_end_pct"),
        (F.lit(100.0) / F.nullif(F.col("rate"), F.lit(0.0))).alias("applications_per_realization"),
    )


# --------------------------------------------------------------------------- A23
def fastest_growing(panel: DataFrame, spec: FunnelSpec = DEFAULT_SPEC) -> DataFrame:
    """Highest first->last-year growth among entities at or above the median volume."""
    t = spec.target
    ent = A.entity_performance(panel, spec)
    median_volume = ent.select(F.median(t)).scalar()
    cand = ent.where((F.col(t) >= median_volume) & F.col("growth_pct").isNotNull())
    return _pick(cand, F.col("growth_pct").desc(), F.col("rank").asc()).select(
        "entity", "growth_pct", "growth_period", "mc_share_pct", "app_to_re_pct", t
    )


# --------------------------------------------------------------------------- A24
def programme_leaders(panel: DataFrame, spec: FunnelSpec = DEFAULT_SPEC) -> DataFrame:
    """Dominant programme (largest volume) next to the best-converting one."""
    t = spec.target
    prod = A.product_performance(panel, spec).withColumn(
        "vol_rank", F.row_number().over(Window.orderBy(F.col(t).desc(), F.col("programme").asc()))
    )
    dominant = prod.where("vol_rank = 1")
    efficient = _pick(prod.where(F.col("app_to_re_pct").isNotNull()), F.col("app_to_re_pct").desc(), F.col("vol_rank").asc())
    return dominant.select(
        F.col("programme").alias("dominant_programme"),
        F.col("mc_share_pct").alias("dominant_share_pct"),
        F.col("peak_month").alias("dominant_peak_month"),
        F.col("app_to_re_pct").alias("dominant_app_to_re_pct"),
        efficient.select("programme").scalar().alias("efficient_programme"),
        efficient.select("app_to_re_pct").scalar().alias("efficient_app_to_re_pct"),
    )


# --------------------------------------------------------------------------- A25
def latest_growth(panel: DataFrame, spec: FunnelSpec = DEFAULT_SPEC) -> DataFrame:
    """Latest year against the one before (needs two years)."""
    yearly = A.yearly_summary(panel, spec)
    w = Window.orderBy(F.col("year").desc())
    ranked = yearly.withColumn("_r", F.row_number().over(w))
    prev = ranked.where("_r = 2")
    return ranked.where("_r = 1").select(
        F.col("year").alias("latest_year"),
        prev.select("year").scalar().alias("previous_year"),
        F.col("total_applications").alias("latest_total"),
        prev.select("total_applications").scalar().alias("previous_total"),
        F.col("yoy_growth_pct").alias("growth_pct"),
        F.col("avg_monthly_applications").alias("latest_avg_monthly"),
    ).where(F.col("previous_year").isNotNull())


# --------------------------------------------------------------------------- A14 (forecast side)
def kpi_forecast(table: DataFrame, panel: DataFrame, spec: FunnelSpec = DEFAULT_SPEC) -> DataFrame:
    """Forecast-year KPIs: total, change vs the last observed year, peak / trough month, High months."""
    pred = F.col("Predicted Applications")
    yearly = A.yearly_summary(panel, spec)
    last = _pick(yearly, F.col("year").desc())
    base = last.select("total_applications").scalar()
    return table.agg(
        F.sum(pred).cast("bigint").alias("forecast_total"),
        F.min_by("Month", F.struct(-pred, F.col("month_number"))).alias("peak_month"),
        F.max(pred).alias("peak_value"),
        F.min_by("Month", F.struct(pred, F.col("month_number"))).alias("trough_month"),
        F.count_if(F.col("Activity Level") == "High").alias("high_months"),
    ).select(
        "*",
        last.select("year").scalar().alias("last_year"),
        base.alias("last_year_total"),
        ((F.col("forecast_total") - base) / F.nullif(base.cast("double"), F.lit(0.0)) * 100.0).alias("change_vs_last_year_pct"),
    )
