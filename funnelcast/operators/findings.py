"""Generated findings (I1-I14): one-row DataFrames of templated text, unioned in a fixed order.

Every finding is computed from the report / KPI / forecast frames with
``format_string`` and ``format_number`` — JVM-side, no collect. A generator
whose inputs do not qualify yields zero rows and simply drops out, as in the
source. Output: ``(order_no, category, headline, detail, kind)``. The forecast
year in the text comes from the data (the source hard-codes it, SURVEY D11).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from funnelcast.operators import kpis as K
from funnelcast.operators import reports as A
from funnelcast.spec import DEFAULT_SPEC, FunnelSpec

COLUMNS = ("order_no", "category", "headline", "detail", "kind")


def _n0(c: Column) -> Column:
    return F.format_number(F.col(c) if isinstance(c, str) else c, 0)


def _p1(c) -> Column:
    return F.format_string("%.1f", F.col(c) if isinstance(c, str) else c)


def _p0(c) -> Column:
    return F.format_string("%.0f", F.col(c) if isinstance(c, str) else c)


def _row(df: DataFrame, order_no: int, category: str, headline: Column, detail: Column, kind: Column | str) -> DataFrame:
    k = F.lit(kind) if isinstance(kind, str) else kind
    return df.select(F.lit(order_no).alias("order_no"), F.lit(category).alias("category"),
                     headline.alias("headline"), detail.alias("detail"), k.alias("kind"))


def _join_list(months: Column) -> Column:
    """``a, b and c`` from an ordered array of names."""
    n = F.size(months)
    head = F.array_join(F.slice(months, 1, F.greatest(n - 1, F.lit(1))), ", ")
    return F.when(n <= 1, F.element_at(months, 1)).otherwise(F.concat(head, F.lit(" and "), F.element_at(months, -1)))


# --------------------------------------------------------------------------- I1 - I4: forecast
def forecast_peak(table: DataFrame) -> DataFrame:
    peak = table.withColumn("_r", F.row_number().over(Window.orderBy(F.col("Predicted Applications").desc(), "month_number")))
    peak = peak.where("_r = 1")
    return _row(peak, 1, "Forecast",
                F.concat(F.col("Month"), F.lit(" is the busiest forecast month, with "), _n0("Predicted Applications"), F.lit(" applications.")),
                F.concat(F.lit("It carries "), _p1("share_of_year_pct"), F.lit("% of the forecast year; the 95% band runs from "),
                         _n0("lower_95"), F.lit(" to "), _n0("upper_95"), F.lit(".")),
                "positive")


def forecast_high_months(table: DataFrame) -> DataFrame:
    agg = table.agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("Activity Level") == "High", F.struct("month_number", "Month")))),
                    lambda s: s["Month"]).alias("months"),
        F.sum(F.when(F.col("Activity Level") == "High", F.col("share_of_year_pct"))).alias("share"),
        F.count(F.lit(1)).alias("_n"),
    ).where(F.col("_n") > 0)
    none = F.size("months") == 0
    return _row(agg, 2, "Forecast",
                F.when(none, F.lit("No forecast month reaches the high-activity band."))
                .otherwise(F.concat(F.size("months").cast("string"), F.lit(" high-activity month(s) ahead: "), _join_list(F.col("months")), F.lit("."))),
                F.when(none, F.lit("Forecast volume stays inside the usual seasonal range all year."))
                .otherwise(F.concat(F.lit("Together they hold "), _p0("share"), F.lit("% of forecast volume; capacity should be in place before them."))),
                F.when(none, F.lit("neutral")).otherwise(F.lit("positive")))


def forecast_vs_last_year(table: DataFrame, yearly: DataFrame) -> DataFrame:
    last = yearly.withColumn("_r", F.row_number().over(Window.orderBy(F.col("year").desc()))).where("_r = 1")
    fc = table.agg(F.sum("Predicted Applications").alias("fc_total"), F.count(F.lit(1)).alias("fc_months"),
                   F.max(F.year(F.to_date("date"))).alias("fc_year"))
    j = fc.select("*", last.select("year").scalar().alias("year"), last.select("total_applications").scalar().alias("base"))
    j = j.where((F.col("base") > 0) & (F.col("fc_months") > 0))
    growth = (F.col("fc_total") - F.col("base")) / F.col("base") * 100
    j = j.withColumn("_g", growth)
    return _row(j, 3, "Forecast",
                F.concat(F.lit("The "), F.col("fc_year").cast("string"), F.lit(" forecast totals "), _n0("fc_total"), F.lit(", "),
                         _p1(F.abs(F.col("_g"))), F.lit("% "), F.when(F.col("_g") >= 0, "above").otherwise("below"), F.lit(" "),
                         F.col("year").cast("string"), F.lit(".")),
                F.concat(F.col("year").cast("string"), F.lit(" closed at "), _n0("base"), F.lit("; the forecast averages "),
                         _n0(F.col("fc_total") / F.col("fc_months")), F.lit(" a month.")),
                F.when(F.col("_g") >= 0, "positive").otherwise("negative"))


def forecast_quiet_period(table: DataFrame) -> DataFrame:
    agg = table.agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("Activity Level") == "Low", F.struct("month_number", "Month")))),
                    lambda s: s["Month"]).alias("low"),
        F.min_by("Month", F.struct("Predicted Applications", "month_number")).alias("trough"),
        F.min("Predicted Applications").alias("trough_value"),
        F.count(F.lit(1)).alias("_n"),
    ).where(F.col("_n") > 0)
    none = F.size("low") == 0
    return _row(agg, 4, "Forecast",
                F.when(none, F.concat(F.col("trough"), F.lit(" is the quietest forecast month.")))
                .otherwise(F.concat(F.lit("The quietest forecast stretch is "), F.array_join("low", ", "), F.lit("."))),
                F.when(none, F.concat(F.lit("Forecast at "), _n0("trough_value"), F.lit(" applications.")))
                .otherwise(F.lit("Low delivery pressure makes these the months for training and process work.")),
                "neutral")


# --------------------------------------------------------------------------- I5 - I13: history
def latest_growth(panel: DataFrame, spec: FunnelSpec) -> DataFrame:
    g = K.latest_growth(panel, spec)
    return _row(g, 5, "Growth",
                F.concat(F.lit("Volume "), F.when(F.col("growth_pct") >= 0, "rose").otherwise("fell"), F.lit(" "),
                         _p1(F.abs(F.col("growth_pct"))), F.lit("% in "), F.col("latest_year").cast("string"),
                         F.lit(" against "), F.col("previous_year").cast("string"), F.lit(".")),
                F.concat(_n0("latest_total"), F.lit(" applications after "), _n0("previous_total"),
                         F.lit(" the year before, "), _n0("latest_avg_monthly"), F.lit(" a month on average.")),
                F.when(F.col("growth_pct") >= 0, "positive").otherwise("negative"))


def cagr(panel: DataFrame, spec: FunnelSpec) -> DataFrame:
    c = K.cagr(panel, spec)
    return _row(c, 6, "Growth",
                F.concat(F.lit("Compound annual growth was "), _p1("cagr_pct"), F.lit("% from "), F.col("first_year").cast("string"),
                         F.lit(" to "), F.col("last_year").cast("string"), F.lit(".")),
                F.concat(F.lit("Overall change "), _p0("total_growth_pct"), F.lit("% over "), F.col("years").cast("string"),
                         F.lit(" years ("), _n0("first_total"), F.lit(" to "), _n0("last_total"), F.lit(").")),
                F.when(F.col("cagr_pct") >= 0, "positive").otherwise("negative"))


def peak_season(panel: DataFrame, spec: FunnelSpec) -> DataFrame:
    r = K.peak_season_run(panel, spec)
    return _row(r, 7, "Seasonality",
                F.concat(F.lit("The strong season runs "), F.col("start_month"), F.lit(" to "), F.col("end_month"), F.lit(".")),
                F.concat(F.col("run_length").cast("string"), F.lit(" consecutive months are at or above the average month; "),
                         F.col("peak_month"), F.lit(" peaks at "), F.format_string("%.2f", "peak_index"), F.lit("x.")),
                "neutral")


def weakest_month(panel: DataFrame, spec: FunnelSpec) -> DataFrame:
    t = K.trough_ratio(panel, spec)
    return _row(t, 8, "Seasonality",
                F.concat(F.col("weakest_month"), F.lit(" is the weakest month at "), F.format_string("%.2f", "weakest_index"),
                         F.lit("x the average month.")),
                F.concat(F.col("strongest_month"), F.lit(" runs at "), _p1("peak_trough_ratio"), F.lit("x the volume of "),
                         F.col("weakest_month"), F.lit("; plan capacity for the swing, not a flat month.")),
                "neutral")


def bottleneck(panel: DataFrame, spec: FunnelSpec) -> DataFrame:
    b = K.funnel_bottleneck(panel, spec)
    return _row(b, 9, "Funnel",
                F.concat(F.lit("The largest leak is "), F.col("from_stage"), F.lit(" -> "), F.col("to_stage"), F.lit(", losing "),
                         _p0("dropoff_pct"), F.lit("%.")),
                F.concat(_n0("dropoff_count"), F.lit(" of "), _n0("from_count"), F.lit(" "), F.lower("from_label"),
                         F.lit(" never reach "), F.lower("to_label"), F.lit(".")),
                "negative")


def efficiency(panel: DataFrame, spec: FunnelSpec) -> DataFrame:
    e = K.funnel_efficiency(panel, spec)
    return _row(e, 10, "Funnel",
                F.concat(_p1("end_to_end_pct"), F.lit("% of applications end in a realization.")),
                F.concat(_n0("realizations"), F.lit(" realizations from "), _n0("applications"), F.lit(" applications: about "),
                         F.coalesce(_p0("applications_per_realization"), F.lit("n/a")), F.lit(" applications per realization.")),
                "neutral")


def concentration(panel: DataFrame, spec: FunnelSpec) -> DataFrame:
    s = K.topn_share(panel, spec).where(F.col("n_entities") >= 3)
    risky = F.col("top5_share_pct") > 60
    return _row(s, 11, "Entities",
                F.concat(F.lit("The five largest entities bring "), _p0("top5_share_pct"), F.lit("% of applications.")),
                F.concat(F.col("leader"), F.lit(" leads with "), _n0("leader_applications"), F.lit(" ("), _p1("leader_share_pct"),
                         F.lit("%) among "), F.col("n_entities").cast("string"), F.lit(" entities."),
                         F.when(risky, F.lit(" A downturn in one or two of them moves the total.")).otherwise(F.lit(""))),
                F.when(risky, "negative").otherwise("neutral"))


def fastest_growing(panel: DataFrame, spec: FunnelSpec) -> DataFrame:
    g = K.fastest_growing(panel, spec)
    return _row(g, 12, "Entities",
                F.concat(F.col("entity"), F.lit(" grew fastest among the larger entities: "),
                         F.format_string("%+.1f", "growth_pct"), F.lit("% ("), F.col("growth_period"), F.lit(").")),
                F.concat(F.lit("It holds "), _p1("mc_share_pct"), F.lit("% of applications with "),
                         _p1("app_to_re_pct"), F.lit("% reaching realization.")),
                "positive")


def programmes(panel: DataFrame, spec: FunnelSpec) -> DataFrame:
    p = K.programme_leaders(panel, spec)
    other = F.col("efficient_programme") != F.col("dominant_programme")
    return _row(p, 13, "Products",
                F.concat(F.col("dominant_programme"), F.lit(" is the largest programme with "), _p0("dominant_share_pct"),
                         F.lit("% of applications.")),
                F.concat(F.col("dominant_programme"), F.lit(" peaks in "), F.coalesce(F.col("dominant_peak_month"), F.lit("n/a")), F.lit("."),
                         F.when(other, F.concat(F.lit(" "), F.col("efficient_programme"), F.lit(" converts best: "),
                                                _p1("efficient_app_to_re_pct"), F.lit("% against "), _p1("dominant_app_to_re_pct"),
                                                F.lit("%."))).otherwise(F.lit(""))),
                "neutral")


# --------------------------------------------------------------------------- I14
def model_accuracy(selection: DataFrame) -> DataFrame:
    s = selection.where("selected")
    mape = F.col("MAPE")
    quality = F.when(mape < 10, "strong").when(mape < 20, "acceptable").otherwise("weak")
    return _row(s, 14, "Model",
                F.concat(F.lit("The chosen model ("), F.col("model"), F.lit(") scores "), _p1(F.lit(100.0) - mape),
                         F.lit("% accuracy out of sample (MAPE "), _p1("MAPE"), F.lit("%).")),
                F.concat(F.lit("Mean absolute error "), _n0("MAE"), F.lit(" a month over "), F.col("origins_evaluated").cast("string"),
                         F.lit(" origins: "), quality, F.lit(" for planning; plan on the interval, not the point.")),
                F.when(mape < 10, "positive").when(mape < 20, "neutral").otherwise("negative"))


# --------------------------------------------------------------------------- typed facts
def finding_facts(panel: DataFrame, run: dict | None = None, spec: FunnelSpec = DEFAULT_SPEC) -> DataFrame:
    """The numbers behind the findings: ``(order_no, finding, subject, value, base, unit)``, one row each, in their order.

    ``value`` is what the headline states, ``base`` the number it is read against, both as doubles; a finding whose
    inputs do not qualify has no row.
    """
    def fact(df: DataFrame, order_no: int, finding: str, subject: Column, value, base, unit: str) -> DataFrame:
        number = lambda c: (F.col(c) if isinstance(c, str) else c).cast("double")
        return df.select(F.lit(order_no).alias("order_no"), F.lit(finding).alias("finding"), subject.cast("string").alias("subject"),
                         number(value).alias("value"), number(base).alias("base"), F.lit(unit).alias("unit"))

    shares = K.topn_share(panel, spec).where(F.col("n_entities") >= 3)
    parts = [
        fact(K.latest_growth(panel, spec), 5, "latest_growth", F.col("latest_year"), "growth_pct", "previous_total", "percent"),
        fact(K.cagr(panel, spec), 6, "cagr", F.concat_ws("-", "first_year", "last_year"), "cagr_pct", "first_total", "percent"),
        fact(K.peak_season_run(panel, spec), 7, "peak_season", F.concat_ws("-", "start_month", "end_month"), "peak_index", "run_length", "index"),
        fact(K.trough_ratio(panel, spec), 8, "weakest_month", F.col("weakest_month"), "weakest_index", "peak_trough_ratio", "index"),
        fact(K.funnel_bottleneck(panel, spec), 9, "bottleneck", F.concat_ws("-", "from_stage", "to_stage"), "dropoff_pct", "from_count", "percent"),
        fact(K.funnel_efficiency(panel, spec), 10, "efficiency", F.lit("end_to_end"), "end_to_end_pct", "applications", "percent"),
        fact(shares, 11, "concentration", F.col("leader"), "top5_share_pct", "n_entities", "percent"),
        fact(K.fastest_growing(panel, spec), 12, "fastest_growing", F.col("entity"), "growth_pct", "mc_share_pct", "percent"),
        fact(K.programme_leaders(panel, spec), 13, "programmes", F.col("dominant_programme"), "dominant_share_pct", "dominant_app_to_re_pct", "percent"),
    ]
    if run is not None:
        table, p = run["table"], F.col("Predicted Applications")
        label = F.col("Activity Level")
        year = table.agg(
            F.min_by("Month", F.struct(-p, F.col("month_number"))).alias("peak"), F.max(p).alias("peak_value"),
            F.min_by("share_of_year_pct", F.struct(-p, F.col("month_number"))).alias("peak_share"),
            F.min_by("Month", F.struct(p, F.col("month_number"))).alias("trough"), F.min(p).alias("trough_value"),
            F.count_if(label == "High").alias("high"), F.count_if(label == "Low").alias("low"),
            F.coalesce(F.sum(F.when(label == "High", F.col("share_of_year_pct"))), F.lit(0.0)).alias("high_share"),
            F.sum(p).alias("total"), F.max(F.year(F.to_date("date"))).alias("fc_year"), F.count(F.lit(1)).alias("_n")).where("_n > 0")
        last = A.yearly_summary(panel, spec).orderBy(F.col("year").desc()).limit(1)
        against = year.withColumn("last_total", last.select("total_applications").scalar()).where("last_total > 0")
        growth = (F.col("total") - F.col("last_total")) / F.col("last_total") * 100
        parts += [
            fact(year, 1, "forecast_peak", F.col("peak"), "peak_value", "peak_share", "applications"),
            fact(year, 2, "forecast_high_months", F.col("fc_year"), "high_share", "high", "percent"),
            fact(against, 3, "forecast_vs_last_year", F.col("fc_year"), growth, "last_total", "percent"),
            fact(year, 4, "forecast_quiet_period", F.col("trough"), "trough_value", "low", "applications"),
            fact(run["selection"].where("selected"), 14, "model_accuracy", F.col("model"), "MAPE", "MAE", "percent"),
        ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def generate_findings(panel: DataFrame, run: dict | None = None, spec: FunnelSpec = DEFAULT_SPEC) -> DataFrame:
    """All findings in the fixed order; ``run`` is the output of ``plans.training.forecast_year``."""
    parts = []
    if run is not None:
        table = run["table"]
        parts += [forecast_peak(table), forecast_high_months(table),
                  forecast_vs_last_year(table, A.yearly_summary(panel, spec)), forecast_quiet_period(table)]
    parts += [latest_growth(panel, spec), cagr(panel, spec), peak_season(panel, spec), weakest_month(panel, spec),
              bottleneck(panel, spec), efficiency(panel, spec), concentration(panel, spec), fastest_growing(panel, spec),
              programmes(panel, spec)]
    if run is not None:
        parts.append(model_accuracy(run["selection"]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
