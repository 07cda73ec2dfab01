"""Validation and reconciliation of a panel.

The report is a DataFrame ``(check, severity, n, detail)``. Almost every check
comes out of **one** conditional-aggregate pass over the panel (row count,
per-stage negatives, stage totals, per-row inversions, distinct counts); month
coverage, duplicate cells and zero months are three small grouped side queries.
Nothing is collected: the checks are rows, and ``passed`` is a ``bool_and``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from funnelcast.spec import DEFAULT_SPEC, FunnelSpec

REPORT_COLUMNS = ("check", "severity", "n", "detail")


def _row(check: str, severity: str, n: Column, detail: Column | None = None) -> Column:
    return F.struct(
        F.lit(check).alias("check"),
        F.lit(severity).alias("severity"),
        n.cast("bigint").alias("n"),
        (detail if detail is not None else F.lit(None)).cast("string").alias("detail"),
    )


def _pairs(spec: FunnelSpec):
    return list(zip(spec.stages, spec.stages[1:]))


# --------------------------------------------------------------------------- V1
def required_columns(panel: DataFrame, spec: FunnelSpec = DEFAULT_SPEC) -> list[str]:
    required = ["date", "entity", "product", "direction", *spec.stages]
    return [c for c in required if c not in panel.columns]


def check_required_columns(panel: DataFrame, spec: FunnelSpec = DEFAULT_SPEC) -> DataFrame:
    """One row; evaluated from the schema, emitted through a one-row aggregate of the panel."""
    missing = required_columns(panel, spec)
    one = panel.agg(F.count(F.lit(1)).alias("_rows"))
    return one.select(F.inline(F.array(_row("required_columns", "error", F.lit(len(missing)),
                                              F.lit(",".join(missing)) if missing else None))))


# --------------------------------------------------------------------------- V2-V5, V9: one pass
def _one_pass(panel: DataFrame, spec: FunnelSpec) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias("rows")]
    aggs += [F.count_if(F.col(s) < 0).alias(f"neg_{s}") for s in spec.stages]
    aggs += [F.sum(s).alias(f"tot_{s}") for s in spec.stages]
    aggs += [F.count_if(F.col(b) > F.col(a)).alias(f"inv_{a}_{b}") for a, b in _pairs(spec)]
    aggs += [
        F.count_distinct("date").alias("months"),
        F.count_distinct("entity").alias("entities"),
        F.count_distinct("programme").alias("programmes"),
    ]
    return panel.agg(*aggs)


def _detail_list(items) -> Column:
    """Comma list of the non-NULL parts (concat_ws skips NULLs); NULL when empty."""
    joined = F.concat_ws(",", *items)
    return F.nullif(joined, F.lit(""))


def pass_checks(panel: DataFrame, spec: FunnelSpec = DEFAULT_SPEC) -> DataFrame:
    """V2 non-empty, V3 negatives, V4 aggregate order, V5 per-row inversions, V9 stats."""
    agg = _one_pass(panel, spec)
    neg_total = sum((F.col(f"neg_{s}") for s in spec.stages), F.lit(0))
    neg_detail = _detail_list(
        [F.when(F.col(f"neg_{s}") > 0, F.concat(F.lit(f"{s}:"), F.col(f"neg_{s}").cast("string"))) for s in spec.stages]
    )
    inverted = [F.col(f"tot_{b}") > F.col(f"tot_{a}") for a, b in _pairs(spec)]
    agg_n = sum((F.when(c, 1).otherwise(0) for c in inverted), F.lit(0))
    agg_detail = _detail_list([F.when(c, F.lit(f"{b}>{a}")) for c, (a, b) in zip(inverted, _pairs(spec))])
    row_n = sum((F.col(f"inv_{a}_{b}") for a, b in _pairs(spec)), F.lit(0))
    row_detail = _detail_list(
        [
            F.when(F.col(f"inv_{a}_{b}") > 0, F.concat(F.lit(f"{b}>{a}:"), F.col(f"inv_{a}_{b}").cast("string")))
            for a, b in _pairs(spec)
        ]
    )
    rows = F.array(
        _row("nonempty", "error", F.when(F.col("rows") == 0, 1).otherwise(0)),
        _row("negative_counts", "error", neg_total, neg_detail),
        _row("funnel_aggregate", "error", agg_n, agg_detail),
        _row("funnel_rows", "warning", row_n, row_detail),
        _row("stat_rows", "info", F.col("rows")),
        _row("stat_months", "info", F.col("months")),
        _row("stat_entities", "info", F.col("entities")),
        _row("stat_programmes", "info", F.col("programmes")),
        _row(f"stat_total_{spec.first}", "info", F.coalesce(F.col(f"tot_{spec.first}"), F.lit(0))),
    )
    return agg.select(F.inline(rows))


# --------------------------------------------------------------------------- V6
def expected_months(df: DataFrame, start: str, end: str) -> DataFrame:
    """Calendar months of ``[start, end]`` as first-of-month dates (P1 without the clipping)."""
    one = df.agg(F.count(F.lit(1)).alias("_n"))
    return one.select(
        F.explode(
            F.sequence(F.trunc(F.to_date(F.lit(start)), "MM"), F.to_date(F.lit(end)), F.expr("INTERVAL 1 MONTH"))
        ).alias("date")
    )


def check_month_gaps(panel: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Months of the collection window absent from the panel (error); lists them all (bounded by the calendar)."""
    present = panel.select("date").distinct()
    if start is None or end is None:
        bounds = panel.agg(F.min("date").alias("s"), F.max("date").alias("e"))
        grid = bounds.select(F.explode(F.sequence("s", "e", F.expr("INTERVAL 1 MONTH"))).alias("date"))
    else:
        grid = expected_months(panel, start, end)
    gaps = grid.join(present, "date", "left_anti")
    return gaps.agg(
        F.count(F.lit(1)).alias("n"),
        F.array_sort(F.collect_list(F.date_format("date", "yyyy-MM"))).alias("gaps"),
    ).select(F.inline(F.array(_row("month_gaps", "error", F.col("n"), F.nullif(F.array_join("gaps", ","), F.lit(""))))))


# --------------------------------------------------------------------------- V7
def check_duplicates(panel: DataFrame) -> DataFrame:
    dup = panel.groupBy("date", "entity", "programme").agg(F.count(F.lit(1)).alias("c"))
    return dup.agg(F.coalesce(F.sum(F.when(F.col("c") > 1, F.col("c") - 1)), F.lit(0)).alias("n")).select(
        F.inline(F.array(_row("duplicates", "warning", F.col("n"))))
    )


# --------------------------------------------------------------------------- V8
def check_zero_months(panel: DataFrame, spec: FunnelSpec = DEFAULT_SPEC) -> DataFrame:
    by_month = panel.groupBy("date").agg(F.sum(spec.first).alias("t"))
    return by_month.agg(F.count_if(F.col("t") == 0).alias("n")).select(
        F.inline(F.array(_row("zero_months", "warning", F.col("n"))))
    )


# --------------------------------------------------------------------------- V10
def validate(panel: DataFrame, spec: FunnelSpec = DEFAULT_SPEC, start: str | None = None, end: str | None = None) -> DataFrame:
    """Full report ``(check, severity, n, detail, failed, passed)``.

    Stops early like the source: with missing columns only that row is reported;
    with an empty panel only the first two.
    """
    req = check_required_columns(panel, spec)
    if required_columns(panel, spec):
        parts = req
    else:
        parts = (
            req.unionByName(pass_checks(panel, spec))
            .unionByName(check_month_gaps(panel, start, end))
            .unionByName(check_duplicates(panel))
            .unionByName(check_zero_months(panel, spec))
        )
        n_rows = panel.agg(F.count(F.lit(1))).scalar()
        parts = parts.where(F.col("check").isin("required_columns", "nonempty") | (n_rows > 0))
    failed = F.col("severity").isin("error", "warning") & (F.col("n") > 0)
    out = parts.withColumn("failed", failed)
    blocking = F.col("failed") & (F.col("severity") == "error")
    passed = out.agg(F.bool_and(~blocking).alias("passed")).scalar()
    return out.withColumn("passed", passed)


# --------------------------------------------------------------------------- V11
def reconcile_totals(panel: DataFrame, spec: FunnelSpec = DEFAULT_SPEC) -> DataFrame:
    """Sum of monthly windows vs the single full-window total, per stage (GROUPING SETS ((date), ()))."""
    r = panel.rollup("date").agg(*[F.sum(s).alias(s) for s in spec.stages], F.grouping_id().alias("gid"))
    both = r.agg(
        *[F.sum(F.when(F.col("gid") == 0, F.col(s))).alias(f"w_{s}") for s in spec.stages],
        *[F.max(F.when(F.col("gid") == 1, F.col(s))).alias(f"f_{s}") for s in spec.stages],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(i + 1).alias("stage_order"),
                F.lit(s).alias("stage"),
                F.col(f"w_{s}").cast("bigint").alias("sum_of_windows"),
                F.col(f"f_{s}").cast("bigint").alias("full_window"),
                (F.col(f"w_{s}") - F.col(f"f_{s}")).cast("bigint").alias("delta"),
            )
            for i, s in enumerate(spec.stages)
        ]
    )
    return both.select(F.inline(rows))


# --------------------------------------------------------------------------- V12
def distinct_nonadditive(records: DataFrame, person_col: str, date_col: str = "date") -> DataFrame:
    """Why distinct-person counts cannot be summed over windows, measured.

    ``records`` holds one row per record with the person id and its month.
    Record counts add up across months; distinct persons over-count.
    """
    per_month = records.groupBy(date_col).agg(
        F.count(F.lit(1)).alias("records"), F.count_distinct(person_col).alias("persons")
    )
    monthly = per_month.agg(
        F.sum("records").alias("sum_of_monthly_records"), F.sum("persons").alias("sum_of_monthly_distinct")
    )
    full = records.agg(F.count(F.lit(1)).alias("full_window_records"), F.count_distinct(person_col).alias("full_window_distinct"))
    full_records = full.select("full_window_records").scalar()
    full_distinct = full.select("full_window_distinct").scalar()
    return monthly.select(
        F.col("sum_of_monthly_records").cast("bigint").alias("sum_of_monthly_records"),
        full_records.cast("bigint").alias("full_window_records"),
        F.col("sum_of_monthly_distinct").cast("bigint").alias("sum_of_monthly_distinct"),
        full_distinct.cast("bigint").alias("full_window_distinct"),
        (F.col("sum_of_monthly_distinct") - full_distinct).cast("bigint").alias("distinct_overcount"),
        (F.col("sum_of_monthly_records") == full_records).alias("records_additive"),
        (F.col("sum_of_monthly_distinct") == full_distinct).alias("distinct_additive"),
    )
