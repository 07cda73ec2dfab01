"""Sinks (S5-S12): panel, report tables, evaluation, predictions, features, findings, artifacts.

Everything is written by Spark writers (parquet by default, one folder per
table); rounding is applied only here, in the report layer (half-even, like the
source's numpy rounding). The load-with-recompute helper reads saved tables and
recomputes *all* of them when any is missing (S12).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from funnelcast.functions.columns import bround_doubles

# fixed values: report rounding of the source (decimal places per table)
REPORT_ROUNDING = {
    "yearly_summary": 2,
    "seasonality_profile": 3,
    "funnel_overall": 2,
    "funnel_by_product": 2,
    "funnel_by_year": 2,
    "entity_performance": 2,
    "product_performance": 2,
    "monthly_contribution": 2,
    "model_evaluation": 4,
    "backtest_predictions": 0,
    "feature_importance": 6,
}


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by=None, mode: str = "overwrite") -> None:
    w = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.option("header", "true")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


# --------------------------------------------------------------------------- S5, S9
def write_panel(panel: DataFrame, root: str, monthly: DataFrame | None = None) -> None:
    """Panel partitioned by year (partition pruning for year filters) plus the monthly series."""
    write_table(panel, f"{root}/panel", partition_by=["year"])
    if monthly is not None:
        write_table(monthly, f"{root}/monthly_series")


def read_panel(spark: SparkSession, root: str) -> DataFrame:
    """The panel back with its fixed schema (``year`` comes from the partition folders)."""
    p = spark.read.parquet(f"{root}/panel")
    first = ["date", "year", "month", "month_name", "quarter", "entity", "product", "direction", "programme"]
    return p.select(*first, *[c for c in p.columns if c not in first])


# --------------------------------------------------------------------------- S6 - S8, S10
def write_reports(tables: dict[str, DataFrame], root: str, fmt: str = "parquet", round_reports: bool = True) -> None:
    for name, df in tables.items():
        out = bround_doubles(df, REPORT_ROUNDING[name]) if round_reports and name in REPORT_ROUNDING else df
        write_table(out, f"{root}/{name}", fmt)


# --------------------------------------------------------------------------- S11
def save_artifacts(root: str, tables: dict[str, DataFrame], model=None) -> None:
    """Persist the winner's metadata tables (selection, residual quantiles, history) and an optional MLlib model."""
    for name, df in tables.items():
        write_table(df, f"{root}/{name}")
    if model is not None:
        model.write().overwrite().save(f"{root}/model")


def load_artifacts(spark: SparkSession, root: str, names, with_model: bool = False):
    tables = {n: spark.read.parquet(f"{root}/{n}") for n in names}
    model = None
    if with_model:
        from pyspark.ml import PipelineModel

        model = PipelineModel.load(f"{root}/model")
    return tables, model


# --------------------------------------------------------------------------- S12
def load_or_compute(spark: SparkSession, root: str, names, compute: Callable[[], dict[str, DataFrame]]) -> dict[str, DataFrame]:
    """Read every saved table; if any is missing, recompute all, save them, and return the fresh ones."""
    try:
        return {n: spark.read.parquet(f"{root}/{n}") for n in names}
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise  # permissions, broken files: nothing is overwritten
        fresh = compute()
        write_reports({n: fresh[n] for n in names}, root, round_reports=False)
        return {n: spark.read.parquet(f"{root}/{n}") for n in names}
