"""The full report set over one panel (A13) and the panel build plan.

The panel is materialised once (reliable checkpoint in the shared folder) and
every report is a lazy DataFrame over it, so the expensive joins behind the
panel run once no matter how many reports are written (scan sharing).
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from funnelcast.operators import parsing as PA
from funnelcast.operators import quality as V
from funnelcast.operators import reports as A
from funnelcast.plans.materialize import materialize
from funnelcast.spec import DEFAULT_SPEC, FunnelSpec


def run_full_analysis(panel: DataFrame, spec: FunnelSpec = DEFAULT_SPEC, top_n: int = 10) -> dict[str, DataFrame]:
    """The ten report tables of the source, keyed by their file names."""
    return {
        "monthly_trend": A.monthly_trend(panel, spec),
        "yearly_summary": A.yearly_summary(panel, spec),
        "seasonality_profile": A.seasonality_profile(panel, spec),
        "peak_months": A.peak_months(panel, top_n, spec),
        "funnel_overall": A.funnel_overall(panel, spec),
        "funnel_by_product": A.funnel_by_dimension(panel, "programme", spec),
        "funnel_by_year": A.funnel_by_dimension(panel, "year", spec),
        "entity_performance": A.entity_performance(panel, spec),
        "product_performance": A.product_performance(panel, spec),
        "monthly_contribution": A.monthly_contribution(panel, spec),
    }


class ValidationError(ValueError):
    pass


def build_panel(pages: DataFrame, programme_names: DataFrame, entity_names: DataFrame | None = None,
                spec: FunnelSpec = DEFAULT_SPEC, start: str | None = None, end: str | None = None,
                strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Pages -> panel (checkpointed) -> validation report; ``strict`` raises on blocking errors.

    Zero records, like zero parsed rows, is an error, as in the source. Unreadable pages are left to
    :func:`funnelcast.operators.parsing.quarantine`.
    """
    if pages.isEmpty():
        raise ValueError("No records: there is nothing to parse.")
    panel = materialize(PA.envelope_to_panel(pages, programme_names, entity_names, spec))
    if panel.isEmpty():
        raise ValueError("Parsed zero rows from the pages; check the status vocabulary against a sample page.")
    report = V.validate(panel, spec, start, end)
    if strict:
        errors = report.where("failed AND severity = 'error'").select("check", "n", "detail").collect()  # a handful of rows
        if errors:
            raise ValidationError(f"Dataset validation failed: {[r.asDict() for r in errors]}")
    return panel, report
