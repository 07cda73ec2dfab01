"""End to end through the public API, as in the README: envelope files -> panel -> reports -> forecast -> findings."""

from __future__ import annotations

from funnelcast import catalog
from funnelcast.operators.findings import generate_findings
from funnelcast.plans.analysis import build_panel, run_full_analysis
from funnelcast.plans.training import forecast_year
from funnelcast.sources.envelope import read_envelope, write_envelope
from tests.conftest import SF001


def test_readme_flow(spark, tmp_path, panel_small):
    flat, programme_names, office_names = catalog._pages(spark, SF001, "flat")
    write_envelope(flat, str(tmp_path / "env"))
    pages = read_envelope(spark, str(tmp_path / "env"))
    panel, report = build_panel(pages, programme_names, office_names, start="1995-01-01", end="2001-08-31", strict=True)
    assert panel.count() == panel_small.count()
    assert report.first()["passed"] is True
    assert len(run_full_analysis(panel)) == 10
    run = forecast_year(panel, 2002, checkpoint_stages=True)
    assert run["table"].count() == 12
    assert generate_findings(panel, run).count() >= 8
