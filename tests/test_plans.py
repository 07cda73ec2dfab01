"""Physical-plan properties of the registered queries: pruned scans, pushed filters, no cartesian joins."""

from __future__ import annotations

import io
from contextlib import redirect_stdout

import pytest

import __spark_entry__ as E
from funnelcast import catalog
from tests.conftest import SF001

# learners fit models while the DataFrame is built; their plans are covered by the feature queries
_EAGER = {"fc_linear", "fc_ridge", "fc_random_forest", "fc_gbt", "feature_importance", "backtest_learners",
          "stream_ingest_panel", "build_panel"}


def _plan(df) -> str:
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_panel_scans_are_pruned_and_pushed(spark):
    from funnelcast.sources.testpanel import build_test_panel

    plan = _plan(build_test_panel(spark, SF001))
    assert "ReadSchema: struct<l_orderkey:bigint,l_discount:double,l_returnflag:string,l_linestatus:string>" in plan
    assert "PushedFilters: [IsNotNull(l_orderkey)]" in plan
    assert "CartesianProduct" not in plan


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - _EAGER))
def test_no_cartesian_or_nested_loop_join(spark, name):
    plan = _plan(E.queries()[name](spark, SF001))
    assert "CartesianProduct" not in plan, name
    assert "BroadcastNestedLoopJoin" not in plan, name
