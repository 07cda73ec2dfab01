from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from funnelcast.session import local_session

    s = local_session("*", shuffle_partitions=8, app="funnelcast-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def panel_small(spark):
    from funnelcast.sources.testpanel import build_test_panel

    return build_test_panel(spark, SF001).cache()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    from funnelcast.sources.tables import TABLES

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return con
