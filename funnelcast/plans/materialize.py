"""Cutting lineage at stage boundaries.

A reliable ``checkpoint()`` writes the rows to the shared folder the cluster
names in ``spark.checkpoint.dir`` (read from the session; a scratch folder is
only registered when the setting is absent, as in local tests). Later jobs read
those files instead of recomputing the upstream joins, and a lost executor does
not force a recompute either. ``localCheckpoint`` is never used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from funnelcast.session import ensure_checkpoint_dir


def materialize(df: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
