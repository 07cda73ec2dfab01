"""Readers for the parquet tables under a scale-factor folder.

Reads name their columns up front so the parquet scan only decodes what the
operator needs (``ReadSchema`` in the plan shows the pruned schema).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str, columns=None) -> DataFrame:
    df = spark.read.parquet(table_path(sf_dir, name))
    if columns:
        df = df.select(*columns)
    return df


def folder_state(spark: SparkSession, sf_dir: str) -> tuple:
    """Name, time, bytes and file count of every table under ``sf_dir``: the key under which derived frames may be reused."""
    path = spark._jvm.org.apache.hadoop.fs.Path(sf_dir)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    state = []
    for entry in fs.listStatus(path):
        held = fs.getContentSummary(entry.getPath())
        state.append((entry.getPath().getName(), entry.getModificationTime(), held.getLength(), held.getFileCount()))
    return (spark.sparkContext.applicationId, sf_dir, *sorted(state))


def bounded_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast ``df`` only after proving it has at most ``max_rows`` rows.

    The proof is a bounded count (``limit(max_rows + 1)``) so it never scans more
    than ``max_rows + 1`` rows. Beyond the bound the frame is returned unchanged
    and the join falls back to a shuffle join (AQE may still convert it at run
    time from measured sizes).
    """
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df
