"""Incremental panel ingest with Structured Streaming.

The source re-runs its whole pipeline from one JSON file. Here envelope records
(JSON lines, as written by :func:`funnelcast.sources.envelope.write_envelope`)
are picked up as they land: every micro-batch routes and parses its pages into
long cells and writes them to ``cells/batch_id=<n>`` with overwrite, so a
retried batch replaces its own output (exactly-once effect, no duplicates).
The panel is a pure function of all cells (:func:`panel_from_cells`): a window that
is collected again replaces its earlier version, whatever batches they came in.

The stream's checkpoint lives under the session's ``spark.checkpoint.dir``
unless a location is given; nothing uses a machine-local folder.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from funnelcast.operators import parsing as PA
from funnelcast.sources import envelope as EN
from funnelcast.spec import DEFAULT_SPEC, FunnelSpec


def start_cell_stream(
    spark: SparkSession,
    records_dir: str,
    cells_dir: str,
    programme_names: DataFrame,
    entity_names: DataFrame | None = None,
    checkpoint_location: str | None = None,
    available_now: bool = True,
    max_files_per_trigger: int | None = None,
) -> StreamingQuery:
    """Start the ingest stream ``records_dir`` (JSON lines) -> ``cells_dir`` (parquet, one folder per stream and batch).

    Without ``checkpoint_location`` the stream state lies in the store under a name made of ``records_dir``, so
    streams into several stores, or from several folders into one store, do not disturb each other.
    """
    reader = spark.readStream.format("text").option("recursiveFileLookup", "true")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    lines = reader.load(records_dir)
    store, stream = cells_dir.rstrip("/"), "s" + hashlib.sha256(records_dir.rstrip("/").encode()).hexdigest()[:16]
    pages = EN.pages_of(lines)
    progs = programme_names
    names = entity_names

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        at = f"{store}/stream={stream}/batch_id={batch_id}"
        window = F.struct("source", "month", "record_product", "version")
        pages = batch.withColumn("window", F.to_json(window))  # rides through the parser in place of the product
        cells = PA.payload_cells(pages.select("month", F.col("window").alias("record_product"), "page"), progs, names)
        own = F.from_json("record_product", "source string, month string, record_product string, version bigint")
        cells = cells.withColumn("_w", own).withColumns({
            "record_product": F.col("_w.record_product"), "source": F.col("_w.source"), "version": F.col("_w.version")}).drop("_w")
        cells.write.mode("overwrite").parquet(at)

    location = checkpoint_location or f"{store}/_checkpoints/{stream}"
    writer = pages.writeStream.foreachBatch(write_batch).option("checkpointLocation", location)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()


def panel_from_cells(spark: SparkSession, cells_dir: str, spec: FunnelSpec = DEFAULT_SPEC, default_entity: str | None = None) -> DataFrame:
    """The panel from every ingested cell: the newest version of each (source, month, product), cells of one version summed."""
    cells = spark.read.option("basePath", cells_dir).parquet(cells_dir).drop("stream", "batch_id")
    return PA.cells_to_panel(EN.newest(cells), spec, default_entity)
