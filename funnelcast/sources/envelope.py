"""Envelope IO (S1, S2), the id -> name dimension (S3) and the ingest audit.

The reference keeps one JSON document ``{metadata, records: [{month, product,
pages: [...]}]}``. Here the sink writes records as JSON lines (every line one record,
every file readable in parallel) and, last of all, a manifest with one row per window:
``(source, month, product, version, pages, status, reason, collected_at)``. A window collected
again gets a higher version and replaces the earlier one for every reader; a window that
failed keeps its last good version and shows up in :func:`failed_windows`. The reader
accepts that layout, records without a manifest, and a single envelope document; it returns
one row per page. Lines that cannot be read come back as a NULL page, so the parser's audit counts them.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from funnelcast.sources.tables import bounded_broadcast

PAGE_COLUMNS = ("month", "record_product", "page")


_RECORD = "source string, month string, product string, version bigint, pages array<variant>"
MANIFEST = "source string, month string, product string, version bigint, pages bigint, status string, reason string, collected_at timestamp"


# --------------------------------------------------------------------------- S2
def write_envelope(pages: DataFrame, path: str, metadata: dict | None = None, failures: DataFrame | None = None,
                   version: int | None = None, source: str | None = None) -> int:
    """Add one collection of windows to ``path``; returns its version.

    Records go to ``path/records/version=<v>`` as JSON lines, a file for each partition of ``pages``; then the provenance row (``path/metadata``), the manifest last: a collection whose
    writer was lost has no manifest rows and is not read. ``failures``: (month, product, reason) of windows that
    could not be collected. ``source`` names the collector (default: the path): versions replace each other within it.
    """
    spark = pages.sparkSession
    source = source or path
    version = version or time.time_ns() // 1000
    own = pages.select(F.lit(source).alias("source"), "month", F.col("record_product").alias("product"), F.lit(version).cast("bigint").alias("version"),
                       F.parse_json("page").alias("page") if dict(pages.dtypes)["page"] == "string" else F.col("page"))
    lines = own.select("month", F.to_json(F.struct("source", "month", "product", "version", F.array("page").alias("pages"))).alias("value"))
    lines.select("value").write.mode("overwrite").text(f"{path}/records/version={version}")
    written = spark.read.text(f"{path}/records/version={version}")  # counted from the files: the pages are made once
    window = written.select(F.lit(source).alias("source"), F.get_json_object("value", "$.month").alias("month"),
                            F.get_json_object("value", "$.product").alias("product"), F.lit(version).cast("bigint").alias("version"))
    good = window.groupBy("source", "month", "product", "version").agg(F.count(F.lit(1)).alias("pages")).withColumns(
        {"status": F.lit("ok"), "reason": F.lit(None).cast("string")})
    if failures is not None:
        bad = failures.select(F.lit(source).alias("source"), "month", "product", F.lit(version).cast("bigint").alias("version"),
                              F.lit(0).cast("bigint").alias("pages"), F.lit("failed").alias("status"), "reason")
        good = good.unionByName(bad)
    manifest = good.withColumn("collected_at", F.current_timestamp())
    extras = [F.lit(str(v)).alias(k) for k, v in sorted((metadata or {}).items())]
    failed = failures.count() if failures is not None else 0
    counts = window.agg(F.count(F.lit(1)).alias("record_count"), F.count_distinct("month").alias("months"))
    counts.select("*", F.lit(failed).alias("failed_windows"), *extras, F.lit(version).alias("version"), F.current_timestamp().alias("collected_at")).coalesce(
        1).write.mode("append").json(f"{path}/metadata")
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/manifest/version={version}")
    return version


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Every window of every collection, failed ones included."""
    return spark.read.schema(MANIFEST).json(f"{path}/manifest").select(*[c.split()[0] for c in MANIFEST.split(", ")])


def newest(rows: DataFrame, product: str = "record_product") -> DataFrame:
    """Rows of the newest version of their window (source, month, product); one row a window decides, whatever its size."""
    key = [F.coalesce(F.col(c), F.lit("")).alias(f"_{i}") for i, c in enumerate(("source", "month", product))]
    last = rows.groupBy(*key).agg(F.max(F.coalesce("version", F.lit(0))).alias("_v"))
    keyed = rows.select("*", *key, F.coalesce("version", F.lit(0)).alias("_v"))
    return keyed.join(last, ["_0", "_1", "_2", "_v"], "left_semi").drop("_0", "_1", "_2", "_v")


def failed_windows(manifest: DataFrame) -> DataFrame:
    """``(source, month, product, version, reason, has_earlier)`` of windows whose newest collection failed."""
    last = newest(manifest, "product").where("status = 'failed'")
    good = manifest.where("status = 'ok'").select(
        F.col("source").alias("_s"), F.col("month").alias("_m"), F.col("product").alias("_p")).distinct()
    same = F.col("source").eqNullSafe(F.col("_s")) & F.col("month").eqNullSafe(F.col("_m")) & F.col("product").eqNullSafe(F.col("_p"))
    return last.join(good, same, "left").select("source", "month", "product", "version", "reason", F.col("_m").isNotNull().alias("has_earlier"))


# --------------------------------------------------------------------------- S1
def pages_of(lines: DataFrame) -> DataFrame:
    """``(source, month, record_product, version, page)`` of record lines; a line that is no record gives one NULL page."""
    rec = lines.select(F.try_variant_get(F.try_parse_json("value"), "$", "map<string,variant>").alias("r"))

    def text(name: str) -> F.Column:
        return F.try_variant_get(F.col("r")[name], "$", "string")

    pages = F.coalesce(F.try_variant_get(F.col("r")["pages"], "$", "array<variant>"),
                       F.when(F.col("r").isNull(), F.array(F.lit(None).cast("variant"))))
    return rec.select(text("source").alias("source"), text("month").alias("month"), text("product").alias("record_product"),
                      F.try_variant_get(F.col("r")["version"], "$", "bigint").alias("version"), F.explode(pages).alias("page"))


def read_envelope(spark: SparkSession, path: str, windows: bool = False) -> DataFrame:
    """One row per page: ``(month, record_product, page VARIANT)``, with ``windows`` also (source, version).

    ``path`` is either the layout of :func:`write_envelope` or a single envelope document. Only the newest good
    version of a window is read, and only collections whose manifest is complete. A missing path is an error naming
    the fix; an envelope without records yields an empty frame (``envelope_to_panel`` callers check).
    """
    columns = ("source", "month", "record_product", "version", "page") if windows else PAGE_COLUMNS
    if _exists(spark, f"{path}/records"):
        pages = pages_of(spark.read.text(f"{path}/records").select("value"))
        if _exists(spark, f"{path}/manifest"):
            good = read_manifest(spark, path).where("status = 'ok'").select("source", "month", F.col("product").alias("record_product"), "version")
            last = newest(good).select("source", "month", F.coalesce("record_product", F.lit("")).alias("_p"), "version")
            match = ["source", "month", "_p", "version"]
            known = pages.withColumn("_p", F.coalesce("record_product", F.lit(""))).join(last, match, "left_semi").drop("_p")
            pages = known.unionByName(pages.where("version is null"))  # lines that are no records
        return pages.select(*columns)
    if not _exists(spark, path):
        raise FileNotFoundError(f"No raw responses at {path}. Write them first (write_envelope).")
    doc = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("d"))
    rec = doc.select(F.explode(F.try_variant_get("d", "$.records", "array<variant>")).alias("r"))
    return pages_of(rec.select(F.to_json("r").alias("value"))).select(*columns)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(conf).exists(p)


# --------------------------------------------------------------------------- S3
def with_names(df: DataFrame, names: DataFrame, id_col: str = "office_id", max_rows: int = 100_000) -> DataFrame:
    """Left-join the id -> name dimension (one name per id, the greatest; broadcast behind a bounded count); missing -> ``office <id>``."""
    n = bounded_broadcast(names.groupBy(F.col(id_col).cast("string").alias("_id")).agg(F.max("entity").alias("_name")), max_rows)
    j = df.join(n, F.col(id_col).cast("string") == F.col("_id"), "left")
    return j.withColumn("entity", F.coalesce(F.nullif(F.col("_name"), F.lit("")), F.concat(F.lit("office "), F.col(id_col).cast("string")))).drop("_id", "_name")


# --------------------------------------------------------------------------- S13
def ingest_audit(expected: DataFrame, landed: DataFrame, keys=("month",), pages: DataFrame | None = None) -> DataFrame:
    """Attempted / succeeded / failed windows and the success rate (0 when nothing was attempted), one row.

    ``expected``: one row per window that should exist (e.g. P1 windows x products);
    ``landed``: rows that arrived (any number per window). With ``pages`` (a :func:`parsing.page_audit`) also its
    sums: pages, malformed pages and faulty counts.
    """
    keys = list(keys)
    got = landed.select(*keys).distinct().withColumn("_ok", F.lit(True))
    j = expected.select(*keys).distinct().join(got, keys, "left")
    out = j.agg(
        F.count(F.lit(1)).alias("windows_attempted"),
        F.count_if(F.col("_ok")).alias("windows_succeeded"),
        F.count_if(F.col("_ok").isNull()).alias("windows_failed"),
    ).withColumn(
        "success_rate",
        F.coalesce(F.try_divide(F.col("windows_succeeded").cast("double"), F.col("windows_attempted").cast("double")), F.lit(0.0)),
    )
    if pages is not None:
        total = pages.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("pages", "malformed_pages", "faulty_counts")])
        out = out.select("*", *[total.select(c).scalar().alias(c) for c in total.columns])
    return out
