"""Token ids in ORC files: run-length encoded integers, row indexes, Bloom filters on document ids.

Documents are range-partitioned by (doc_id, hash of the text) and sorted within the
partition, so file k holds no larger ids than file k + 1, stripe statistics are tight and a
look-up of a few ids prunes files, stripes and row groups (min/max first, then the Bloom
filter). The hash is written beside the id: it gives the order of equal ids. Ids are an ``array<int>`` column: ORC's integer RLE stores them. Any file or
stripe can be read by a task of its own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import words
from .common import materialise
from .encode import encoder

SCHEMA = "doc_id bigint, tie bigint, n_tokens bigint, ids array<int>"
OPTIONS = {
    "compression": "zstd",
    "orc.stripe.size": str(32 << 20),
    "orc.row.index.stride": "1000",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
}


def encode_docs(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """(doc_id, tie, n_tokens, ids) of (doc_id, tie, text) rows, ``end_id`` after each document, in row order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            text = batch.column(2).fill_null("")
            for a, b in words.slices(text, 2 * words.BLOCK_BYTES):
                ids, per = enc.encode(text.slice(a, b - a))
                full = np.insert(ids, np.cumsum(per), end_id).astype(np.int32)
                per = per + 1
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(per),
                    pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per)]).astype(np.int32)), pa.array(full)),
                ], names=["doc_id", "tie", "n_tokens", "ids"])

    return docs.mapInArrow(run, SCHEMA)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0,
                 id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode ``docs`` and write them to ``path`` as ORC in ascending doc_id order.

    Null text: empty (the end id only). Null doc_id: sorted first. Repeated rows and ties: all
    stored, equal ids in order of the text's hash, also where they go on in the next file (rows equal in both are dealt
    out by their input order, so many of them do not meet in one task). Empty table: an empty ORC folder.
    Further columns are ignored. The number of files is the session's shuffle partitions.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tie"),
                       F.monotonically_increasing_id().alias("row"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(n, "doc_id", "tie", "row").sortWithinPartitions("doc_id", "tie").select("doc_id", "tie", "text")
    encode_docs(ordered, tokenizer, end_id).write.mode("overwrite").options(**OPTIONS).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, tie, n_tokens, ids) of a token folder; filters on doc_id reach stripe statistics and Bloom filters."""
    return spark.read.schema(SCHEMA).option("mergeSchema", "false").orc(path)


def with_starts(tokens: DataFrame) -> DataFrame:
    """Add ``start``: the ids of all documents before, in file and row order.

    Two levels: sums per file (one short row each) are accumulated, then each file's rows in their order there,
    by (doc_id, tie); rows equal in both have the same ids. The ids are read once: checksums are short rows, written
    to the shared folder for both levels. Null ids come first; an empty folder gives no rows.
    """
    rows = tokens.withColumn("file", F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("int"))
    crcs = materialise(_checksums(rows), "token-checksums")
    files = crcs.groupBy("file").agg(F.sum("n_tokens").alias("file_tokens"))
    before = files.select("file", (F.sum("file_tokens").over(Window.orderBy("file")) - F.col("file_tokens")).alias("file_start"))
    inner = Window.partitionBy("file").orderBy("doc_id", "tie")
    run = F.sum("n_tokens").over(inner.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n_tokens")
    return crcs.withColumn("within", run).join(before, "file").select(
        "doc_id", (F.col("file_start") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def _checksums(rows: DataFrame) -> DataFrame:
    """Replace the ids by the crc32 of their little-endian unsigned 32-bit form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(3)
            off = ids.offsets.to_numpy().astype(np.int64)
            flat = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), dtype="<u4")).cast("B")
            crc = [zlib.crc32(flat[4 * a : 4 * b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crc, pa.int64()), batch.column(4)],
                                             names=["doc_id", "tie", "n_tokens", "ids_crc32", "file"])

    return rows.select("doc_id", "tie", "n_tokens", "ids", "file").mapInArrow(run, "doc_id bigint, tie bigint, n_tokens bigint, ids_crc32 bigint, file int")
