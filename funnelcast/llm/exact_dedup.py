"""Exact duplicates by Grace hash deduplication.

Records (normalised content, key of the row) are dealt into buckets by a hash of the
content; the shuffle files are the spill files. A task reads its buckets one after the
other and keeps the distinct contents of the current bucket in an open-addressing table
that compares complete contents; copies only update a slot, so a group of copies takes one
slot whatever its size. A bucket whose distinct contents outgrow the table is not processed
further: its records are written, with the level raised, to the shared folder and dealt again
by another hash bit range (recursive partitioning) until every bucket fits.

Before the first shuffle each map task collapses its own copies with the same table, so a
hot text leaves a task once for each time that its table fills.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

TABLE_BYTES = 64 << 20
BUCKETS = 256
SPACES = b" \t\n\x0b\x0c\r"
RECORDS = "hash bigint, n_points bigint, doc_id bigint, group_size bigint, content binary"
SOLVED = RECORDS.replace("content binary", "sha binary, content binary")


def normalise(text: bytes) -> bytes:
    """The text without ``[\\x20\\x09-\\x0D]`` (ASCII, so safe on UTF-8 bytes)."""
    return text.translate(None, SPACES)


class ContentTable:
    """Open addressing with linear probing; a slot holds a content, its best row and its count."""

    def __init__(self, budget: int):
        self.budget = budget
        self.clear()

    def clear(self) -> None:
        self.slots = np.full(1 << 10, -1, np.int64)
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.best: list[tuple[int, int | None]] = []
        self.counts: list[int] = []
        self.bytes = 0

    def _place(self, h: int, content: bytes | None) -> tuple[int, int]:
        """(position, entry) of the content, entry -1 where it is new."""
        mask = len(self.slots) - 1
        at = h & mask
        while (entry := int(self.slots[at])) >= 0:
            if content is not None and self.hashes[entry] == h and self.contents[entry] == content:
                return at, entry
            at = (at + 1) & mask
        return at, -1

    def add(self, h: int, content: bytes, points: int, doc_id: int | None, count: int) -> bool:
        """Put a record in; False, and nothing changed, where a new content does not fit."""
        at, entry = self._place(h, content)
        if entry >= 0:
            self.best[entry] = min(self.best[entry], _rank(points, doc_id))
            self.counts[entry] += count
            return True
        if self.contents and self.bytes + len(content) + 200 > self.budget:
            return False
        self.slots[at] = len(self.contents)
        self.hashes.append(h)
        self.contents.append(content)
        self.best.append(_rank(points, doc_id))
        self.counts.append(count)
        self.bytes += len(content) + 200
        if 2 * len(self.contents) > len(self.slots):
            self.slots = np.full(2 * len(self.slots), -1, np.int64)
            for i, other in enumerate(self.hashes):
                self.slots[self._place(other, None)[0]] = i
        return True

    def records(self) -> Iterator[tuple[int, int, int | None, int, bytes]]:
        for h, (points, missing, doc_id), n, content in zip(self.hashes, self.best, self.counts, self.contents):
            yield h, -points, None if missing else doc_id, n, content


def _rank(points: int, doc_id: int | None) -> tuple[int, bool, int]:
    """Smaller is better: most code points, then smallest doc_id, null last."""
    return -points, doc_id is None, 0 if doc_id is None else doc_id


def _hash(content: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(content, digest_size=8).digest(), "little") >> 1


def _batches(rows: Iterator[tuple], schema: pa.Schema, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 + len(row[-1] or b"")
        if size > limit:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


_RECORD = pa.schema([("hash", pa.int64()), ("n_points", pa.int64()), ("doc_id", pa.int64()), ("group_size", pa.int64()), ("content", pa.binary())])
_SOLVED = _RECORD.insert(4, pa.field("sha", pa.binary()))


def _collapse(budget: int):
    """Map side: one record for each distinct content of the task, as often as the table fills."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            table = ContentTable(budget)
            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    text = text or ""
                    content = normalise(text.encode("utf-8", "surrogatepass"))
                    h = _hash(content)
                    if not table.add(h, content, len(text), doc_id, 1):
                        yield from table.records()
                        table.clear()
                        table.add(h, content, len(text), doc_id, 1)
            yield from table.records()

        yield from _batches(rows(), _RECORD)

    return run


def _solve(budget: int):
    """Reduce side: rows sorted by bucket. Solved contents carry their sha256 and no content;
    records of a bucket that does not fit come back with their content and no sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            table, bucket, full = ContentTable(budget), None, False

            def flush():
                for h, points, doc_id, n, content in table.records():
                    yield (h, points, doc_id, n, None, content) if full else (h, points, doc_id, n, hashlib.sha256(content).digest(), None)
                table.clear()

            for batch in batches:
                for b, h, points, doc_id, n, content in zip(*(c.to_pylist() for c in batch.columns)):
                    if b != bucket:
                        yield from flush()
                        bucket, full = b, False
                    if not table.add(h, content, points, doc_id, n):
                        full = True
                        yield from flush()
                        table.add(h, content, points, doc_id, n)
            yield from flush()

        yield from _batches(rows(), _SOLVED)

    return run


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table_bytes: int = TABLE_BYTES, buckets: int = BUCKETS) -> DataFrame:
    """One row for each distinct normalised content: (sha, keep_id, keep_points, group_size)."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    open_records = rows.mapInArrow(_collapse(min(table_bytes, 32 << 20)), RECORDS)
    solved, tasks = None, max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    for level in range(int(62 / math.log2(max(buckets, tasks, 2)))):
        bucket = F.pmod("hash", F.lit(max(buckets, tasks) ** (level + 1)))  # refines the level before
        dealt = open_records.select(bucket.alias("bucket"), "hash", "n_points", "doc_id", "group_size", "content")
        out = materialise(
            dealt.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(_solve(table_bytes), SOLVED), "grace-level")
        done = out.filter("sha is not null").select("sha", F.col("doc_id").alias("keep_id"), F.col("n_points").alias("keep_points"), "group_size")
        solved = done if solved is None else solved.unionByName(done)
        open_records = out.filter("sha is null").drop("sha")
        if open_records.isEmpty():
            return solved
    raise RuntimeError("distinct contents of one 63-bit hash outgrow the table; raise table_bytes")


def _joined(docs: DataFrame, id_col: str, text_col: str, options: dict) -> DataFrame:
    """``docs`` and its group's columns under names that start with ``__g_``."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    found = groups(docs, id_col, text_col, **options).select(
        F.lower(F.hex("sha")).alias("__g_sha"), F.col("keep_id").alias("__g_keep"), F.col("keep_points").alias("__g_points"), F.col("group_size").alias("__g_size"))
    bare = F.translate(text, " \t\n\x0b\x0c\r", "")
    rows = docs.withColumns({"__g_sha": F.sha2(bare.cast("binary"), 256), "__g_len": F.length(text)})
    return rows.join(found, "__g_sha").withColumn(
        "__g_kept", F.col(id_col).cast("bigint").eqNullSafe(F.col("__g_keep")) & (F.col("__g_len") == F.col("__g_points")))


def annotate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` plus keep_id, group_size, kept and text_sha256, one row per input row.

    Null text counts as empty. Of equal texts the row with the most code points, then the smallest
    doc_id (null last) stays; of repeated rows with that id and length every one is marked kept here,
    and :func:`dedup` keeps one of them. Empty table: no rows. Clashing extra columns: the four names
    replace columns of the same name.
    """
    marked = _joined(docs, id_col, text_col, options).withColumns({
        "keep_id": F.col("__g_keep"), "group_size": F.col("__g_size"), "kept": F.col("__g_kept"), "text_sha256": F.col("__g_sha")})
    return marked.drop("__g_sha", "__g_keep", "__g_points", "__g_size", "__g_len", "__g_kept")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns as they were (edge cases as in :func:`annotate`)."""
    first = Window.partitionBy("__g_sha").orderBy(F.col(text_col))
    kept = _joined(docs, id_col, text_col, options).filter("__g_kept")
    return kept.withColumn("__g_n", F.row_number().over(first)).filter("__g_n = 1").select(*[F.col(f"`{c}`") for c in docs.columns])
