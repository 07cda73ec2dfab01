"""Packing without crossing documents: power-of-two decomposition.

A document of L ids (its tokens and one end id) is cut into ``L // max_len`` pieces of
``max_len`` ids and, for the rest, one piece for each set bit of ``L % max_len``, longest
first. Every piece has a power-of-two length and is a sequence of its own: nothing is
padded, no sequence crosses documents, and pieces of one length form a bucket from which
equal-shaped batches are drawn (:func:`write_buckets`).

The operator is a map over documents: no shuffle, no state between documents; memory is
bounded by a slice of a few MB of text (or one document, where that is longer).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .encode import encoder

MAX_LEN = 2048
SCHEMA = "doc_id bigint, doc_tokens bigint, start bigint, length bigint, bucket int, ids binary"


def cuts(total: int, max_len: int = MAX_LEN) -> list[int]:
    """Piece lengths of a document of ``total`` ids, in text order."""
    rest = total % max_len
    return [max_len] * (total // max_len) + [1 << b for b in range(max_len.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, max_len: int = MAX_LEN,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all ``docs``: one row per sequence.

    ``ids`` are little-endian unsigned 32-bit ids; ``start`` counts the document's ids before
    the piece; ``bucket`` is log2 of ``length``; ``sequence_id`` is unique over the result and
    ``offset`` (0) is the piece's place in its sequence.

    Null or empty text: one piece holding the end id. Null doc_id: kept as null. Repeated rows:
    packed each. Empty table: no rows. Further columns of ``docs`` are ignored, whatever their names.
    ``max_len`` must be a power of two.
    """
    if max_len < 1 or max_len & (max_len - 1):
        raise ValueError("max_len must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            text = batch.column(1).fill_null("")
            for a, b in words.slices(text, words.BLOCK_BYTES):
                ids, per = enc.encode(text.slice(a, b - a))
                totals = (per + 1).tolist()
                lengths = [cuts(t, max_len) for t in totals]
                counts = np.fromiter(map(len, lengths), np.int64, len(lengths))
                length = np.fromiter((x for one in lengths for x in one), np.int64, int(counts.sum()))
                full = np.insert(ids, np.cumsum(per), end_id).astype("<u4")
                ends = np.cumsum(length)
                per1 = per + 1
                before = np.cumsum(per1) - per1
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(a, b - a).take(pa.array(np.repeat(np.arange(b - a), counts))),
                    pa.array(np.repeat(per1, counts)),
                    pa.array(ends - length - np.repeat(before, counts)),
                    pa.array(length),
                    pa.array(np.log2(length).astype(np.int32)),
                    pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(np.concatenate([[0], ends * 4]).astype(np.int32)), pa.py_buffer(full)]),
                ], names=["doc_id", "doc_tokens", "start", "length", "bucket", "ids"])

    pieces = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)
    return pieces.withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("bigint")})


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Store packed pieces in one folder per length, the layout from which batches of one shape are read."""
    pieces.write.mode("overwrite").partitionBy("bucket").parquet(path)


def digest(pieces: DataFrame) -> DataFrame:
    """The packing contract's columns; the checksum is taken from the pieces' ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
