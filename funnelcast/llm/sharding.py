"""Sharding by jump consistent hashing.

A row's shard follows from its key and the number of shards alone, without a table of ring positions:
a generator seeded with the key draws the shard counts at which the key would move ("jumps"), and the
last jump below the present count is its shard. A key jumps to count n with probability 1 / n and then
always into the newest shard, so one more shard takes just its own share and nothing moves between old
ones. The generator is the published one (a 64-bit linear congruence); Spark's integers raise an error on
overflow, so the product is built from 16-bit limbs. Everything is made of Spark's own functions.

Files: rows are grouped by (shard, piece), a piece being a few input splits, and written under their shard
with their place in the group. A hot key (or copies, or null ids) fills one shard, yet each group only has
that shard's part of a few splits, so no task holds more. Slots come from the counts of the groups.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import materialise

#: Fixed value: multiplier of the published generator.
MULTIPLIER = 2862933555777941757
_WORD = 0xFFFFFFFF


def _low_product(x: Column, factor: int) -> Column:
    """x * factor modulo 2^32 for 32-bit x and factor."""
    return (x * (factor & 0xFFFF) + F.shiftleft((x * (factor >> 16)).bitwiseAND(0xFFFF), 16)).bitwiseAND(_WORD)


def _advance(hi: Column, lo: Column) -> tuple[Column, Column]:
    """The 32-bit halves of key * MULTIPLIER + 1 modulo 2^64."""
    m_hi, m_lo = MULTIPLIER >> 32, MULTIPLIER & _WORD
    upper = lo * (m_lo >> 16)
    low = lo * (m_lo & 0xFFFF) + F.shiftleft(upper.bitwiseAND(0xFFFF), 16) + 1
    carry = F.shiftright(low, 32) + F.shiftright(upper, 16)
    return (carry + _low_product(hi, m_lo) + _low_product(lo, m_hi)).bitwiseAND(_WORD), low.bitwiseAND(_WORD)


def _state(hi: Column, lo: Column, shard: Column, jump: Column) -> Column:
    return F.struct(hi.alias("hi"), lo.alias("lo"), shard.alias("shard"), jump.alias("jump"))


def jumps(key: Column, shards: int) -> Column:
    """Struct with ``shard`` of the 64-bit ``key`` among ``shards`` and ``jump``, the shard it moves to next (>= ``shards``).

    A key makes about ln(shards) jumps; the few that make far more go on in a second loop over at most
    ``shards`` steps, so the result is exact for every key. Null key: null.
    """
    if shards < 1:
        raise ValueError("there must be one shard at least")

    def step(s: Column, _: Column) -> Column:
        hi, lo = _advance(s["hi"], s["lo"])
        jump = F.floor((s["jump"] + 1) * (F.lit(float(1 << 31)) / (F.shiftright(hi, 1) + 1)))
        return F.when(s["jump"] < shards, _state(hi, lo, s["jump"], jump)).otherwise(s)

    zero = F.lit(0).cast("bigint")
    key = key.cast("bigint")
    start = _state(F.shiftrightunsigned(key, 32), key.bitwiseAND(_WORD), zero - 1, zero)
    usual = F.aggregate(F.sequence(F.lit(1), F.lit(math.ceil(4 * math.log(shards)) + 8)), start, step)
    rest = F.transform(F.array(usual), lambda s: F.when(s["jump"] >= shards, s).otherwise(
        F.aggregate(F.sequence(F.lit(1), F.lit(shards)), s, step)))
    return F.when(key.isNotNull(), F.element_at(rest, 1))


def key_of(column: str | Column) -> Column:
    """64-bit key of an id of any type: the hash of its text, the same for 7 and '7' (null: a key of its own)."""
    return F.xxhash64((F.col(column) if isinstance(column, str) else column).cast("string"))


def place(docs: DataFrame, shards: int, id_col: str = "doc_id") -> DataFrame:
    """(row, shard, grown_shard): ``row`` holds every column of ``docs``, so no name can clash.

    ``grown_shard`` is the shard when one more is appended: the same or the new one. Null ids share one shard;
    repeated rows lie together; an empty table gives no rows. No shuffle.
    """
    placed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    placed = placed.withColumn("jumped", jumps(key_of(F.col("row")[id_col]), shards))
    return placed.select("row", F.col("jumped.shard").cast("int").alias("shard"),
                         F.when(F.col("jumped.jump") == shards, F.lit(shards)).otherwise(F.col("jumped.shard")).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int, id_col: str = "doc_id", text_col: str = "text", splits_per_piece: int = 8) -> StructType:
    """Write ``docs`` as Parquet below ``path``, one folder for each shard that has rows; returns the files' schema.

    A file's rows carry ``piece`` and ``place`` (from 1 in each (shard, piece), by id and text). Texts travel once,
    grouped by (shard, piece); ``splits_per_piece`` input splits make a piece. Null and empty texts, null ids,
    repeated rows and any further columns are kept as they are; an empty table writes a folder without rows.
    """
    piece = F.floor(F.spark_partition_id() / splits_per_piece).cast("int")
    rows = place(docs, shards, id_col).withColumn("piece", piece)
    by_id = Window.partitionBy("shard", "piece").orderBy(F.col("row")[id_col], F.xxhash64(F.col("row")[text_col]))
    rows = rows.withColumn("place", F.row_number().over(by_id)).select("row", "grown_shard", "piece", "place", "shard")
    rows.write.partitionBy("shard").option("compression", "zstd").parquet(path)
    return rows.schema


def read_shards(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """(row, shard, slot, grown_shard) from the files of :func:`write_shards`; slots run from 0 without gaps in each shard."""
    files = spark.read.schema(schema).parquet(path)
    before = Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    groups = files.groupBy("shard", "piece").agg(F.count(F.lit(1)).alias("n"))
    starts = materialise(groups.select("shard", "piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")), "shard-starts")
    return files.join(starts, ["shard", "piece"]).select("row", "shard", (F.col("start") + F.col("place") - 1).alias("slot"), "grown_shard")


def digest(sharded: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of :func:`read_shards`; a null text has no bytes (size 16, crc 0)."""
    text = F.coalesce(F.col("row")[text_col].cast("string"), F.lit(""))
    return sharded.select(F.col("row")[id_col].alias(id_col), (F.octet_length(text).cast("bigint") + 16).alias("size"),
                          F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("key").alias("law"), "shard", "slot", "grown_shard")
