"""Jump consistent hashing against a plain version of the published loop."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from funnelcast.llm import sharding
from funnelcast.llm.common import new_folder

MASK = (1 << 64) - 1


def jump(key: int, shards: int) -> int:
    b, j, key = -1, 0, key & MASK
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) & MASK
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_published_values(spark):
    cases = [(1, 1, 0), (42, 57, 43), (0xDEAD10CC, 1, 0), (0xDEAD10CC, 666, 361), (256, 1024, 520)]
    for key, shards, want in cases:
        assert jump(key, shards) == want
        assert spark.range(1).select(sharding.jumps(F.lit(key).cast("bigint"), shards)["shard"]).first()[0] == want


@pytest.mark.parametrize("shards", [1, 2, 40, 1000])
def test_equals_the_plain_loop(spark, shards):
    keys = spark.range(3000).select(F.xxhash64("id").alias("k")).union(spark.sql("select explode(array(0L, -1L, 9223372036854775807L, -9223372036854775807L - 1L))"))
    rows = keys.select("k", sharding.jumps(F.col("k"), shards).alias("s")).collect()
    for r in rows:
        assert r.s.shard == jump(r.k, shards)
        assert (shards if r.s.jump == shards else r.s.shard) == jump(r.k, shards + 1)


def test_growth_moves_only_into_the_new_shard_and_its_share(spark):
    rows = sharding.place(spark.range(40_000).select(F.col("id").alias("doc_id")), 40).select("shard", "grown_shard").collect()
    sizes = Counter(r.shard for r in rows)
    assert set(sizes) == set(range(40)) and max(sizes.values()) < 1.2 * 1000 and min(sizes.values()) > 0.8 * 1000
    moved = [r for r in rows if r.shard != r.grown_shard]
    assert {r.grown_shard for r in moved} == {40} and 0.8 < len(moved) / (40_000 / 41) < 1.2


def whole(spark, docs, shards=40, **options):
    path = new_folder(spark, "test-shards")
    return sharding.read_shards(spark, path, sharding.write_shards(docs, path, shards, **options))


def holds(sharded, docs, shards=40):
    rows = sharding.digest(sharded).collect()
    want = Counter((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in docs.select("doc_id", "text").collect())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    slots, homes = defaultdict(list), defaultdict(set)
    for r in rows:
        slots[r.shard].append(r.slot)
        homes[r.doc_id].add((r.shard, r.grown_shard))
        assert 0 <= r.shard < shards and r.grown_shard in (r.shard, shards) and r.law == "key"
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(h) == 1 for h in homes.values())


def test_whole_table_and_odd_rows(spark, documents, odd, none):
    holds(whole(spark, documents), documents)
    holds(whole(spark, odd, 3, splits_per_piece=1), odd, 3)
    assert sharding.digest(whole(spark, none)).count() == 0


def test_shard_does_not_depend_on_partitioning_or_id_type(spark, documents):
    first = {(r.doc_id, r.shard) for r in sharding.place(documents, 40).select("row.doc_id", "shard").collect()}
    other = documents.repartition(5).withColumn("doc_id", F.col("doc_id").cast("string"))
    assert {(int(r.doc_id), r.shard) for r in sharding.place(other, 40).select("row.doc_id", "shard").collect()} == first


def test_a_hot_id_is_split_over_pieces(spark):
    docs = spark.range(6000, numPartitions=12).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("doc_id"), F.lit("same text").alias("text"))
    path = new_folder(spark, "test-shards")
    schema = sharding.write_shards(docs, path, 4, splits_per_piece=2)
    largest = spark.read.parquet(path).groupBy("shard", "piece").count().agg(F.max("count")).first()[0]
    assert largest < 6000 / 3
    holds(sharding.read_shards(spark, path, schema), docs, 4)


def test_extra_columns_with_clashing_names_survive(spark):
    names = ["doc_id", "text", "shard", "slot", "piece", "place", "grown_shard", "jumped", "row", "start"]
    docs = spark.createDataFrame([(1, "a", *"stuvwxyz"), (2, None, *"STUVWXYZ")], ", ".join(f"`{n}` {'bigint' if n == 'doc_id' else 'string'}" for n in names))
    rows = whole(spark, docs, 5).select("row.*").collect()
    assert sorted(tuple(r) for r in rows) == sorted(tuple(r) for r in docs.collect()) and list(rows[0].asDict()) == names


def test_only_spark_functions(spark, documents):
    path = new_folder(spark, "test-shards")
    schema = sharding.write_shards(documents, path, 40)
    plan = sharding.digest(sharding.read_shards(spark, path, schema))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    with pytest.raises(ValueError):
        sharding.jumps(F.lit(1), 0)
