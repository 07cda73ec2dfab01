"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source gets the same expected number of copies, target / source size;
its whole part is given at once and the fractional parts are rounded by the pivotal method:
two documents meet, mass moves from one to the other at random (each keeping its expectation)
until one of them is integral; the other goes on. Mass is counted in words, so a source's taken
words stay at its target but for one last document.

Distributed: documents are dealt into buckets by a hash of the row, so a hot source is spread
over all tasks; each (bucket, source) leaves at most one fractional document, and these meet
in a reduction tree of fan-in ``FAN_IN`` until one per source is left, which is rounded to the nearer
number of copies. Groups run from large to small documents, so large ones settle among themselves.
All chance comes from hashes of the row, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialise

FAN_IN = 64
EPS = 1e-9
ROWS = "bucket bigint, source string, doc_id bigint, size bigint, base int, f double, u double, copies int"
_ROWS = pa.schema([("bucket", pa.int64()), ("source", pa.string()), ("doc_id", pa.int64()), ("size", pa.int64()),
                   ("base", pa.int32()), ("f", pa.float64()), ("u", pa.float64()), ("copies", pa.int32())])


def source_targets(sizes: DataFrame, share: float = 1.5, cap: float = 2.0, weights: Sequence[float] = (3.0, 1.0, 2.0)) -> DataFrame:
    """(source, source_size, target) from (source, size) rows.

    Sources in code-point order, null last, take the weights in turn and share ``share`` times the
    total size by weight; a target stops at ``cap`` times its source's size and the excess is shared
    again by weight. Solved at once: with sources in order of cap / weight, the common level is the
    one at the first source that it leaves below its cap. The windows run over one row per source.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    w = total.withColumn("w", weight).withColumn("top", cap * F.col("source_size"))
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("top") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    level = (share * F.sum("source_size").over(everything) - F.coalesce(F.sum("top").over(before), F.lit(0.0))) / (
        F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    levels = w.withColumn("level", level)
    final = levels.withColumn("below", F.when(F.col("top") / F.col("w") > F.col("level") * (1 + 1e-12), F.col("level")))
    final = final.withColumn("final", F.min_by("below", F.when(F.col("below").isNotNull(), F.col("top") / F.col("w"))).over(everything))
    return final.select("source", "source_size", F.when(F.col("final").isNull(), F.col("top")).otherwise(F.least("top", F.col("final") * F.col("w"))).alias("target"))


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pivotal rounding along rows sorted by (bucket, source); a group's last fractional row has null copies."""
    group, held = None, None  # held: [row, f] still fractional
    for batch in batches:
        out = []
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            bucket, source, doc_id, size, base, f, u, _ = row
            if (bucket, source) != group:
                if held:
                    out.append((*held[0][:5], held[1], held[0][6], None))
                group, held = (bucket, source), None
            if size == 0 or f <= EPS or f >= 1 - EPS:
                out.append((*row[:7], base + (1 if size and f >= 1 - EPS else 0)))
                continue
            if held is None:
                held = [row, f]
                continue
            other, g = held
            ratio = size / other[3]
            up, down = min(1 - g, f * ratio), min(g, (1 - f) * ratio)  # mass that the held row may take or give
            if u < down / (up + down):
                g, f = g + up, f - up / ratio
            else:
                g, f = g - down, f + down / ratio
            held = None
            for r, x in ((other, g), (row, f)):
                if x <= EPS or x >= 1 - EPS:
                    out.append((*r[:7], r[4] + (x >= 1 - EPS)))
                else:
                    held = [r, x]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), _ROWS)], schema=_ROWS)
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([v], t.type) for v, t in zip((*held[0][:5], held[1], held[0][6], None), _ROWS)], schema=_ROWS)


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0,
         rows_per_bucket: int = 100_000, **target_options) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) for every row of ``docs``.

    ``size`` is the number of words, ``taken`` = copies x size, copies 0, 1 or 2 (at most ``cap``, rounded up).
    Null text: size 0, taken 0. Null source: a source of its own. Null doc_id and repeated rows: rows like
    any other. Empty table: no rows. All sizes 0: nothing is taken. Extra columns are ignored.
    """
    text = F.col(text_col).cast("string")
    sizes = materialise(docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("bigint"), F.lit(0)).alias("size"),
        F.xxhash64(F.col(id_col), text, F.lit(seed)).alias("h")), "mix-sizes")
    targets = materialise(source_targets(sizes, **target_options), "mix-targets")
    own = targets.select(F.col("source").alias("_s"), "source_size", "target")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    r = sizes.join(own, F.col("source").eqNullSafe(F.col("_s"))).withColumn("r", ratio + EPS / 2)
    n_buckets = max(1, -(-sizes.count() // rows_per_bucket))
    rows = r.select(
        F.pmod("h", F.lit(n_buckets)).alias("bucket"), "source", "doc_id", "size", F.floor("r").cast("int").alias("base"),
        (F.col("r") - F.floor("r")).alias("f"), ((F.xxhash64("h", F.lit(seed + 1)).bitwiseAND((1 << 53) - 1)) / float(1 << 53)).alias("u"),
        F.lit(None).cast("int").alias("copies"))
    done, level = None, 0
    while True:
        met = rows.repartition("bucket").sortWithinPartitions("bucket", "source", F.desc("size"), "doc_id", "u").select(*_ROWS.names).mapInArrow(_meet, ROWS)
        met = materialise(met, "mix-level")
        solved, rest = met.filter("copies is not null"), met.filter("copies is null")
        done = solved if done is None else done.unionByName(solved)
        if n_buckets == 1:
            last = rest.withColumn("copies", F.col("base") + (F.col("f") >= 0.5).cast("int"))
            done = done.unionByName(last)
            break
        n_buckets = -(-n_buckets // FAN_IN)
        rows, level = rest.withColumn("bucket", F.floor(F.col("bucket") / FAN_IN)).withColumn(
            "u", (F.xxhash64("doc_id", "size", "u", F.lit(level)).bitwiseAND((1 << 53) - 1)) / float(1 << 53)), level + 1
    return done.select("doc_id", "source", "size", "copies").join(own, F.col("source").eqNullSafe(F.col("_s"))).select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """``docs`` with every row repeated as often as the plan takes it (edge cases as in :func:`plan`)."""
    text = F.col(text_col).cast("string")
    key = F.xxhash64(F.col(id_col).cast("bigint"), F.col(source_col).cast("string"), F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("bigint"), F.lit(0)))
    chosen = plan(docs, id_col, text_col, source_col, **options).groupBy(F.xxhash64("doc_id", "source", "size").alias("__k")).agg(
        F.sort_array(F.collect_list("copies"), asc=False).alias("__copies"))  # one entry but for repeated rows
    nth = F.row_number().over(Window.partitionBy("__k").orderBy(text))
    rows = docs.withColumn("__k", key).withColumn("__n", nth).join(chosen, "__k")
    copies = F.element_at("__copies", F.col("__n"))
    return rows.withColumn("__c", copies).filter("__c > 0").withColumn("__c", F.explode(F.sequence(F.lit(1), F.col("__c")))).select(
        *[F.col(f"`{c}`") for c in docs.columns])
