"""Hard-negative mining by Fagin's threshold algorithm.

Vectors become integers, so every score is exact. Rows lie in blocks; each block has one sorted candidate
list for each dimension. For an anchor the lists are read from the end that its component favours (large
values where it is positive, small ones where it is negative, none where it is zero), a deeper stretch each
round. Every row met is scored at once by random access to its whole vector. The threshold, the anchor's
score of the values last read, bounds all rows not met: an anchor is done with a block when each of its
lists of best rows is full with its last score strictly above the threshold (a tie could still win by a
smaller id), or no row below the threshold can enter its score window.

A first pass finds each anchor's positives (best rows of its label), a second the best rows of other labels
in each positive's score window. Anchors go in rounds of bounded size to all tasks; a task keeps one short
list for each anchor over all its blocks, so later blocks stop earlier, and Spark's windows merge the lists.
In many dimensions the threshold falls slowly and most rows get scored; the stop then saves little, but
results are exact either way.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, new_folder
from .toplist import NOTHING, Best, merged

FOUND = "anchor_id bigint, positive_id bigint, positive_score bigint, id bigint, score bigint"
_FOUND = pa.schema([(c.split()[0], pa.int64()) for c in FOUND.split(", ")])
FIRST_DEPTH = 16


def vectors(items: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = 256) -> DataFrame:
    """(id, label, v): one row for each id, components floor(scale * x) as integers.

    Rows with a null id, label, vector or component, or one that is not finite, take no part. Of rows with the
    same id the one with the smallest label, then vector, stays. Shorter vectors count as padded with zeros.
    """
    x = F.col(vector_col).cast("array<double>")
    rows = items.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("bigint").alias("label"), x.alias("x")).filter(
        F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull()).filter(
        F.forall("x", lambda c: F.coalesce((F.abs(c) < float("inf")) & ~F.isnan(c), F.lit(False))))
    whole = rows.select("id", F.struct("label", F.transform("x", lambda c: F.floor(scale * c)).alias("v")).alias("own"))
    return whole.groupBy("id").agg(F.min("own").alias("own")).select("id", "own.label", "own.v")


def _matrix(column: pa.Array, dims: int = 0) -> np.ndarray:
    """Rows of a list column as one integer matrix, padded with zeros to the longest."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.asarray(column.value_lengths(), np.int64)
    out = np.zeros((len(column), max(dims, int(lengths.max(initial=0)))), np.int64)
    out[np.arange(out.shape[1]) < lengths[:, None]] = np.asarray(column.flatten(), np.int64)
    return out


def _exact(v: np.ndarray, a: np.ndarray) -> type:
    """A type that holds every partial sum of v @ a exactly."""
    bound = int(np.abs(v).max(initial=0)) * int(np.abs(a).max(initial=0)) * v.shape[1]
    if bound >= 1 << 56:
        raise ValueError("components are too large for 64-bit scores")
    return np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64


class Block:
    """Some rows with a sorted list for each dimension."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, v: np.ndarray, of: type) -> None:
        self.ids, self.labels, self.v = ids, labels, v.astype(of)
        by_dim = np.ascontiguousarray(v.T)
        self.order = np.argsort(by_dim, axis=1, kind="stable").astype(np.int32)
        self.values = np.take_along_axis(by_dim, self.order, 1)

    def rounds(self, a: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int | None]]:
        """Rows newly met with their scores, and the threshold that bounds all others (None: no others)."""
        n = len(self.ids)
        up, down, point = np.flatnonzero(a < 0), np.flatnonzero(a > 0), a.astype(self.v.dtype)
        met, scored = np.zeros(n, bool), np.zeros(n, bool)
        lo, hi = 0, min(FIRST_DEPTH, n) if len(up) + len(down) else n
        while True:
            if hi == n:
                met[:] = True
            else:
                met[self.order[up, lo:hi]] = True
                met[self.order[down, n - hi : n - lo]] = True
            new = np.flatnonzero(met & ~scored)
            scored[new] = True
            scores = np.rint(self.v[new] @ point).astype(np.int64)
            if scored.all():
                yield new, scores, None
                return
            yield new, scores, int(a[up] @ self.values[up, hi - 1]) + int(a[down] @ self.values[down, n - hi])
            lo, hi = hi, min(2 * hi, n)


def _closed(best: Best, threshold: int | None, k: int) -> bool:
    return threshold is None or len(best[0]) == k and int(best[0][-1]) > threshold


def positives_of(block: Block, anchor: int, label: int, a: np.ndarray, best: Best, k: int) -> Best:
    """The k best rows of the anchor's label, itself left out, among ``best`` and the block."""
    for new, scores, threshold in block.rounds(a):
        own = (block.labels[new] == label) & (block.ids[new] != anchor)
        best = merged(best, scores[own], block.ids[new[own]], k)
        if _closed(best, threshold, k):
            break
    return best


def negatives_of(block: Block, label: int, a: np.ndarray, windows: list[tuple[int, int]], best: list[Best], k: int) -> list[Best]:
    """For each (low, high) window, in hundredths of a score, the k best rows of other labels within it."""
    best, live = list(best), [w for w, (low, high) in enumerate(windows) if low <= high]
    for new, scores, threshold in block.rounds(a) if live else ():
        other = block.labels[new] != label
        ids, scores = block.ids[new[other]], scores[other]
        hundred = 100 * scores
        for w in live:
            low, high = windows[w]
            inside = (hundred >= low) & (hundred <= high)
            best[w] = merged(best[w], scores[inside], ids[inside], k)
        live = [w for w in live if not _closed(best[w], threshold, k) and not (threshold is not None and 100 * threshold < windows[w][0])]
        if not live:
            break
    return best


def _blocks(batches: Iterator[pa.RecordBatch], rows_per_block: int) -> Iterator[pa.Table]:
    held, n = [], 0
    for batch in batches:
        for at in range(0, len(batch), rows_per_block):
            part = batch.slice(at, rows_per_block)
            if n + len(part) > rows_per_block and n:
                yield pa.Table.from_batches(held)
                held, n = [], 0
            held, n = [*held, part], n + len(part)
    if n:
        yield pa.Table.from_batches(held)


def _search(anchors: np.ndarray, labels: np.ndarray, v: np.ndarray, given: list[list[tuple[int, int]]] | None, k: int, low: int, high: int,
            rows_per_block: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's work: the best rows of its blocks for every anchor, positives, or negatives where ``given`` has (positive, score)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [[NOTHING] * (len(given[i]) if given else 1) for i in range(len(anchors))]
        for part in _blocks(batches, rows_per_block):
            own = _matrix(part.column("v"), v.shape[1])
            a = v if own.shape[1] == v.shape[1] else np.pad(v, ((0, 0), (0, own.shape[1] - v.shape[1])))
            block = Block(part.column("id").to_numpy(), part.column("label").to_numpy(), own, _exact(own, a))
            for i, anchor in enumerate(anchors):
                if given is None:
                    best[i][0] = positives_of(block, anchor, labels[i], a[i], best[i][0], k)
                else:
                    windows = [(low * s, high * s) for _, s in given[i]]
                    best[i] = negatives_of(block, labels[i], a[i], windows, best[i], k)
        for first in range(0, len(anchors), 1000):
            rows = [(np.full(len(s), anchors[i]), np.full(len(s), p[0]), np.full(len(s), p[1]), ids, s)
                    for i in range(first, min(first + 1000, len(anchors)))
                    for p, (s, ids) in zip(given[i] if given else [(-1, 0)], best[i]) if len(s)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*rows)], schema=_FOUND)

    return run


def _first(found: DataFrame, k: int, *keys: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
         rows_per_block: int = 8192, anchors_per_round: int = 20_000) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from :func:`vectors` rows.

    ``is_anchor`` is a condition on id, label and v. Each anchor's positives are its first ``positives`` other rows of
    its label; for each of them its first ``negatives`` rows of other labels with low * positive_score <= 100 *
    score <= high * positive_score are returned. Order: higher scores, then smaller ids. An anchor without other
    rows of its label, or a positive with an empty window (always so for a negative score), gives no rows; ties
    go by id; an empty table gives none. All rows are searched for every anchor.
    """
    spark = rows.sparkSession
    rows = materialise(rows, "vectors")
    rows = materialise(rows.repartition(max(1, -(-rows.count() // rows_per_block)), "id"), "vector-blocks")
    anchors = materialise(rows.filter(is_anchor), "anchors")
    n_rounds = -(-anchors.count() // anchors_per_round)
    path = new_folder(spark, "negatives")
    result = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    spark.createDataFrame([], result).write.parquet(path)
    for number in range(n_rounds):
        some = anchors.filter(F.pmod(F.xxhash64("id"), F.lit(n_rounds)) == number).orderBy("id").toArrow()
        ids, labels, v = some["id"].to_numpy(), some["label"].to_numpy(), _matrix(some["v"])
        search = _search(ids, labels, v, None, positives, low, high, rows_per_block)
        same = _first(rows.mapInArrow(search, FOUND), positives, "anchor_id").select("anchor_id", "rank", "id", "score").toArrow()
        given: dict[int, list[tuple[int, int, int]]] = {}
        for anchor, *one in zip(*(c.to_pylist() for c in same.columns)):
            given.setdefault(anchor, []).append(tuple(one))
        pairs = [[(i, s) for _, i, s in sorted(given.get(int(anchor), []))] for anchor in ids]
        search = _search(ids, labels, v, pairs, negatives, low, high, rows_per_block)
        other = _first(rows.mapInArrow(search, FOUND), negatives, "anchor_id", "positive_id")
        other.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score",
                     F.col("score").alias("negative_score")).write.mode("append").parquet(path)
    return spark.read.schema(result).parquet(path)
