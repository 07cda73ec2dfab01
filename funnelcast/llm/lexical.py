"""Ranked lexical search as maximum inner product search with norm buckets.

A document's impact vector holds, for each term that some query has, the integer impact of the term in the
document; a query's vector holds how often it has each term; a score is their inner product. Vectors go in
order of length. First the longest are searched (the norm bands at the top of the norm histogram); the k-th scores
found there are lower bounds for every query. Then all other vectors are searched in parallel, bucket by bucket in
falling order of length: the product of the lengths (Cauchy-Schwarz) drops a bucket for a query, and inside a
bucket coordinate bounds drop rows: the query's heaviest coordinates are multiplied out, and Cauchy-Schwarz
bounds the rest by what is left of both lengths. Survivors are scored in full in 64-bit integers. A row or
bucket is dropped only if its bound lies strictly below the k-th score, so ties are kept.

The texts are read once for each block of queries; what is kept of them are the query terms. Terms are compared by
64-bit hash. Query texts come in blocks of bounded size; weights and thresholds of one block go to the tasks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words
from .common import materialise, new_folder
from .toplist import NOTHING, Best, merged

#: Bytes of a term (ASCII digits and letters, A-Z in lower case, and all of other code points); 32 for the rest.
TERM = np.full(256, 32, np.uint8)
TERM[48:58], TERM[97:123], TERM[128:] = np.arange(48, 58), np.arange(97, 123), np.arange(128, 256)
TERM[65:91] = np.arange(97, 123)

VECTORS = "doc_id bigint, n bigint, terms array<int>, counts array<bigint>"
IMPACTS = "doc_id bigint, terms array<int>, impacts array<bigint>, norm double"
HITS = "query int, item_id bigint, doc_id bigint, score bigint"
_HITS = pa.schema([("query", pa.int32()), ("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])
NO_ID = (1 << 63) - 1
BUCKET = 4096
SLACK = 1 + 1e-9


def term_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every term, in order, and the terms of each text (null: none)."""
    buf, off = words.raw(texts)
    return words.hashes(TERM[buf], off)


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return np.asarray(column.flatten()), np.concatenate([[0], np.cumsum(np.asarray(column.value_lengths(), np.int64))])


def _counter(vocabulary: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Terms of each text and how often it has those of the (sorted) vocabulary."""
    mask = np.uint64((1 << 18) - 1)
    flag = np.zeros(1 << 18, bool)
    flag[(vocabulary & mask).astype(np.int64)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end in words.slices(batch.column(1)):
                part = batch.slice(first, end - first)
                h, n = term_hashes(part.column(1))
                maybe = np.flatnonzero(flag[(h & mask).astype(np.int64)])
                at = np.minimum(np.searchsorted(vocabulary, h[maybe]), len(vocabulary) - 1)
                hit = vocabulary[at] == h[maybe]
                doc = np.repeat(np.arange(len(part)), n)[maybe[hit]]
                pairs, counts = np.unique(doc * len(vocabulary) + at[hit], return_counts=True)
                ends = np.searchsorted(pairs, np.arange(len(part) + 1) * len(vocabulary)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    part.column(0).cast(pa.int64()), pa.array(n, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array((pairs % len(vocabulary)).astype(np.int32))),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(counts.astype(np.int64)))], ["doc_id", "n", "terms", "counts"])

    return run


def _weigher(weights: np.ndarray, n_docs: int, n_terms: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Impacts and length of each vector; rows without any impact, which score 0 for every query, are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, off = _lists(batch.column(2))
            tf, _ = _lists(batch.column(3))
            m = 25 + 75 * np.asarray(batch.column(1), np.int64) * n_docs // max(n_terms, 1)
            impacts = weights[terms] * (1_000_000_000 * tf // (1000 * tf + 8 * np.repeat(m, np.diff(off))))
            norm = np.sqrt(np.add.reduceat(np.append(impacts.astype(np.float64) ** 2, 0.0), off[:-1]) * (np.diff(off) > 0))
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(impacts)),
                                              pa.array(norm)], ["doc_id", "terms", "impacts", "norm"])
            yield out.filter(pa.array(norm > 0))

    return run


class Bucket:
    """Vectors of similar length: for each term the rows that have it."""

    def __init__(self, ids: np.ndarray, terms: np.ndarray, impacts: np.ndarray, sizes: np.ndarray, norms: np.ndarray) -> None:
        self.ids, self.norms, self.longest = ids, norms, float(norms.max()) * SLACK
        by_term = np.argsort(terms, kind="stable")
        self.rows, self.impacts = np.repeat(np.arange(len(ids)), sizes)[by_term], impacts[by_term]
        self.squares = self.impacts.astype(np.float64) ** 2
        self.present, self.begin = np.unique(terms[by_term], return_index=True)
        self.end = np.append(self.begin[1:], len(terms))

    def _lists(self, terms: np.ndarray, times: np.ndarray) -> Iterator[tuple[slice, int]]:
        at = np.minimum(np.searchsorted(self.present, terms), len(self.present) - 1)
        for i, t in zip(at[self.present[at] == terms].tolist(), times[self.present[at] == terms].tolist()):
            yield slice(self.begin[i], self.end[i]), t

    def survivors(self, query: Query, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the rows that coordinate bounds leave, all rows with a score of ``least`` or more among them."""
        score, left = np.zeros(len(self.ids), np.int64), self.norms**2
        for own, times in self._lists(query.focus, query.focus_times):
            score[self.rows[own]] += times * self.impacts[own]
            left[self.rows[own]] -= self.squares[own]
        # what is left is a difference of rounded squares: its error is far below this share of the whole
        bound = score * SLACK + query.rest_norm * np.sqrt(np.maximum(left, 0.0) + 1e-9 * self.norms**2)
        keep = bound >= least
        if not keep.any():
            return NOTHING
        for own, times in self._lists(query.rest, query.rest_times):
            score[self.rows[own]] += times * self.impacts[own]
        keep &= score >= max(least, 1)
        return self.ids[keep], score[keep]


class Query:
    """Terms (numbers in the vocabulary) and their times; the heaviest half is the focus."""

    def __init__(self, item: int | None, terms: np.ndarray, times: np.ndarray, weights: np.ndarray) -> None:
        by_weight = np.argsort(-(times * weights[terms]), kind="stable")
        terms, times = terms[by_weight], times[by_weight]
        half = (len(terms) + 1) // 2
        self.item, self.norm = item, math.sqrt(float((times.astype(np.float64) ** 2).sum())) * SLACK
        self.focus, self.focus_times, self.rest, self.rest_times = terms[:half], times[:half], terms[half:], times[half:]
        self.rest_norm = math.sqrt(float((self.rest_times.astype(np.float64) ** 2).sum())) * SLACK


def _searcher(queries: list[Query], least: list[int], k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's work: the k best rows for each query among those with its least score or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[Best] = [NOTHING] * len(queries)
        floor = list(least)
        for batch in batches:
            order = np.argsort(-np.asarray(batch.column(3)), kind="stable")
            for first in range(0, len(order), BUCKET):
                part = batch.take(pa.array(order[first : first + BUCKET]))
                (terms, off), (impacts, _) = _lists(part.column(1)), _lists(part.column(2))
                ids = part.column(0).fill_null(NO_ID).to_numpy()
                bucket = Bucket(ids, terms, impacts, np.diff(off), np.asarray(part.column(3)))
                for q, query in enumerate(queries):
                    if query.norm * bucket.longest < floor[q]:
                        continue
                    found, scores = bucket.survivors(query, floor[q])
                    if len(found):
                        best[q] = merged(best[q], scores, found, k)
                        if len(best[q][0]) == k:
                            floor[q] = max(floor[q], int(best[q][0][-1]))
        for q, (scores, ids) in enumerate(best):
            if len(ids):
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(ids), q), pa.int32()), pa.array([queries[q].item] * len(ids), pa.int64()),
                    pa.array(ids, pa.int64(), mask=ids == NO_ID), pa.array(scores, pa.int64())], schema=_HITS)

    return run


def _first(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _blocks(items: DataFrame, block_chars: int) -> Iterator[list[tuple[int | None, str]]]:
    held, chars = [], 0
    for row in items.toLocalIterator():
        if held and chars + len(row.text) > block_chars:
            yield held
            held, chars = [], 0
        held, chars = [*held, (row.item, row.text)], chars + len(row.text)
    if held:
        yield held


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
           item_text_col: str = "text", block_chars: int = 1 << 20, head: int = 2000) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents of highest score above 0 for each row of ``items``, all if fewer.

    Terms are runs of ASCII letters and digits (A-Z in lower case) and of code points above 127, over whole texts. Null or
    empty texts have no terms; an item without any gets no rows, and so does every item where ``docs`` is empty. Equal
    scores go by id, null ids last (2^63 - 1 is kept for them); repeated documents rank one by one, repeated items are
    answered one by one. Other columns are not read. ``block_chars`` of queries share a pass over ``docs``; ``head``
    rows at least are searched first for thresholds.
    """
    spark = docs.sparkSession
    path, result = new_folder(spark, "ranked"), "item_id bigint, rank int, doc_id bigint, score bigint"
    spark.createDataFrame([], result).write.parquet(path)
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    for block in _blocks(items.select(F.col(item_col).cast("bigint").alias("item"), F.coalesce(F.col(item_text_col), F.lit("")).alias("text")), block_chars):
        hashes, sizes = term_hashes(pa.array([text for _, text in block], pa.large_string()))
        vocabulary, numbers = np.unique(hashes, return_inverse=True)
        if not len(vocabulary):
            continue
        vectors = materialise(texts.mapInArrow(_counter(vocabulary), VECTORS), "term-counts")
        n_docs, n_terms = vectors.filter("n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = np.zeros(len(vocabulary), np.int64)
        for term, n in vectors.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # one row a query term
            df[term] = n
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)
        queries = []
        for (item, _), one in zip(block, np.split(numbers, np.cumsum(sizes)[:-1])):
            queries.append(Query(item, *np.unique(one, return_counts=True), weights))
        band = F.floor(F.log2("norm") * 4)
        impacts = materialise(vectors.mapInArrow(_weigher(weights, n_docs, n_terms), IMPACTS).sortWithinPartitions(F.desc("norm")), "impacts")
        above, cut = 0, None
        for r in sorted(impacts.groupBy(band.alias("band")).count().collect(), reverse=True):  # one row for each quarter of a power of two
            above, cut = above + r["count"], r["band"]
            if above >= head:
                break
        if cut is None:
            continue
        longest = materialise(_first(impacts.filter(band >= cut).mapInArrow(_searcher(queries, [1] * len(queries), k), HITS), k), "ranked-head")
        least = [1] * len(queries)
        for q, score in longest.filter(F.col("rank") == k).select("query", "score").collect():  # one row a query
            least[q] = score
        others = impacts.filter(band < cut).mapInArrow(_searcher(queries, least, k), HITS)
        _first(longest.drop("rank").unionByName(others), k).select("item_id", "rank", "doc_id", "score").write.mode("append").parquet(path)
    return spark.read.schema(result).parquet(path)
