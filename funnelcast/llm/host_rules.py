"""Host-level quality rules: rule failures per host, shrunk by an empirical beta prior.

Each document's rule statistics come from its whole text. Failures are counted per host
(partial aggregation before the shuffle, so a hot host is one row per task), the rates'
beta prior is fitted by the method of moments over hosts, each host's rate is shrunk to its
posterior mean, and the verdict per host is joined back: documents of a host whose shrunk
rate reaches ``max_rate`` go, others are judged by their own rules.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words

STATS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"
SYMBOL = np.zeros(256, np.uint8)
SYMBOL[list(b"#*$%&|<>")] = 1
LETTER = (~words.SPACE & ~((np.arange(256) >= 0x80) & (np.arange(256) < 0xC0))).astype(np.uint8)
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PCT = 20
MAX_RATE = 0.5


def repeat_words(h: np.ndarray, counts: np.ndarray, k: int = WINDOW) -> np.ndarray:
    """Words of each document that lie in a k-word window found twice or more in it."""
    out = np.zeros(len(counts), np.int64)
    win, per = words.windows(h, counts, k)
    if not len(win):
        return out
    doc = np.repeat(np.arange(len(counts)), per)
    key = words.mix64(win + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    hit = np.zeros(len(win), bool)
    hit[order[1:][same]] = hit[order[:-1][same]] = True
    where = np.flatnonzero(hit)
    if not len(where):
        return out
    begin = (np.cumsum(counts) - counts)[doc[where]] + where - (np.cumsum(per) - per)[doc[where]]
    edge = np.zeros(len(h) + 1, np.int64)
    np.add.at(edge, begin, 1)
    np.add.at(edge, begin + k, -1)
    covered = np.cumsum(edge[:-1]) > 0
    return np.bincount(np.repeat(np.arange(len(counts)), counts)[covered], minlength=len(counts))


def dup_lines(texts: list[bytes]) -> list[int]:
    """Lines with a word that equal an earlier line of their text."""
    out = []
    for t in texts:
        lines = [x for x in t.split(b"\n") if x.strip()]
        out.append(len(lines) - len(set(lines)))
    return out


def text_stats(text: pa.Array) -> list[pa.Array]:
    """The five statistics of a slice of texts."""
    buf, off = words.raw(text)
    h, counts = words.hashes(buf, off)
    data = buf.tobytes()
    cut = off.tolist()
    return [
        pa.array(counts), pa.array(words.sums(LETTER[buf], off)), pa.array(words.sums(SYMBOL[buf], off)),
        pa.array(dup_lines([data[a:b] for a, b in zip(cut[:-1], cut[1:])]), pa.int64()), pa.array(repeat_words(h, counts)),
    ]


def rule_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host: Column | None = None) -> DataFrame:
    """(doc_id, host) and the statistics of every whole text (null: no words)."""
    host = F.col("source") if host is None else host

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in words.slices(batch.column(2)):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *text_stats(part.column(2))],
                                                 names=["doc_id", "host", *[x.split()[0] for x in STATS.split(", ")]])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), host.cast("string").alias("host"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id bigint, host string, {STATS}")


def failed() -> Column:
    """A document's own rules: too few words, or too many of them in repeated windows."""
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words"))


def host_rates(stats: DataFrame) -> DataFrame:
    """(host, n_docs, n_failed, rate): the rate is shrunk by a beta prior fitted to all hosts.

    Method of moments over the hosts' raw rates, hosts weighing alike: mean m, population variance v,
    strength s = m (1 - m) / v - 1, at least 1; without spread (v = 0, or m of 0 or 1) s = 1e6, so all
    hosts take the common mean. rate = (n_failed + s m) / (n_docs + s). A null host is a host.
    """
    hosts = stats.groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(failed().cast("bigint")).alias("n_failed"))
    raw = F.col("n_failed") / F.col("n_docs")
    prior = hosts.agg(F.avg(raw).alias("m"), F.greatest(F.avg(raw * raw) - F.avg(raw) * F.avg(raw), F.lit(0.0)).alias("v"))
    strength = F.when(F.col("v") > 1e-12, F.greatest(F.col("m") * (1 - F.col("m")) / F.col("v") - 1, F.lit(1.0))).otherwise(1e6)
    p = prior.select("m", strength.alias("s"))
    m, s = p.select("m").scalar(), p.select("s").scalar()
    return hosts.withColumn("rate", (F.col("n_failed") + s * m) / (F.col("n_docs") + s))


def judge(docs: DataFrame, max_rate: float = MAX_RATE, **columns) -> DataFrame:
    """Per document: statistics, base_failed, host_rate and kept.

    Null text: no words (fails the length rule). Repeated rows: one result each. Empty table: no rows.
    Extra columns are ignored.
    """
    stats = rule_stats(docs, **columns)
    verdict = host_rates(stats).select(F.col("host").alias("_host"), F.col("rate").alias("host_rate"))
    return stats.join(verdict, F.col("host").eqNullSafe(F.col("_host"))).drop("_host").withColumns({
        "base_failed": failed(), "kept": ~failed() & (F.col("host_rate") < max_rate)})
