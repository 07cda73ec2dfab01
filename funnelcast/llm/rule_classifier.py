"""Quality classifier: a sparse ensemble of rules taken from tree paths.

Statistics of each whole text are computed once; a random forest over a sample of labelled rows gives
paths, each path from a root to a node is a conjunction of thresholds, and a lasso logistic regression
over the rules' truth values keeps few of them. The kept rules and weights are compiled into one column
expression over the statistics, so scoring is a plain projection.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words
from .common import crc_is, materialise
from .host_rules import dup_lines, repeat_words

STATS = ("n_words", "n_bytes", "word_bytes", "upper", "digit", "sign", "bang", "bar", "symbol", "end_sign", "wide", "line_words",
         "dup_lines", "distinct_words", "same_word", "repeat_5")
STAT_COLUMNS = tuple(f"__s_{x}" for x in STATS)
_CLASS = {"upper": bytes(range(65, 91)), "digit": b"0123456789", "sign": b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", "bang": b"!", "bar": b"|",
          "symbol": b"#*$%&<>", "wide": bytes(range(128, 256))}
_LUT = {name: np.isin(np.arange(256), list(chars)).astype(np.uint8) for name, chars in _CLASS.items()}


def text_stats(text: pa.Array) -> list[np.ndarray]:
    """STATS of a slice of texts; shares are 0 where there is nothing to divide by."""
    buf, off = words.raw(text)
    n = len(off) - 1
    h, counts = words.hashes(buf, off, lower=True)
    starts, ends, _ = words.spans(buf, off)
    doc = np.repeat(np.arange(n), counts)
    size = np.diff(off)
    in_words = np.bincount(doc, weights=ends - starts, minlength=n)
    per_byte = {name: words.sums(lut[buf], off) / np.maximum(in_words, 1) for name, lut in _LUT.items()}
    many = np.maximum(counts, 1)
    cut, data = off.tolist(), buf.tobytes()
    texts = [data[a:b] for a, b in zip(cut[:-1], cut[1:])]
    lines = np.array([t.count(b"\n") + 1 for t in texts])
    key = np.unique(words.mix64(h + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]
    same = np.zeros(len(h))
    same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    signed = _LUT["sign"][buf[ends - 1]] if len(ends) else np.empty(0)
    return [
        counts.astype(float), size.astype(float), in_words / many, *(per_byte[x] for x in ("upper", "digit", "sign", "bang", "bar", "symbol")),
        np.bincount(doc, weights=signed, minlength=n) / many, per_byte["wide"], counts / lines,
        np.array(dup_lines(texts)) / lines, np.bincount(doc[key], minlength=n) / many, np.bincount(doc, weights=same, minlength=n) / many,
        repeat_words(h, counts) / many,
    ]


def with_stats(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` and STATS as doubles named ``__s_*`` (null text: empty)."""
    own = text_col not in keep
    at = len(keep) if own else keep.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in words.slices(batch.column(at)):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *map(pa.array, text_stats(part.column(at)))],
                                                 names=[*keep, *STAT_COLUMNS])

    rows = docs.select(*[F.col(f"`{c}`") for c in keep], *([F.col(text_col).cast("string").alias("__text")] if own else []))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(keep)]]
    return rows.mapInArrow(run, ", ".join([*fields, *(f"{x} double" for x in STAT_COLUMNS)]))


Rule = tuple[tuple[int, bool, float], ...]


def tree_rules(node, path: Rule = ()) -> list[Rule]:
    """All paths from the root of a fitted tree to its other nodes: (statistic, at most?, threshold) conditions."""
    out = [path] if path else []
    if node.numDescendants() == 0:
        return out
    split = node.split()
    i, cut = split.featureIndex(), round(float(split.threshold()), 6)
    return out + tree_rules(node.leftChild(), (*path, (i, True, cut))) + tree_rules(node.rightChild(), (*path, (i, False, cut)))


def compile_rule(rule: Rule) -> Column:
    """The rule as a boolean column; of several conditions on a side of one statistic the tightest stays."""
    tight: dict[tuple[int, bool], float] = {}
    for i, low, cut in rule:
        have = tight.get((i, low))
        tight[i, low] = cut if have is None else (min(have, cut) if low else max(have, cut))
    out = F.lit(True)
    for (i, low), cut in sorted(tight.items()):
        column = F.col(STAT_COLUMNS[i])
        out = out & ((column <= cut) if low else (column > cut))
    return out


class RuleModel:
    """Rules, their weights and the intercept."""

    def __init__(self, rules: list[Rule], weights: list[float], intercept: float):
        kept = [(r, w) for r, w in zip(rules, weights) if abs(w) > 1e-6]
        self.rules, self.weights, self.intercept = [r for r, _ in kept], [w for _, w in kept], intercept

    def score(self) -> Column:
        z = F.lit(self.intercept)
        for rule, w in zip(self.rules, self.weights):
            z = z + F.when(compile_rule(rule), F.lit(w)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-z))


def train(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          max_rows: int = 20_000, trees: int = 24, depth: int = 3, lasso: float = 0.002, seed: int = 3) -> RuleModel:
    """Fit on at most ``max_rows`` labelled rows (smallest hashes of the id) where ``learn`` holds.

    Without both labels the score is the constant share of label 1 (0.5 without any).
    """
    wanted = labels.filter(learn & F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("__id"), F.col(label_col).cast("double").alias("label"))
    wanted = wanted.orderBy(F.xxhash64("__id"), "__id", "label").limit(max_rows)  # the bound of the broadcast below
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")).join(F.broadcast(wanted), "__id")
    sample = materialise(with_stats(rows, ["__id", "label"]).repartition(4, "__id").sortWithinPartitions("__id"), "rule-sample")
    n, ones = sample.agg(F.count(F.lit(1)), F.sum("label")).first()
    if not n or ones in (0, n):
        share = ones / n if n else 0.5
        return RuleModel([], [], float(np.clip(np.log((share + 1e-6) / (1 - share + 1e-6)), -13, 13)))
    data = sample.select("label", array_to_vector(F.array(*STAT_COLUMNS)).alias("features")).persist()
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, maxBins=64, featureSubsetStrategy="0.5", minInstancesPerNode=5, seed=seed).fit(data)
    rules = sorted({r for t in forest.trees for r in tree_rules(t._call_java("rootNode"))})
    data.unpersist()
    if not rules:
        return RuleModel([], [], float(np.log(ones / (n - ones))))
    truth = F.array(*[compile_rule(r).cast("double") for r in rules])
    facts = materialise(sample.select("label", truth.alias("t")), "rule-facts").select("label", array_to_vector("t").alias("features"))
    fit = LogisticRegression(regParam=lasso, elasticNetParam=1.0, standardization=False, maxIter=60).fit(facts)
    return RuleModel(rules, [float(x) for x in fit.coefficients], float(fit.intercept))


def classify(docs: DataFrame, labels: DataFrame, held_out: Column | None = None, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``; learns from labels of rows that are not held out.

    Null text: scored as an empty one. Null doc_id: scored, not held out, never labelled. Null or other labels:
    ignored. Repeated rows: one result each. Empty table: no rows. Extra columns are ignored.
    """
    held_out = crc_is(id_col, 3, 1) if held_out is None else held_out
    model = train(docs, labels, ~held_out, id_col, text_col, **options)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), held_out.alias("held_out"), F.col(text_col).alias("text"))
    return with_stats(rows, ["doc_id", "held_out"]).withColumn("score", model.score()).select(
        "doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accept(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5, **options) -> DataFrame:
    """``docs`` whose score is at least ``least``, all columns as they were (edge cases as in :func:`classify`)."""
    model = train(docs, labels, ~crc_is(id_col, 3, 1), id_col, text_col, **options)
    return with_stats(docs, docs.columns, text_col).filter(model.score() >= least).select(*[F.col(f"`{c}`") for c in docs.columns])
