"""Language identification with a linear-chain conditional random field over words.

A word's features are its affixes (first and last one to three bytes), its byte trigrams, and the
languages whose lexicon holds it; trailing signs are left out. Feature weights and transitions between
the languages of neighbouring words are learnt together by gradient ascent on the conditional likelihood,
whose expectations forward-backward gives. Training sequences splice runs of words from documents of
several languages, so that transitions see switches as code-switched text has them.

Training: a sample of at most ``per_language`` documents of each language (by hash of the id, whole texts),
dealt over partitions; each round every partition makes one pass from the common weights and the results
are averaged. Prediction: forward-backward over all words of each whole text; a text's language has the
largest mean marginal, which is the score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .chains import smooth
from .common import crc_is, materialise

BITS = 15
DIM = 1 << BITS
GRAMS = 10
_SIGNS = np.zeros(256, bool)
_SIGNS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


class Model:
    """Weights by (feature, language), transition weights, and each language's lexicon of word hashes."""

    def __init__(self, langs: list[str]):
        k = len(langs)
        self.langs = langs
        self.w = np.zeros((DIM + k + 1, k))
        self.move = np.eye(k)
        self.lexicon = np.empty(0, np.uint64)
        self.lexicon_lang = np.empty(0, np.int64)


def word_types(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(type of each word, words per document, hash of each type, feature indexes of each type)."""
    h, counts = words.hashes(buf, off, lower=True)
    starts, ends, _ = words.spans(buf, off)
    distinct, first, types = np.unique(h, return_index=True, return_inverse=True)
    a, b = starts[first], ends[first].copy()
    for _ in range(4):
        b -= (b - a > 1) & _SIGNS[buf[b - 1]]
    lower = np.append(words.LOWER[buf], 0).astype(np.uint64)
    n = b - a

    def at(i):
        return np.where(i < b, lower[np.minimum(i, len(buf))], np.uint64(0))

    cols = []

    def add(kind: int, value: np.ndarray, there: np.ndarray):
        cols.append(np.where(there, words.mix64(value * np.uint64(64) + np.uint64(kind)) % np.uint64(DIM), np.uint64(DIM)).astype(np.int32))

    head, tail = np.zeros(len(a), np.uint64), np.zeros(len(a), np.uint64)
    for i in range(3):
        head = head * np.uint64(257) + at(a + i) + np.uint64(1)
        tail = tail * np.uint64(257) + lower[np.maximum(b - 1 - i, a)] + np.uint64(1)
        add(1 + i, head, n > i)
        add(5 + i, tail, n > i)
    add(9, words.mix64(head) + tail + n.astype(np.uint64), n <= 5)
    for i in range(GRAMS):
        p = a + i if i < 6 else np.maximum(b - 3 - (i - 6), a)
        value = (at(p) * np.uint64(257) + at(p + 1)) * np.uint64(257) + at(p + 2)
        add(10, value, (p + 3 <= b) & ((i < 6) | (b - 3 - (i - 6) >= a + 6)))
    return types, counts, distinct, np.stack(cols, axis=1) if cols else np.empty((0, 0), np.int32)


def emissions(model: Model, hashes: np.ndarray, features: np.ndarray) -> np.ndarray:
    """Weight of each language for each word type."""
    e = np.zeros((len(hashes), len(model.langs)))
    for column in features.T:
        e += model.w[column]
    if len(model.lexicon):
        at = np.minimum(np.searchsorted(model.lexicon, hashes), len(model.lexicon) - 1)
        hit = model.lexicon[at] == hashes
        e[hit] += model.w[DIM + 1 + model.lexicon_lang[at[hit]]]
    return e


def _potentials(e: np.ndarray) -> np.ndarray:
    return np.exp(e - e.max(axis=1, keepdims=True)).astype(np.float32) + np.float32(1e-12)


def marginals(model: Model, types: np.ndarray, e: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Probability of each language at each word, given its whole sequence."""
    k = len(model.langs)
    return smooth(_potentials(e)[types], np.ones(k), np.exp(model.move - model.move.max()), lens, True)[1]


def _splice(lens: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word order, label of each, sequence lengths): runs of 6 to 40 words, taken in turn from four documents."""
    begins = np.cumsum(lens) - lens
    order, tags, sizes = [], [], []
    for g in range(0, len(lens), 4):
        left = [[int(begins[d]), int(begins[d] + lens[d]), int(labels[d])] for d in range(g, min(g + 4, len(lens))) if lens[d]]
        turn, size = g, 0
        while left:
            turn = (turn * 1103515245 + 12345) & 0x7FFFFFFF
            pick = left[(turn >> 8) % len(left)]
            stop = min(pick[1], pick[0] + 6 + (turn >> 12) % 35)
            order.append(np.arange(pick[0], stop))
            tags.append(np.full(stop - pick[0], pick[2]))
            size += stop - pick[0]
            pick[0] = stop
            left = [x for x in left if x[0] < x[1]]
            if size >= 300 or not left:
                sizes.append(size)
                size = 0
    if not order:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(order), np.concatenate(tags), np.array(sizes)


def _pass(model: Model, rate: float):
    """One pass of a partition over its (label, text) rows; returns its weights, and 1 to count it."""
    k = len(model.langs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, move = model.w.copy(), model.move.copy()
        local = Model(model.langs)
        local.lexicon, local.lexicon_lang = model.lexicon, model.lexicon_lang
        seen = False
        for batch in batches:
            for a, b in words.slices(batch.column(1), 1 << 20):
                buf, off = words.raw(batch.column(1).slice(a, b - a))
                types, counts, hashes, features = word_types(buf, off)
                if not len(types):
                    continue
                seen = True
                order, tags, sizes = _splice(counts, batch.column(0).slice(a, b - a).to_numpy())
                ends = np.cumsum(sizes)
                for s in range(0, len(sizes), 32):
                    lo, hi = (0 if s == 0 else ends[s - 1]), ends[min(s + 32, len(sizes)) - 1]
                    own, inverse = np.unique(types[order[lo:hi]], return_inverse=True)
                    local.w, local.move = w, move
                    e = emissions(local, hashes[own], features[own])
                    tag, lens = tags[lo:hi], sizes[s : s + 32]
                    _, prob, pairs, _ = smooth(_potentials(e)[inverse], np.ones(k), np.exp(move - move.max()), lens, True)
                    error = -prob.astype(np.float64)
                    error[np.arange(len(tag)), tag] += 1
                    step = rate / np.sqrt(hi - lo)
                    by_type = np.stack([np.bincount(inverse, weights=error[:, j], minlength=len(own)) for j in range(k)], axis=1)
                    for column in features[own].T:
                        np.add.at(w, column, step * by_type)
                    w[DIM] = 0
                    if len(model.lexicon):
                        at = np.minimum(np.searchsorted(model.lexicon, hashes[own]), len(model.lexicon) - 1)
                        hit = model.lexicon[at] == hashes[own]
                        np.add.at(w, DIM + 1 + model.lexicon_lang[at[hit]], step * by_type[hit])
                    follow = np.ones(len(tag) - 1, bool)
                    follow[np.cumsum(lens)[:-1] - 1] = False
                    true = np.zeros((k, k))
                    np.add.at(true, (tag[:-1][follow], tag[1:][follow]), 1)
                    move += step * (true - pairs)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary()), pa.array([move.tobytes()], pa.binary())], names=["w", "move"])

    return run


def _lexicon(langs: int, least: int = 3, share: float = 0.9):
    """Word hashes that belong to one language within a partition's sample, with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = words.raw(batch.column(1))
            h, counts = words.hashes(buf, off, lower=True)
            label = np.repeat(batch.column(0).to_numpy(), counts)
            distinct, inverse = np.unique(h, return_inverse=True)
            table = np.stack([np.bincount(inverse[label == j], minlength=len(distinct)) for j in range(langs)], axis=1)
            for j in range(langs):
                some = table[:, j] > 0
                yield pa.RecordBatch.from_arrays([pa.array(distinct[some].view(np.int64)), pa.array(np.full(int(some.sum()), j, np.int64)), pa.array(table[some, j].astype(np.int64))], names=["word", "label", "c"])

    return run


def train(docs: DataFrame, learn, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 300,
          rounds: int = 4, partitions: int = 6, rate: float = 1.0) -> Model:
    """Fit on rows where ``learn`` holds and the language is not null."""
    rows = docs.filter(learn & F.col(lang_col).isNotNull()).select(
        F.col(id_col).cast("string").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row a language
    model = Model(sorted(sizes))
    if len(sizes) < 1:
        return model
    draw = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    limit, label = F.lit(0), F.lit(0)
    for i, lang in enumerate(model.langs):
        limit = F.when(F.col("lang") == lang, int(min(1.0, per_language / sizes[lang]) * (1 << 30))).otherwise(limit)
        label = F.when(F.col("lang") == lang, i).otherwise(label)
    sample = materialise(rows.filter(draw < limit).select(label.cast("bigint").alias("label"), "text", F.xxhash64("id", F.lit(1)).alias("h"))
                         .repartition(partitions, "h").sortWithinPartitions("h", "text").select("label", "text"), "crf-sample")
    k = len(model.langs)
    counts = sample.mapInArrow(_lexicon(k), "word bigint, label bigint, c bigint").groupBy("word", "label").agg(F.sum("c").alias("c"))
    best = counts.groupBy("word").agg(F.sum("c").alias("all"), F.max(F.struct("c", "label")).alias("top")).filter("all >= 5 AND top.c >= 0.9 * all")
    lex = best.select("word", "top.label").toPandas()  # bounded by the sample
    hashes = lex["word"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    model.lexicon, model.lexicon_lang = hashes[order], lex["label"].to_numpy(np.int64)[order]
    for r in range(rounds):
        got = sample.mapInArrow(_pass(model, rate / (1 + r)), "w binary, move binary").collect()  # one row a partition
        if not got:
            break
        model.w = np.mean([np.frombuffer(x["w"]).reshape(model.w.shape) for x in got], axis=0)
        model.move = np.mean([np.frombuffer(x["move"]).reshape(k, k) for x in got], axis=0)
    model.w = model.w.astype(np.float32)
    return model


_LABELS = ("doc_id bigint, held_out boolean, n_words bigint, means array<struct<lang:string,mean:double>>, "
           "runs array<struct<start:bigint,end:bigint,n_words:bigint,lang:string,probability:double>>")


def _label(model: Model):
    """Per document: mean marginal of each language, and its runs of words of one language."""
    k = len(model.langs)
    langs = np.array([*model.langs, "und"], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in words.slices(batch.column(3)):
                part = batch.slice(a, b - a)
                buf, off = words.raw(part.column(3))
                types, counts, hashes, features = word_types(buf, off)
                starts, ends, _ = words.spans(buf, off)
                doc = np.repeat(np.arange(b - a), counts)
                best, top = np.full(len(types), k), np.zeros(len(types))
                known, mean = np.zeros(b - a, bool), np.zeros((b - a, k))
                if k and len(types):
                    prob = marginals(model, types, emissions(model, hashes, features), counts)
                    mean = np.stack([np.bincount(doc, weights=prob[:, j], minlength=b - a) for j in range(k)], axis=1) / np.maximum(counts, 1)[:, None]
                    known = part.column(2).to_numpy(zero_copy_only=False).astype(bool) & (counts > 0)
                    sure = known[doc]
                    best = np.where(sure, prob.argmax(axis=1), k)
                    top = np.where(sure, np.clip(prob.max(axis=1), 0, 1), 0.0)
                new = np.ones(len(types), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (best[1:] != best[:-1])
                at = np.flatnonzero(new)
                size = np.diff(np.append(at, len(types)))
                chars = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])  # characters before each byte
                zero = chars[off[:-1]][doc[at]]
                runs = pa.StructArray.from_arrays([
                    pa.array(chars[starts[at]] - zero), pa.array(chars[ends[at + size - 1]] - zero), pa.array(size),
                    pa.array(langs[best[at]].tolist(), pa.string()), pa.array((np.add.reduceat(top, at) if len(at) else top) / size),
                ], names=["start", "end", "n_words", "lang", "probability"])
                held = np.concatenate([[0], np.cumsum(np.bincount(doc[at], minlength=b - a))])
                shares = pa.StructArray.from_arrays([pa.array(model.langs * int(known.sum()), pa.string()), pa.array(mean[known].ravel())], names=["lang", "mean"])
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(1), pa.array(counts.astype(np.int64)),
                    pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(known) * k]), pa.int32()), shares),
                    pa.ListArray.from_arrays(pa.array(held, pa.int32()), runs),
                ], names=["doc_id", "held_out", "n_words", "means", "runs"])

    return run


def label_words(docs: DataFrame, held_out=None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """(doc_id, held_out, n_words, means, runs) of every whole text; learns from rows that are not held out.

    ``runs`` are neighbouring words of one most probable language, in order and without gaps: first and end character
    (from 0, end exclusive), words, language, mean probability. ``means`` has each language's mean marginal.
    Null or empty text: no runs. A text without a letter, or no training rows: one run ``und`` of probability 0, no means.
    Null lang: labelled, not learnt from. Null doc_id: not held out. Repeated rows: one result each.
    Empty table: no rows. Extra columns are ignored.
    """
    held_out = crc_is(id_col, 4, 2) if held_out is None else held_out
    model = train(docs, ~held_out, id_col, text_col, lang_col, **options)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), held_out.alias("held_out"), F.regexp_like(text, F.lit(r"\p{L}")).alias("letters"), text.alias("text"))
    return rows.mapInArrow(_label(model), _LABELS)


def identify(docs: DataFrame, held_out=None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every whole text, from the means of :func:`label_words`.

    Null text or a text without a letter: ``und``, score 0. Without training rows all texts are ``und``.
    """
    top = F.array_max("means.mean")
    return label_words(docs, held_out, id_col, text_col, lang_col, **options).select(
        "doc_id", "held_out", F.coalesce(F.get("means.lang", F.array_position("means.mean", top).cast("int") - 1), F.lit("und")).alias("lang_pred"),
        F.coalesce(F.least(F.greatest(top, F.lit(0.0)), F.lit(1.0)), F.lit(0.0)).alias("score"))
