"""Hidden Markov language model: Baum-Welch counts summed across partitions, scaled forward scoring.

Words are emitted through classes: a state emits a class and the class a word by its training count,
P(word | state) = P(class | state) (c + 1) / (S + 1), with S the sum of c + 1 over the class's known
words and 1 / (S + 1) left for its unknown ones. A word frequent enough is in one of FREQUENT hash
classes, any other in a class of its form (its last bytes); the end token is a class by itself. So the
trained tables have a fixed size (states x CLASSES) while word counts grow with the corpus and stay in
DataFrames.

Texts become chunks of about ``chunk_bytes``, each one row: its distinct words, and the texts as codes
into them. Corpus counts are summed by word and carried back to the chunks that hold the word (one row
per chunk and word, so a frequent word weighs one row a chunk). Training rounds and scoring are then
maps over chunks; a round returns expected counts by class, summed before they reach the driver
(CLASSES x states numbers). Every training document takes part in every one of the ``warm_rounds + rounds``
rounds, whatever the size of the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words
from .chains import expected, log_weights
from .common import crc_is, discard, materialise

FREQUENT, FORMS = 1 << 14, 1 << 11
END = FREQUENT + FORMS
CLASSES = END + 1
CHUNK_BYTES = 12 << 20
END_HASH = 0x2545F4914F6CDD1D

_CHUNK = "chunk bigint, doc_ids array<bigint>, held array<boolean>, lens array<int>, codes binary, forms binary, local binary, buckets binary, words array<struct<w:bigint,c:int>>"
_READY = "chunk bigint, doc_ids array<bigint>, held array<boolean>, lens array<int>, codes binary, classes binary, counts binary, owner binary"


def _forms(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Class of a word's form: its last three bytes, and whether it is longer than six."""
    lower = words.LOWER[buf].astype(np.uint64)
    key = np.zeros(len(starts), np.uint64)
    for back in (1, 2, 3):
        at = ends - back
        key = key * np.uint64(257) + np.where(at >= starts, lower[np.maximum(at, 0)], 0).astype(np.uint64) + np.uint64(1)
    return (words.mix64(key * np.uint64(2) + (ends - starts > 6).astype(np.uint64)) % np.uint64(FORMS)).astype(np.uint16)


def _chunks(chunk_bytes: int):
    """One row for each chunk of the task's (doc_id, held, text) rows; the text of a document is never split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        kept: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            ids, held, lens, hashes, forms = [], [], [], [], []
            for batch in kept:
                ids += batch[0]
                held += batch[1]
                lens.append(batch[2])
                hashes.append(batch[3])
                forms.append(batch[4])
            h, n = np.concatenate(hashes), np.concatenate(lens)
            distinct, first, codes = np.unique(h, return_index=True, return_inverse=True)
            train = np.repeat(~np.array(held, bool), n)
            c = np.bincount(codes[train], minlength=len(distinct))
            rank = np.empty(len(distinct), np.int64)  # frequent words get small codes
            order = np.argsort(-np.bincount(codes, minlength=len(distinct)), kind="stable")
            rank[order] = np.arange(len(distinct))
            table = pa.StructArray.from_arrays([pa.array(distinct[order].view(np.int64)), pa.array(c[order].astype(np.int32))], ["w", "c"])
            return pa.RecordBatch.from_arrays([
                pa.array([number], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([held], pa.list_(pa.bool_())), pa.array([n.astype(np.int32)], pa.list_(pa.int32())),
                pa.array([_pack(rank[codes].astype("<u4"))], pa.binary()), pa.array([np.concatenate(forms)[first][order].astype("<u2").tobytes()], pa.binary()),
                pa.array([c[order].astype("<i4").tobytes()], pa.binary()), pa.array([(distinct[order] % np.uint64(FREQUENT)).astype("<u2").tobytes()], pa.binary()),
                pa.ListArray.from_arrays(pa.array([0, len(distinct)], pa.int32()), table),
            ], names=["chunk", "doc_ids", "held", "lens", "codes", "forms", "local", "buckets", "words"])

        for batch in batches:
            for a, b in words.slices(batch.column(2)):
                part = batch.slice(a, b - a)
                buf, off = words.raw(part.column(2))
                h, counts = words.hashes(buf, off, lower=True)
                starts, ends, _ = words.spans(buf, off)
                form = _forms(buf, starts, ends)
                at = np.cumsum(counts)
                kept.append((part.column(0).to_pylist(), part.column(1).to_pylist(), counts + 1,
                             np.insert(h, at, np.uint64(END_HASH)), np.insert(form, at, np.uint16(FORMS))))
                size += len(buf) + 64 * (b - a)
                if size >= chunk_bytes:
                    yield flush()
                    number, kept, size = number + 1, [], 0
        if kept:
            yield flush()

    return run


def _pack(codes: np.ndarray) -> bytes:
    return len(codes).to_bytes(8, "little") + pa.compress(np.ascontiguousarray(codes).tobytes(), codec="zstd", asbytes=True)


def _unpack(packed: bytes) -> np.ndarray:
    n = int.from_bytes(packed[:8], "little")
    return np.frombuffer(pa.decompress(packed[8:], 4 * n, codec="zstd", asbytes=True), "<u4")


def _attach(left: pa.Table, right: pa.Table) -> pa.Table:
    """A chunk and its words' corpus counts: counts by code, and which words this chunk answers for.

    ``right`` has the words that other chunks hold too; of any other word the chunk has the whole count.
    """
    counts = np.frombuffer(left.column("local")[0].as_py(), "<i4").astype("<i8")
    owner = np.ones(len(counts), bool)
    mark = right.column("mark").to_numpy()
    counts[mark >> 1] = right.column("total").to_numpy()
    owner[mark >> 1] = mark & 1
    buckets = np.frombuffer(left.column("buckets")[0].as_py(), "<u2")
    forms = np.frombuffer(left.column("forms")[0].as_py(), "<u2").astype(np.int32)
    classes = np.where(forms == FORMS, END, FREQUENT + forms).astype("<i4")
    both = np.stack([classes, buckets.astype("<i4")])
    return pa.table([
        left.column("chunk"), left.column("doc_ids"), left.column("held"), left.column("lens"), left.column("codes"),
        pa.array([both.astype("<i4").tobytes()], pa.binary()), pa.array([counts.tobytes()], pa.binary()), pa.array([owner.tobytes()], pa.binary()),
    ], names=[x.split()[0] for x in _READY.split(", ")])


def _word_classes(row: dict, threshold: int) -> np.ndarray:
    """Class of each code: by hash if the word is frequent, else by form; the end token has its own."""
    form, bucket = np.frombuffer(row["classes"], "<i4").reshape(2, -1)
    counts = np.frombuffer(row["counts"], "<i8")
    return np.where((form != END) & (counts >= threshold), bucket, form)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(j)[i].as_py() for j, name in enumerate(batch.schema.names)}


def _emit(values: np.ndarray) -> pa.RecordBatch:
    """Rows (class, values) of the classes that hold something."""
    some = np.flatnonzero(values.any(axis=1))
    return pa.RecordBatch.from_arrays([pa.array(some), pa.array(list(values[some].astype(np.float64)), pa.list_(pa.float64()))], names=["class", "v"])


def _sum_by_class(df: DataFrame, width: int, size: int) -> np.ndarray:
    """Sum (class, v) rows in Spark; the driver gets one row a class."""
    total = df.groupBy("class").agg(*[F.sum(F.col("v")[i]).alias(f"v{i}") for i in range(width)]).toPandas()
    out = np.zeros((size, width))
    out[total["class"].to_numpy(np.int64)] = total.drop(columns="class").to_numpy(np.float64)
    return out


class Model:
    """Start, transition and class emission probabilities; class sums and the two corpus totals."""

    def __init__(self, tokens: int, distinct: int, threshold: int, sums: np.ndarray, states: int, seed: int):
        rng = np.random.default_rng(seed)
        self.tokens, self.distinct, self.threshold, self.sums = tokens, distinct, threshold, sums
        self.prior = (sums + 1) / (sums.sum() + len(sums))
        self.start = np.full(states, 1 / states)
        self.move = np.full((states, states), 0.05 / max(states - 1, 1)) + np.eye(states) * (0.95 - 0.05 / max(states - 1, 1))
        self.move /= self.move.sum(1, keepdims=True)
        emit = self.prior[:, None] * np.exp(0.5 * rng.standard_normal((len(sums), states)))
        self.emit = emit / emit.sum(0)

    def update(self, counts: np.ndarray) -> None:
        """Maximisation from summed expected counts: CLASSES rows of emissions, then starts, then transitions."""
        k, alpha = len(self.start), 50.0
        e = counts[:CLASSES] + alpha * self.prior[:, None]
        self.emit = e / e.sum(0)
        self.start = (counts[CLASSES] + 1) / (counts[CLASSES].sum() + k)
        move = counts[CLASSES + 1 :] + 0.1
        self.move = move / move.sum(1, keepdims=True)


def expected_counts(model: Model, classes: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Expected counts of class sequences by forward-backward: CLASSES rows of emissions, then starts, then transitions."""
    emissions, moves, first = expected(model.emit, classes, model.start, model.move, lens)
    return np.concatenate([emissions, first[None], moves])


def _round(model: Model):
    """Expected counts of a task's training documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((CLASSES + 1 + len(model.start), len(model.start)))
        for row in _rows(batches):
            lens, held = np.array(row["lens"], np.int64), np.array(row["held"], bool)
            classes = _word_classes(row, model.threshold)[_unpack(row["codes"])][np.repeat(~held, lens)]
            if len(classes):
                total += expected_counts(model, classes, lens[~held])
        yield _emit(total)

    return run


def _score(model: Model):
    """Per document: tokens, known tokens, base score and the model's score."""
    logs = np.log(model.sums + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            lens, codes = np.array(row["lens"], np.int64), _unpack(row["codes"])
            counts, cls = np.frombuffer(row["counts"], "<i8"), _word_classes(row, model.threshold)
            doc = np.repeat(np.arange(len(lens)), lens)
            log_c = np.bincount(doc, weights=np.log(counts + 1.0)[codes], minlength=len(lens))
            within = np.bincount(doc, weights=(np.log(counts + 1.0) - logs[cls])[codes], minlength=len(lens))
            ll = log_weights(model.emit, cls[codes], model.start, model.move, lens)  # natural, of the class sequence
            yield pa.RecordBatch.from_arrays([
                pa.array(row["doc_ids"], pa.int64()), pa.array(row["held"], pa.bool_()), pa.array(lens),
                pa.array(np.bincount(doc, weights=(counts > 0)[codes], minlength=len(lens)).astype(np.int64)),
                pa.array(np.full(len(lens), model.tokens, np.int64)),
                pa.array((log_c - lens * np.log(model.tokens + model.distinct + 1)) / np.log(10)), pa.array((ll + within) / np.log(10)),
            ], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def _corpus(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens and distinct words that the task's chunks answer for."""
    tokens = distinct = 0
    for row in _rows(batches):
        counts = np.frombuffer(row["counts"], "<i8")[np.frombuffer(row["owner"], bool)]
        tokens, distinct = tokens + int(counts.sum()), distinct + int((counts > 0).sum())
    yield pa.RecordBatch.from_arrays([pa.array([tokens]), pa.array([distinct])], names=["tokens", "distinct"])


def _class_sums(threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((CLASSES, 1))
        for row in _rows(batches):
            counts = np.frombuffer(row["counts"], "<i8")
            mine = np.frombuffer(row["owner"], bool) & (counts > 0)
            sums[:, 0] += np.bincount(_word_classes(row, threshold)[mine], weights=counts[mine] + 1, minlength=CLASSES)
        yield _emit(sums)

    return run


def prepare(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Chunks with corpus counts, stored in the shared folder."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), held_out.alias("held"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    chunks = materialise(rows.mapInArrow(_chunks(chunk_bytes), _CHUNK), "lm-chunks")
    each = chunks.select("chunk", F.posexplode("words").alias("code", "x")).select(
        F.col("x.w").alias("w"), "chunk", (F.shiftleft(F.col("code").cast("bigint"), 31) + F.col("x.c")).alias("own"))  # counts in a chunk stay below 2^31
    word = Window.partitionBy("w")
    mine = (F.min("chunk").over(word) == F.col("chunk")).cast("bigint")
    summed = each.select("chunk", (F.shiftright("own", 31) * 2 + mine).alias("mark"), F.sum(F.col("own") % (1 << 31)).over(word).alias("total"),
                         F.count(F.lit(1)).over(word).alias("chunks")).filter("chunks > 1").drop("chunks")
    joined = chunks.drop("words").groupBy("chunk").cogroup(summed.groupBy("chunk")).applyInArrow(_attach, _READY)
    ready = materialise(joined, "lm-ready")
    discard(chunks)
    return ready


def train(ready: DataFrame, states: int = 8, rounds: int = 2, warm_rounds: int = 6, frequent_share: float = 2e-6, seed: int = 7) -> Model:
    """Fit the model by Baum-Welch. Without training documents every state keeps the prior."""
    counts = ready.select("counts", "owner").mapInArrow(_corpus, "tokens bigint, distinct bigint").agg(F.sum("tokens"), F.sum("distinct")).first()
    tokens, distinct = int(counts[0] or 0), int(counts[1] or 0)
    threshold = max(5, int(frequent_share * tokens))
    sums = _sum_by_class(ready.select("classes", "counts", "owner").mapInArrow(_class_sums(threshold), "class bigint, v array<double>"), 1, CLASSES)[:, 0]
    model = Model(tokens, distinct, threshold, sums, states, seed)
    for _ in range(warm_rounds + rounds):
        expected = ready.select("held", "lens", "codes", "classes", "counts").mapInArrow(_round(model), "class bigint, v array<double>")
        model.update(_sum_by_class(expected, states, CLASSES + 1 + states))
    return model


def score(docs: DataFrame, held_out=None, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES, **options) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), learning from rows that are not held out.

    Null or empty text: the end token alone. Null doc_id: kept as null, never held out by the default rule.
    Repeated rows: learnt from and scored each. Empty table: no rows. Extra columns are ignored.
    """
    held_out = crc_is(id_col, 7, 2) if held_out is None else held_out
    ready = prepare(docs, held_out, id_col, text_col, chunk_bytes)
    model = train(ready, **options)
    return ready.select("doc_ids", "held", "lens", "codes", "classes", "counts").mapInArrow(
        _score(model), "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
