"""N-gram Jaccard join by token-combination prefixes.

A document's tokens are the 64-bit hashes of its distinct word n-grams; two documents link when
``100 * intersection >= percent * union``. Linked sets lack at most ``tau = n - ceil(percent/100 * n)``
of each other's tokens, so under any global token order their prefixes share a signature if the prefix
of each holds ``tau + 1`` units of coverage, where

* a rare token covers one unit and is a signature by itself,
* c prefix tokens in one cell of frequent tokens cover c - 1 units, and every pair of them is a
  signature: prefixes are extended until their coverage suffices.

The order: *known* tokens first (seen in one set; rare; frequent, cell by cell), then the others by
hash. Known are the tokens in the lower KNOWN of the hash space, whose document frequencies are counted
over all sets; for sets of less than ``small()`` tokens, all. A token of one set only makes no signature, so a
document with more than tau of them is done. Signatures carry a step of the set size: linked sets lie in
equal or adjacent steps.

Sets that share a signature form a group; a group's texts meet in one task, where links are found by
probing: one set against the whole group at a time, until all sets not yet probed belong to one linked
component. No pair rows are made and no link is lost. A group of more than TILE_TOKENS tokens is cut into
tiles, and each two tiles are a task. Equal sets are one set throughout.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .common import discard, materialise
from .components import connected

NGRAM = 4
PERCENT = 85
KNOWN = 0.3
LARGE, SMALL = 100, 128  # sets of LARGE tokens or more are joined by known tokens, sets below small() (SMALL at least) by all
RARE = 16
CELL = 3.0
TILE_TOKENS = 2_000_000
SIEVE = 1 << 20
_U64 = (1 << 64) - 1


def shingle_sets(text: pa.Array, n: int = NGRAM) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct n-gram hashes) of each text; fewer than n words: the whole sequence as one."""
    for a, b in words.slices(text):
        buf, off = words.raw(text.slice(a, b - a))
        h, counts = words.hashes(buf, off, lower=True)
        win, per = words.windows(h, counts, n)
        ends, wends = np.cumsum(counts), np.cumsum(per)
        for i in range(b - a):
            c = int(counts[i])
            if c >= n:
                yield a + i, np.unique(win[wends[i] - per[i] : wends[i]])
            else:
                own = h[ends[i] - c : ends[i]]
                yield a + i, words.mix64(words.windows(own, np.array([c]), c)[0] + np.uint64(c)) if c else own


def tau(n: int, percent: int = PERCENT) -> int:
    """Tokens that a set of n may lack in a partner."""
    return n - (percent * n + 99) // 100


def small(percent: int) -> int:
    """Sets below this are joined by all tokens: more than any partner of a set below LARGE has."""
    return max(SMALL, 100 * (LARGE - 1) // percent + 1)


def size_step(n: int, percent: int) -> int:
    return int(math.log(n) / -math.log(percent / 100) + 1e-9)


def n_cells(step: int, scheme: int, percent: int) -> int:
    return max(1, int((KNOWN if scheme else 1.0) * (100 / percent) ** step / CELL))


_SETS = "doc_id bigint, row_hash bigint, n bigint, doc bigint, views array<struct<scheme:int,known:array<bigint>,extra:array<bigint>>>"
_VIEW = pa.struct([("scheme", pa.int32()), ("known", pa.list_(pa.int64())), ("extra", pa.list_(pa.int64()))])


def _views(s: np.ndarray, percent: int) -> list[dict]:
    """The schemes a set takes part in, with its known tokens and, where they might not suffice, more."""
    n = len(s)
    if n * 100 // percent == n:  # so small that only equal sets link
        return []
    out = []
    if n < small(percent):
        out.append({"scheme": 0, "known": words.mix64(s).view(np.int64), "extra": s[:0].view(np.int64)})
    if n >= LARGE:
        k = int(np.searchsorted(s, np.uint64(int(KNOWN * 2**64))))
        short = tau(n, percent) + 1 - (k - n_cells(size_step(n, percent) + 1, 1, percent))
        out.append({"scheme": 1, "known": s[:k].view(np.int64), "extra": s[k : k + max(0, short)].view(np.int64)})
    return out


def _sets(percent: int, ngram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 4 + [pa.list_(_VIEW)]
        names = ["doc_id", "row_hash", "n", "doc", "views"]
        for batch in batches:
            rows, held = [], 0
            ids, hashes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, s in shingle_sets(batch.column(2), ngram):
                n = len(s)
                print_ = (int(words.mix64(s).sum(dtype=np.uint64)) * 3 + n * 0x9E3779B97F4A7C15 + int(np.bitwise_xor.reduce(words.mix64(s ^ np.uint64(0xA5A5A5A5))))) & _U64 if n else None
                rows.append((ids[i], hashes[i], n, None if print_ is None else print_ - (1 << 63), _views(s, percent)))
                held += n
                if held > 1 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return run


def _hashed(x: np.ndarray, salt: int) -> list[int]:
    return words.mix64(x + np.uint64(salt)).view(np.int64).tolist()


def prefix_signatures(n: int, scheme: int, n_known: int, df: np.ndarray, tokens: np.ndarray, extra: np.ndarray, percent: int) -> list[int]:
    """Signatures of a set. ``tokens`` are its known tokens seen in several sets and ``df`` their frequencies."""
    out: list[int] = []
    order = np.lexsort((tokens, df > RARE))
    n_rare = int((df <= RARE).sum())
    rare, frequent = tokens[order[:n_rare]], tokens[order[n_rare:]]
    step = size_step(n, percent)
    for s in (step, step + 1):
        need = tau(n, percent) + 1 - (n_known - len(tokens))
        if need <= 0:
            break
        salt = ((2 * s + scheme + 1) * 0x9E3779B97F4A7C15) & _U64
        out += _hashed(rare[:need], salt)
        need -= min(need, n_rare)
        if need <= 0:
            continue
        cell = words.mix64(frequent) % np.uint64(n_cells(s, scheme, percent))
        order = np.lexsort((frequent, cell))
        ordered, cell = frequent[order], cell[order]
        begin = 0
        while begin < len(ordered) and need > 0:
            end = int(np.searchsorted(cell, cell[begin], side="right"))
            group = ordered[begin : min(end, begin + need + 1)]
            i, j = np.triu_indices(len(group), 1)
            out += _hashed(words.mix64(group[i] + np.uint64(1)) + group[j], salt)
            need -= len(group) - 1
            begin = end
        if need > 0:
            out += _hashed(extra[:need], salt ^ 0x5555)
    return out


def _signatures(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, sigs = [], []
            for doc, n, scheme, n_known, counted, extra in zip(*(c.to_pylist() for c in batch.columns)):
                tokens = np.array([c["token"] for c in counted or []], np.int64).view(np.uint64)
                df = np.array([c["df"] for c in counted or []], np.int64)
                found = prefix_signatures(n, scheme, n_known, df, tokens, np.array(extra or [], np.int64).view(np.uint64), percent)
                docs.extend([doc] * len(found))
                sigs.extend(found)
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(sigs, pa.int64())], names=["doc", "signature"])

    return run


def probe_links(sets: list[np.ndarray], percent: int = PERCENT) -> np.ndarray:
    """Label of each set; linked sets, and sets joined by links, share one. Exact: each unprobed pair is in one component."""
    m = len(sets)
    sizes = np.fromiter(map(len, sets), np.int64, m)
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    label = np.arange(m)
    open_ = np.ones(m, bool)
    mark = np.zeros(int(ids.max()) + 1, bool)
    while True:
        rest = np.flatnonzero(open_)
        if not len(rest):
            return label
        values, counts = np.unique(label[rest], return_counts=True)
        if len(values) == 1:
            return label
        largest = values[np.argmax(counts)]
        outside = rest[label[rest] != largest] if counts.max() > 1 else rest
        p = int(outside[0])
        mine = ids[begins[p] : ends[p]]
        mark[mine] = True
        common = np.add.reduceat(mark[ids], begins)
        mark[mine] = False
        linked = 100 * common >= percent * (sizes + sizes[p] - common)
        joined = np.unique(label[linked])
        if len(joined) > 1:
            label[np.isin(label, joined)] = joined[0]
        open_[p] = False


def _link_groups(percent: int, ngram: int):
    """Rows (task, doc, text) sorted by task: (doc, head) for each doc that a link joins to another of its task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, docs, sets = None, [], []

        def done() -> Iterator[pa.RecordBatch]:
            if len(docs) > 1:
                label = probe_links(sets, percent)
                moved = np.flatnonzero(label != np.arange(len(docs)))
                if len(moved):
                    ids = np.array(docs, np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[label[moved]])], names=["a", "b"])

        for batch in batches:
            tasks, keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, s in shingle_sets(batch.column(2), ngram):
                if tasks[i] != task:
                    yield from done()
                    task, docs, sets = tasks[i], [], []
                docs.append(keys[i])
                sets.append(s)
        yield from done()

    return run


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, ngram: int = NGRAM,
         tile_tokens: int = TILE_TOKENS) -> DataFrame:
    """(doc_id, row_hash, n_shingles, doc, root, component_id) for every row of ``docs``.

    ``doc`` identifies the row's set (null: no words), ``root`` the linked component of sets, and
    ``component_id`` is the smallest doc_id of that component. Null or empty text: no set, linked with
    nothing, its own component. Null doc_id: takes part; it never is a component_id unless all of its
    component's ids are null. Repeated rows and equal sets link. Empty table: no rows. Extra columns are ignored.
    ``percent`` must be 60 to 99.
    """
    if not 60 <= percent <= 99:
        raise ValueError(f"percent must be 60 to 99, not {percent}")
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("row_hash"), text.alias("text"))
    both = materialise(rows.mapInArrow(_sets(percent, ngram), _SETS), "join-both")
    sets = materialise(both.drop("views"), "join-sets")

    # one row for each distinct set
    first = sets.filter("n > 0").groupBy("doc").agg(F.min(F.struct("row_hash", "doc_id")).alias("r"), F.min("doc_id").alias("min_id"))
    classes = materialise(first.select("doc", F.col("r.row_hash").alias("row_hash"), F.col("r.doc_id").alias("rep_id"), "min_id"), "join-classes")
    reps = classes.select("doc", "row_hash", F.col("rep_id").alias("doc_id"))
    same = [both["doc"] == reps["doc"], both["row_hash"] == reps["row_hash"], both["doc_id"].eqNullSafe(reps["doc_id"])]
    views = materialise(
        both.filter(F.size("views") > 0).join(reps, same[0] & same[1] & same[2], "left_semi").dropDuplicates(["doc"])
        .select("doc", "n", F.explode("views").alias("v")).select("doc", "n", "v.*"), "join-views")
    discard(both)

    # document frequencies of known tokens; only tokens of several sets come back to their sets
    tokens = views.select("doc", "scheme", F.explode("known").alias("token"))
    several = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    counted = tokens.join(several, "token").groupBy("doc", "scheme").agg(F.collect_list(F.struct("token", "df")).alias("counted"))
    sized = views.select("doc", "n", "scheme", F.size("known").cast("bigint").alias("n_known"), "extra")
    allowed = F.col("n") - F.floor((percent * F.col("n") + 99) / 100)
    suspects = sized.join(counted, ["doc", "scheme"], "left").filter(
        F.col("n_known") - F.coalesce(F.size("counted"), F.lit(0)) <= allowed)
    signed = materialise(suspects.select("doc", "n", "scheme", "n_known", "counted", "extra").mapInArrow(_signatures(percent), "doc bigint, signature bigint"), "join-signatures")

    heads = signed.groupBy("signature").agg(F.min("doc").alias("head"), F.count(F.lit(1)).alias("c")).filter("c > 1")
    stars = signed.join(heads, "signature").select(F.col("doc").alias("a"), F.col("head").alias("b"))
    groups = connected(stars).withColumnsRenamed({"node": "doc", "root": "group"})

    # the texts of groups, cut into tiles where a group is large
    members = groups.join(classes.select("doc", "row_hash"), "doc").join(views.groupBy("doc").agg(F.first("n").alias("n")), "doc")
    weight = members.groupBy("group").agg(F.ceil(F.sum("n") / tile_tokens).cast("int").alias("tiles"))
    tile = F.pmod(F.xxhash64("doc"), F.col("tiles")).cast("int")
    tasks = members.join(weight, "group").withColumn("tile", tile).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    task = F.struct("group", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"))
    tasks = materialise(tasks.select("row_hash", "doc", F.xxhash64(task).alias("task")).distinct(), "join-tasks")
    sieve = F.broadcast(tasks.select(F.pmod("row_hash", F.lit(SIEVE)).alias("sieve")).distinct())  # at most SIEVE numbers
    wanted = rows.withColumn("sieve", F.pmod("row_hash", F.lit(SIEVE))).join(sieve, "sieve", "left_semi").select("row_hash", "text")
    met = tasks.join(wanted, "row_hash").dropDuplicates(["task", "doc"]).select("task", "doc", "text")
    links = met.repartition("task").sortWithinPartitions("task", "doc").mapInArrow(_link_groups(percent, ngram), "a bigint, b bigint")
    roots = connected(links).withColumnsRenamed({"node": "doc"})

    known = classes.join(roots, "doc", "left").withColumn("root", F.coalesce("root", "doc"))
    lowest = known.groupBy("root").agg(F.min("min_id").alias("component_id"))
    full = known.join(lowest, "root").select("doc", "root", "component_id")
    return sets.select("doc_id", "row_hash", F.col("n").alias("n_shingles"), "doc").join(full, "doc", "left").select(
        "doc_id", "row_hash", "n_shingles", "doc", "root", F.when(F.col("doc").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without near copies: of each component the row with the smallest doc_id (null last) stays, all columns as they were.

    Rows without words stay as they are.
    """
    text = F.col(text_col).cast("string")
    found = join(docs, id_col, text_col, **options)
    best = found.filter("root is not null").groupBy("root").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "row_hash")).alias("b"))
    stay = best.select(F.col("b.doc_id").alias("__j_id"), F.col("b.row_hash").alias("__j_hash"))
    rows = docs.withColumn("__j_hash", F.xxhash64(text)).withColumn("__j_words", F.coalesce(F.regexp_like(text, F.lit("[^\\x20\\x09-\\x0D]")), F.lit(False)))
    with_words = rows.filter("__j_words").join(stay, (rows["__j_hash"] == stay["__j_hash"]) & rows[id_col].cast("bigint").eqNullSafe(stay["__j_id"]), "left_semi")
    one = with_words.dropDuplicates([id_col, "__j_hash"])
    return one.unionByName(rows.filter("NOT __j_words")).drop("__j_hash", "__j_words")
