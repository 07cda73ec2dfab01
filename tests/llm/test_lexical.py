"""Norm-bucket search against scoring every pair."""

from __future__ import annotations

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from funnelcast.llm import lexical, queries
from .conftest import DOCS, LONG, ODD

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    lists = [(i, terms(t)) for i, t in docs]
    n_docs, total = sum(1 for _, t in lists if t), sum(len(t) for _, t in lists)
    df = {}
    for _, t in lists:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    out = []
    for item, text in items:
        found = []
        for i, t in lists:
            score = 0
            for x in terms(text):
                if x in t:
                    tf, m = t.count(x), 100 - 75 + (75 * len(t) * n_docs) // total
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * ((1000000000 * tf) // (1000 * tf + 8 * m))
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(found, key=lambda f: f[:3])[:k], 1)]
    return out


def ranked(spark, docs, items, **options):
    d = spark.createDataFrame([(i, t, "en", "s", 0, "a", "b", "c", "d") for i, t in docs], DOCS).repartition(3)
    q = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id bigint, text string, rank string")
    return [tuple(r) for r in lexical.search(d, q, **options).collect()]


def same(got, want):
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)


@pytest.mark.parametrize("options", [{}, {"head": 1, "block_chars": 60, "k": 3}])
def test_equals_brute_force(spark, options):
    rng = random.Random(3)
    vocabulary = ["w%d" % int(rng.paretovariate(0.6)) for _ in range(300)] + ["Été", "中文", "x9Y"]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 5, 40, 300])))) for i in range(400)]
    items = [(j, ", ".join(rng.choices(vocabulary, k=rng.randint(1, 30)))) for j in range(15)]
    docs += [(1000 + j, "before " + t + " after") for j, (_, t) in enumerate(items)]
    want = brute(docs, items, options.get("k", 10))
    assert len(want) > 30
    same(ranked(spark, docs, items, **options), want)


def test_odd_rows(spark):
    docs = [(i, t) for i, t, _, _ in ODD if t != LONG] + [(5, "long text of many words " * 300), (None, "A-B c"), (9, "...")] + [(20 + i, "copy of A text") for i in range(30)]
    items = [(1, "A b; C"), (1, "A b; C"), (None, "copy text"), (2, None), (3, ""), (4, "!!"), (5, "missing"), (6, "ß é \xa0ß"), (7, "words " * 50)]
    same(ranked(spark, docs, items), brute(docs, items))


def test_long_text(spark):
    docs = [(1, LONG), (2, "many words here"), (3, None)]
    same(ranked(spark, docs, [(1, "many LONG here")]), brute(docs, [(1, "many LONG here")]))


def test_empty_tables(spark):
    assert ranked(spark, [], [(1, "a")]) == [] and ranked(spark, [(1, "a")], []) == [] and ranked(spark, [(1, None)], [(1, "a")]) == []


def test_terms_are_those_of_the_pattern():
    texts = ["", "aZ09_x~é\x7f中", "\x00a\x2f\x3ab\x40c\x5bd\x60e\x7bf", "A" * 100]
    h, n = lexical.term_hashes(pa.array(texts + [None]))
    assert n.tolist() == [*(len(terms(t)) for t in texts), 0]
    assert len(set(h.tolist())) == len({x for t in texts for x in terms(t)})


def test_bounds_never_drop_a_row_and_drop_most():
    rng = np.random.default_rng(2)
    rows = [np.unique(rng.zipf(1.3, 40) % 500) for _ in range(2000)]
    flat, sizes = np.concatenate(rows), np.array([len(r) for r in rows])
    impacts = rng.integers(1, 10**6, len(flat)) * (1 + flat % 50)
    norms = np.sqrt(np.add.reduceat(impacts.astype(float) ** 2, np.cumsum(sizes) - sizes))
    bucket = lexical.Bucket(np.arange(2000), flat, impacts, sizes, norms)
    weights = 1 + np.arange(500) % 50
    query = lexical.Query(1, np.arange(3, 500, 13), np.full(39, 2), weights)
    scores = np.zeros(2000, np.int64)
    chosen = np.isin(flat, np.arange(3, 500, 13))
    np.add.at(scores, np.repeat(np.arange(2000), sizes)[chosen], 2 * impacts[chosen])
    for least in (1, int(np.sort(scores)[-10]), int(scores.max()), int(scores.max()) + 1):
        ids, found = bucket.survivors(query, least)
        assert dict(zip(ids.tolist(), found.tolist())) == {i: int(s) for i, s in enumerate(scores) if s >= least}
        assert query.norm * bucket.longest >= scores.max()


def test_query_matches_its_sql(spark, duck):
    got = queries.QUERIES["op11_norm_bucket_search"](spark, "/root/testdata/sf0.001").select("item_id", "rank", "doc_id", "score").collect()
    want = duck.execute(queries.ORACLE["op11_norm_bucket_search"]).df()[["item_id", "rank", "doc_id", "score"]]
    assert got and sorted(tuple(r) for r in got) == sorted(tuple(int(x) for x in r) for r in want.itertuples(index=False))
