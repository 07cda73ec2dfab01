"""Threshold algorithm against scoring every row."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from funnelcast.llm import negatives, queries
from funnelcast.llm.toplist import NOTHING

SCHEMA = "vec_id bigint, embedding array<float>, label int, id string, v string, score string, rank string"


def brute(rows, is_anchor=lambda i: i % 100 == 0, k=5, n=10, low=30, high=90):
    items = {}
    for i, x, label in rows:
        if i is None or x is None or label is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        own = (label, [math.floor(256 * float(c)) for c in x])
        items[i] = min(items.get(i, own), own)
    out = []
    for a, (label, v) in items.items():
        if not is_anchor(a):
            continue
        scores = sorted((-sum(p * q for p, q in zip(v, w)), i, other) for i, (other, w) in items.items() if i != a)
        for s, p, _ in [r for r in scores if r[2] == label][:k]:
            inside = [r for r in scores if r[2] != label and low * -s <= 100 * -r[0] <= high * -s][:n]
            out += [(a, p, rank, i, -s, -t) for rank, (t, i, _) in enumerate(inside, 1)]
    return sorted(out)


def mined(spark, rows, **options):
    df = spark.createDataFrame([(i, x, label, "a", "b", "c", "d") for i, x, label in rows], SCHEMA).repartition(4)
    found = negatives.mine(negatives.vectors(df), F.col("id") % 100 == 0, **options)
    return sorted(tuple(r) for r in found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def floats(rng, n, dims=8):
    return [np.float32(x).item() for x in rng.normal(0, 0.4, dims)]


@pytest.mark.parametrize("options", [{}, {"rows_per_block": 17, "anchors_per_round": 3}])
def test_equals_brute_force(spark, options):
    rng = np.random.default_rng(5)
    rows = [(i, floats(rng, i), int(rng.integers(3))) for i in range(900)]
    want = brute(rows)
    assert len(want) > 100 and mined(spark, rows, **options) == want


def test_odd_rows(spark):
    rng = np.random.default_rng(6)
    rows = [(i, floats(rng, i, 3), 1 if i % 3 else 0) for i in range(-100, 240)]
    rows += [(None, [1.0, 1.0], 0), (500, None, 0), (501, [1.0, None, 1.0], 0), (502, [float("nan")], 0), (503, [float("inf")], 0), (504, [1.0], None)]
    rows += [(600, [0.0, 0.0, 0.0], 0), (700, [], 0), (701, [], 1), (800, [1.0, 2.0], 9), (900, [1.0], 0), (901, [1.0, 0.5, 0.5, 3.0], 0)]
    rows += rows[:50] + [(7, [9.0, 9.0, 9.0], 5)] + [(i, [0.5, 0.5, 0.5], i % 2) for i in range(1000, 1100)]
    random.Random(1).shuffle(rows)
    want = brute(rows)
    assert len(want) > 50 and mined(spark, rows, rows_per_block=50, anchors_per_round=2) == want


def test_large_components_stay_exact(spark):
    rng = np.random.default_rng(7)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 3e4, 4)], i % 2) for i in range(300)]
    assert mined(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert mined(spark, []) == [] and mined(spark, [(1, [1.0], 0), (2, [1.0], 1)]) == []


def test_stops_before_the_end_of_the_lists():
    rng = np.random.default_rng(8)
    v = rng.integers(-100, 100, (5000, 3))
    block = negatives.Block(np.arange(5000), np.zeros(5000, np.int64), v, np.float64)
    a, met = np.array([50, -60, 70]), 0
    for new, _, threshold in block.rounds(a):
        met += len(new)
        if threshold is not None and threshold < np.sort(v @ a)[-5]:
            break
    assert met < 2500
    scores, ids = negatives.positives_of(block, -1, 0, a, NOTHING, 5)
    assert scores.tolist() == sorted((v @ a).tolist(), reverse=True)[:5] and (v[ids] @ a == scores).all()


def test_threshold_bounds_every_row_not_met():
    rng = np.random.default_rng(9)
    v = rng.integers(-100, 100, (2000, 5))
    block = negatives.Block(np.arange(2000), np.zeros(2000, np.int64), v, np.float32)
    a, unseen = np.array([50, -60, 0, 7, -1]), np.ones(2000, bool)
    for new, scores, threshold in block.rounds(a):
        assert unseen[new].all() and (scores == v[new] @ a).all()
        unseen[new] = False
        assert threshold is None or (v[unseen] @ a).max() <= threshold
    assert not unseen.any()


def test_query_matches_its_sql(spark, duck):
    columns = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    got = queries.QUERIES["op12_threshold_hard_negatives"](spark, "/root/testdata/sf0.001").select(*columns).collect()
    want = duck.execute(queries.ORACLE["op12_threshold_hard_negatives"]).df()[columns]
    assert sorted(tuple(r) for r in got) == sorted(tuple(int(x) for x in r) for r in want.itertuples(index=False))
