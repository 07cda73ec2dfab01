from __future__ import annotations

import hashlib
import random
import re
from itertools import combinations

import numpy as np
import pytest

from funnelcast.llm import exact_dedup, ngram_join
from funnelcast.llm.components import connected
from .conftest import ODD


def bare(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def brute_groups(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(bare(t), []).append((-len(t or ""), i is None, i or 0))
    return {k: (None if min(v)[1] else min(v)[2], -min(v)[0], len(v)) for k, v in groups.items()}


@pytest.mark.parametrize("options", [{}, {"table_bytes": 3000, "buckets": 2}])
def test_exact_dedup_against_grouping(frame, odd, none, options):
    random.seed(2)
    many = [(100 + i, random.choice(["x y", "xy ", "long " * 40 + str(i % 37), "q" * (i % 90)]), "en", "s") for i in range(400)]
    docs = odd.unionByName(frame(many))
    rows = [(r[0], r[1]) for r in ODD + many]
    expected = brute_groups(rows)
    got = exact_dedup.annotate(docs, **options).collect()
    assert len(got) == len(rows)
    for r in got:
        keep, points, n = expected[bare(r.text)]
        assert (r.keep_id, r.group_size) == (keep, n) and r.text_sha256 == hashlib.sha256(bare(r.text).encode()).hexdigest()
        assert r.kept == (r.doc_id == keep and len(r.text or "") == points)
    once = exact_dedup.dedup(docs, **options)
    assert once.columns == docs.columns and once.count() == len(expected)
    assert exact_dedup.annotate(none, **options).count() == 0 and exact_dedup.dedup(none).count() == 0


def test_connected_components_on_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = {r.node: r.root for r in connected(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}}


def sets_of(text, n):
    w = [x.lower() for x in (text or "").encode().split()]
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute_components(rows, percent, n):
    sets = [sets_of(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            root[find(i)] = find(j)
    low = {}
    for i, (doc, _) in enumerate(rows):
        low.setdefault(find(i), []).append(doc)
    return [(doc, len(sets[i]), min((x for x in low[find(i)] if x is not None), default=None)) for i, (doc, _) in enumerate(rows)]


def near_corpus(seed, families=14, noise=30):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(900)]
    passage = [rng.choice(vocab) for _ in range(80)]
    rows, doc = [], 0
    for f in range(families):
        base = [rng.choice(vocab) for _ in range(rng.choice([1, 3, 5, 7, 12, 40, 110, 135, 400]))] + (passage if f % 2 else [])
        for _ in range(rng.choice([2, 5, 25])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4, 8])):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append((doc, " ".join(w)))
            doc += 1
    for _ in range(noise):
        rows.append((doc, " ".join(passage + [rng.choice(vocab) for _ in range(rng.choice([5, 60]))])))
        doc += 1
    return rows


@pytest.mark.parametrize("seed,percent,n,tile", [(1, 85, 4, 2_000_000), (2, 80, 5, 2_000_000), (3, 85, 4, 900)])
def test_join_finds_every_link(frame, seed, percent, n, tile):
    rows = near_corpus(seed) + [(None, "a b c d"), (5000, None), (5001, ""), (5002, "A b  c D"), (5002, "a b c d"), (5003, " \n")]
    docs = frame([(i, t, "en", "s") for i, t in rows]).repartition(4)
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.join(docs, percent=percent, ngram=n, tile_tokens=tile).collect()]
    key = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted(got, key=key) == sorted(brute_components(rows, percent, n), key=key)


def test_prefix_signatures_meet_for_all_linked_pairs():
    rng = np.random.default_rng(5)
    percent = 85
    for n in [6, 7, 20, 90, 101, 127, 128, 300, 1500]:
        for _ in range(20):
            common = rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
            miss = int(rng.integers(0, ngram_join.tau(n, percent) + 1))
            a, b = np.unique(common), np.unique(common[miss:])
            if len(b) * 100 < percent * len(a):
                continue
            marks = []
            for s in (a, b):
                found = set()
                for v in ngram_join._views(s, percent):
                    known = v["known"].view(np.uint64)
                    several = known[rng.random(len(known)) < 2]  # every token frequent: the hardest order
                    found |= set(ngram_join.prefix_signatures(len(s), v["scheme"], len(known), np.full(len(several), 99), several, v["extra"].view(np.uint64), percent))
                marks.append(found)
            assert not marks[0] or marks[0] & marks[1], (n, miss)


def test_linked_sets_of_any_size_share_a_scheme(frame):
    tokens = np.sort(np.random.default_rng(6).integers(0, 2**63, 400, dtype=np.uint64) * np.uint64(2))
    for percent in range(60, 100):
        schemes = [{v["scheme"] for v in ngram_join._views(tokens[:n], percent)} for n in range(1, 401)]
        for n in range(1, 200):
            for m in range(n + 1, 100 * n // percent + 1):
                assert schemes[n - 1] & schemes[m - 1], (percent, n, m)
    w = [f"w{i}" for i in range(133)]
    docs = frame([(1, " ".join(w[:102]), "en", "s"), (2, " ".join(w), "en", "s")])  # 99 and 130 shingles
    assert {(r.n_shingles, r.component_id) for r in ngram_join.join(docs, percent=75).collect()} == {(99, 1), (130, 1)}
    with pytest.raises(ValueError):
        ngram_join.join(docs, percent=59)


def test_near_dedup_keeps_one_of_each_component(frame, odd, none):
    rows = near_corpus(4, families=6, noise=5)
    docs = frame([(i, t, "en", "s") for i, t in rows])
    left = ngram_join.dedup(docs, percent=80, ngram=5)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted({c for _, _, c in brute_components(rows, 80, 5)})
    assert ngram_join.dedup(none).count() == 0
    texts = sorted((r.text or "") for r in ngram_join.dedup(odd).collect())
    assert sum(not t.strip(" \t\n") for t in texts) == 3 and texts.count("a b c d e") == 1
