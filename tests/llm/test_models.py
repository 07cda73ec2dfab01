from __future__ import annotations

import math
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from funnelcast.llm import hmm_lm, language, rule_classifier
from funnelcast.llm.chains import expected, log_weights, smooth
from .conftest import ODD


def test_forward_backward_against_all_paths():
    rng = np.random.default_rng(0)
    k, lens = 3, np.array([4, 0, 1, 3])
    e, start, move = rng.random((8, k)) + 0.1, rng.random(k), rng.random((k, k))
    ll, marginals, pairs, first = smooth(e, start, move, lens, True)
    at, all_pairs, all_first = 0, np.zeros((k, k)), np.zeros(k)
    for n, got in zip(lens, ll):
        total, single, pair, one = 0.0, np.zeros((n, k)), np.zeros((k, k)), np.zeros(k)
        for path in product(range(k), repeat=int(n)) if n else []:
            w = start[path[0]] * np.prod([e[at + t, s] for t, s in enumerate(path)]) * np.prod([move[a, b] for a, b in zip(path, path[1:])])
            total += w
            one[path[0]] += w
            for t, s in enumerate(path):
                single[t, s] += w
            for a, b in zip(path, path[1:]):
                pair[a, b] += w
        if n:
            assert got == pytest.approx(math.log(total), rel=1e-4)
            assert np.allclose(marginals[at : at + n], single / total, atol=1e-4)
            all_pairs += pair / total
            all_first += one / total
        at += n
    assert np.allclose(pairs, all_pairs, atol=1e-3) and np.allclose(first, all_first, atol=1e-4)


def test_sums_by_class_equal_the_marginals_of_each_token():
    rng = np.random.default_rng(8)
    table, start, move = rng.random((50, 4)) + 0.01, rng.dirichlet(np.ones(4)), rng.dirichlet(np.ones(4), 4)
    lens = np.array([7, 1, 0, 40, 7, 300])
    classes = rng.integers(0, 49, lens.sum()).astype(np.int32)
    ll, marginals, pairs, first = smooth(table[classes], start, move, lens, True)
    by_class = np.zeros((50, 4))
    np.add.at(by_class, classes, marginals)
    sums, moves, starts = expected(table, classes, start, move, lens)
    assert np.allclose(sums, by_class) and sums.sum() == pytest.approx(lens.sum(), rel=1e-5) and not sums[49].any()
    assert np.array_equal(moves, pairs) and np.array_equal(starts, first)
    assert np.array_equal(log_weights(table, classes, start, move, lens), ll)
    none = np.empty(0, np.int64)
    assert not any(x.any() for x in expected(table, none, start, move, none)) and log_weights(table, none, start, move, np.zeros(2, np.int64)).tolist() == [0, 0]


def held(i, mod, r):
    return i is not None and zlib.crc32(str(i).encode()) % mod == r


def test_language_model_counts_and_gain(documents, odd, none):
    rows = documents.select("doc_id", "text").collect()
    got = {r.doc_id: r for r in hmm_lm.score(documents, chunk_bytes=20_000, warm_rounds=3).collect()}
    tokens = {r.doc_id: [*(r.text or "").encode().lower().split(), None] for r in rows}
    count = Counter(w for i, t in tokens.items() if not held(i, 7, 2) for w in t)
    n, v = sum(count.values()), len(count)
    for i, t in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i, 7, 2), len(t), sum(w in count for w in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in t), rel=1e-9)
    out = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
    again = {r.doc_id: r.score for r in hmm_lm.score(documents, chunk_bytes=20_000, warm_rounds=3).collect()}
    assert all(again[i] == pytest.approx(r.score, rel=1e-5) for i, r in got.items())
    assert hmm_lm.score(odd).count() == len(ODD) and hmm_lm.score(none).count() == 0


def test_every_round_learns_from_every_chunk(documents):
    ready = hmm_lm.prepare(documents.repartition(10, "doc_id"), F.lit(False))
    assert ready.count() > 8
    first, last = hmm_lm.train(ready, warm_rounds=1, rounds=0), hmm_lm.train(ready, warm_rounds=0, rounds=1)
    assert np.allclose(first.emit, last.emit, rtol=1e-5) and np.allclose(first.move, last.move, rtol=1e-5)


def test_hmm_is_a_distribution_over_known_and_unknown_words():
    sums = np.zeros(hmm_lm.CLASSES)
    sums[[3, 5, hmm_lm.END]] = [9.0, 4.0, 3.0]
    model = hmm_lm.Model(13, 3, 5, sums, 4, 1)
    assert np.allclose(model.emit.sum(0), 1) and np.allclose(model.move.sum(1), 1)
    model.update(np.random.default_rng(2).random((hmm_lm.CLASSES + 5, 4)))
    assert np.allclose(model.emit.sum(0), 1) and np.allclose(model.move.sum(1), 1) and model.start.sum() == pytest.approx(1)


def test_languages_held_out_and_code_switched(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    right = [r.lang_pred == r.lang for r in got]
    assert len(right) > 150 and np.mean(right) > 0.95 and all(0 <= r.score <= 1 for r in got)
    model = language.train(docs, F.lit(True))
    parts = {r.lang: r.text.split()[:40] for r in docs.filter("length(text) > 800").dropDuplicates(["lang"]).collect()}
    mixed = [w for lang in sorted(parts) for w in parts[lang]]
    import pyarrow as pa

    from funnelcast.llm import words
    buf, off = words.raw(pa.array([" ".join(mixed)]))
    types, counts, hashes, features = language.word_types(buf, off)
    prob = language.marginals(model, types, language.emissions(model, hashes, features), counts)
    tags = [model.langs[j] for j in prob.argmax(1)]
    assert np.mean([a == b for a, b in zip(tags, [lang for lang in sorted(parts) for _ in parts[lang]])]) > 0.85
    few = {(r.doc_id, r.lang_pred) for r in language.identify(odd).collect()}
    assert len(few) >= 7 and (2, "und") in few and (3, "und") in few
    assert language.identify(none).count() == 0
    assert {r.lang_pred for r in language.identify(odd, F.lit(True)).collect()} == {"und"}


def test_code_switched_text_keeps_its_spans(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    parts = {r.lang: " ".join(r.text.split()[:40]) for r in docs.filter("length(text) > 800").dropDuplicates(["lang"]).collect()}
    a, b = sorted(parts)[:2]
    text = f"  {parts[a]}\u2003é \n{parts[b]} "
    mixed = spark.createDataFrame([(-5, text, None)], docs.schema)
    row = language.label_words(docs.union(mixed)).filter("doc_id = -5").first()
    assert row.n_words == len([w for w in text.translate({0x2003: "x"}).split()])
    assert sum(r.n_words for r in row.runs) == row.n_words and {r.lang for r in row.runs} >= {a, b}
    assert all(x.end < y.start and x.lang != y.lang for x, y in zip(row.runs, row.runs[1:]))
    assert all(text[r.start : r.end] == text[r.start : r.end].strip(" \n") and 0 < r.probability <= 1 for r in row.runs)
    middle, right = text.index("\n"), {a: 0, b: 0}
    for r in row.runs:
        for lang, lo, hi in ((a, 0, middle), (b, middle, len(text))):
            right[lang] += (r.lang == lang) * max(0, min(r.end, hi) - max(r.start, lo))
    assert right[a] > 0.8 * len(parts[a]) and right[b] > 0.8 * len(parts[b])
    few = language.label_words(odd, F.lit(True)).collect()
    assert len(few) == len(ODD) and all([r.lang for r in x.runs] == ["und"] * bool(x.n_words) and not x.means for x in few)


def test_rules_compile_and_classify(spark, frame, odd, none):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = rule_classifier.classify(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert len(got) > 90 and np.mean([r.predicted == r.quality for r in got]) > 0.95
    model = rule_classifier.train(docs, labels, F.lit(True))
    assert 0 < len(model.rules) < 120
    stats = rule_classifier.with_stats(docs, ["doc_id"]).withColumn("score", model.score()).limit(40).collect()
    for r in stats:
        x = [r[c] for c in rule_classifier.STAT_COLUMNS]
        z = model.intercept + sum(w for rule, w in zip(model.rules, model.weights) if all(x[i] <= c if low else x[i] > c for i, low, c in rule))
        assert r.score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9)
    kept = rule_classifier.accept(docs, labels)
    assert kept.columns == docs.columns and 0.7 * docs.count() < kept.count() < docs.count()
    empty = labels.limit(0)
    assert {r.predicted for r in rule_classifier.classify(odd, empty).collect()} == {1}
    assert rule_classifier.classify(odd, labels).count() == len(ODD) and rule_classifier.classify(none, labels).count() == 0
    assert rule_classifier.accept(odd, empty).columns == odd.columns
