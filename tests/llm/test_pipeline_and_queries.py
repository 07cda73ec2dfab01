from __future__ import annotations

import re
from collections import Counter

import corpus_pipeline
import __spark_entry__ as entry
from funnelcast.llm import exact_dedup, mixing, ngram_join, queries
from .test_dedup_and_joins import bare, brute_components

SF = "/root/testdata/sf0.001"


def test_stages_follow_one_another(spark, documents):
    docs, frames = documents, []
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialise(stage(spark, docs, SF), "test-stage")
        frames.append(docs)
    good, once, near, mixed, packed = frames
    assert all(f.columns == documents.columns for f in frames[:-1])
    rows = [(r.doc_id, r.text) for r in good.collect()]
    assert 0.7 * documents.count() < len(rows) < documents.count()
    assert Counter(bare(t) for _, t in rows).keys() == Counter(bare(r.text) for r in once.collect()).keys() and once.count() == len({bare(t) for _, t in rows})
    rows = [(r.doc_id, r.text) for r in once.collect()]
    assert sorted(r.doc_id for r in near.collect()) == sorted({c for _, _, c in brute_components(rows, 80, 5)})
    copies = {r.doc_id: r.copies for r in mixing.plan(near).collect()}
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({k: v for k, v in copies.items() if v})
    assert sum(r.length for r in packed.collect()) == sum(r.doc_tokens for r in packed.filter("start = 0").collect())
    assert packed.filter("start = 0").count() == mixed.count()


def test_queries_are_registered_with_their_columns(spark):
    found = entry.queries()
    assert [n for n in range(1, 14) if not any(re.match(rf"op{n}_", q) for q in found)] == [] and "pipeline" in found
    assert set(queries.ORACLE) <= set(queries.QUERIES)
    assert found["op8_grace_exact_dedup"](spark, SF).columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


def test_operators_do_not_depend_on_partitioning(documents):
    a = exact_dedup.annotate(documents).select("doc_id", "keep_id").collect()
    b = exact_dedup.annotate(documents.repartition(7)).select("doc_id", "keep_id").collect()
    assert sorted(a) == sorted(b)
    a = ngram_join.join(documents).select("doc_id", "component_id").collect()
    b = ngram_join.join(documents.repartition(7)).select("doc_id", "component_id").collect()
    assert sorted(a) == sorted(b)
