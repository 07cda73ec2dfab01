"""Payload parsing (P1-P17): hand-built flat and nested payloads, windows, redaction, envelope IO."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from funnelcast.operators import parsing as PA

PROGS = [(7, "GV"), (8, "GTa"), (9, "GTe"), (12, "XX")]


def _pages(spark, payloads, month="2024-03", product=None):
    rows = [(month, product, json.dumps(p)) for p in payloads]
    return spark.createDataFrame(rows, "month string, record_product string, page string")


def _progs(spark):
    return spark.createDataFrame(PROGS, "programme_id int, product string")


def _cells(df):
    return sorted((r["entity"], r["product"], r["direction"], r["column"], r["n"]) for r in df.collect())


def _node(**cells):
    node = {"applied_total": {"doc_count": sum(v for v in cells.values() if isinstance(v, int))}}
    for k, v in cells.items():
        node[k] = {"doc_count": v, "applicants": {"value": 1}} if isinstance(v, int) else v
    return node


def test_flat_children_only_and_parent_repeats_ignored(spark):
    payload = {"response": {
        "101": _node(i_applied_7=5, o_applied_7=3, i_realized_7=2),
        "102": _node(o_applied_8=4),
        "applied_total": {"doc_count": 12},          # parent repeats must be ignored
        "i_applied_7": {"doc_count": 5},
        "o_applied_8": {"doc_count": 4},
    }}
    names = spark.createDataFrame([("101", "North")], "office_id string, entity string")
    cells = _cells(PA.flat_cells(_pages(spark, [payload]), _progs(spark), names))
    assert cells == [
        ("North", "GV", "incoming", "APP", 5),
        ("North", "GV", "incoming", "RE", 2),
        ("North", "GV", "outgoing", "APP", 3),
        ("office 102", "GTa", "outgoing", "APP", 4),  # unknown office id -> "office <id>"
    ]


def test_flat_two_digit_id_diagnostic_unknown_status_and_malformed(spark):
    payload = {"response": {"applied_total": {"doc_count": 7}, "7": _node(o_applied_12=6, o_approval_broken_12=2, o_teleported_12=9, o_applied_13=1,
                                      i_realized_7="not a node")}}
    cells = _cells(PA.flat_cells(_pages(spark, [payload]), _progs(spark)))
    assert ("office 7", "XX", "outgoing", "APP", 6) in cells            # two-digit programme id
    assert ("office 7", "XX", "outgoing", "APPROVAL_BROKEN", 2) in cells  # diagnostic column
    assert ("office 7", "programme_13", "outgoing", "APP", 1) in cells  # unknown programme id
    assert ("office 7", "GV", "incoming", "RE", 0) in cells             # malformed node -> 0
    assert not any(c[3] == "teleported" for c in cells)


def test_retired_all_zero_cells_are_dropped(spark):
    payload = {"response": {"5": _node(o_applied_7=4, o_applied_1=0, o_realized_1=0), "applied_total": {"doc_count": 4}}}
    panel = PA.envelope_to_panel(_pages(spark, [payload]), spark.createDataFrame([(1, "GV-legacy"), (7, "GV")], "programme_id int, product string"))
    rows = panel.collect()
    assert [(r["product"], r["APP"]) for r in rows] == [("GV", 4)]
    assert rows[0]["programme"] == "oGV" and rows[0]["month_name"] == "Mar" and rows[0]["quarter"] == 1


NESTED_A = {"aggregations": {"offices": {"buckets": [
    {"key": 12, "key_as_string": "North", "doc_count": 9, "directions": {"buckets": [
        {"key": "og", "programmes": {"buckets": [
            {"key": 7, "statuses": {"buckets": [{"key": "applied", "doc_count": 5}, {"key": "Realized", "doc_count": 2},
                                                {"key": "teleported", "doc_count": 9}]}}]}},
        {"key": "Sending", "programmes": {"buckets": [
            {"key": 8, "statuses": {"buckets": [{"key": "approved", "doc_count": 1}]}}]}}]}}]}}}

NESTED_B = {"wrapper": {"types": {"buckets": [
    {"key": "OUT", "lcs": {"buckets": [
        {"key": 12, "key_as_string": "North", "program": {"buckets": [
            {"key": 7, "stage": {"buckets": [{"key": "applied", "doc_count": 5}, {"key": "realized", "doc_count": 2}]}},
            {"key": 8, "stage": {"buckets": [{"key": "approved", "doc_count": 1}]}}]}}]}}]}}}


def test_nested_walk_and_reversed_nesting_give_same_cells(spark):
    a = _cells(PA.nested_cells(_pages(spark, [NESTED_A]), _progs(spark)))
    b = _cells(PA.nested_cells(_pages(spark, [NESTED_B]), _progs(spark)))
    assert a == b == [
        ("North", "GTa", "outgoing", "APD", 1),
        ("North", "GV", "outgoing", "APP", 5),
        ("North", "GV", "outgoing", "RE", 2),
    ]


@pytest.mark.parametrize("depth", [1, 7, 8, 25])
def test_nested_walk_has_no_depth_limit(spark, depth):
    wrapped, in_buckets = NESTED_A, {"status": {"buckets": [{"key": "applied", "doc_count": 4}]}}
    for _ in range(depth):
        wrapped, in_buckets = {"inner": wrapped}, {"level": {"buckets": [{"key": "x", **in_buckets}]}}
    assert _cells(PA.nested_cells(_pages(spark, [wrapped]), _progs(spark))) == _cells(PA.nested_cells(_pages(spark, [NESTED_A]), _progs(spark)))
    assert _cells(PA.nested_cells(_pages(spark, [in_buckets]), _progs(spark))) == [(None, None, None, "APP", 4)]


def test_nested_empty_and_router(spark):
    flat_children_only = {"response": {"1": _node(i_applied_7=1)}}  # no parent totals: not recognised as flat
    pages = _pages(spark, [{}, NESTED_A, {"response": {"1": _node(i_applied_7=1), "applied_total": {"doc_count": 1}}},
                           flat_children_only])
    assert PA.nested_cells(_pages(spark, [{}]), _progs(spark)).count() == 0
    shapes = [r[0] for r in pages.select(PA.is_flat_payload(F.try_parse_json("page"))).collect()]
    assert shapes == [False, False, True, False]


def test_status_label_under_status_dimension(spark):
    page = {"status": {"buckets": [{"key": 3, "key_as_string": "Approved", "doc_count": 4}]}}
    cells = _cells(PA.nested_cells(_pages(spark, [page]), _progs(spark)))
    assert cells == [(None, None, None, "APD", 4)]


def test_envelope_defaults(spark):
    page = {"status": {"buckets": [{"key": "applied", "doc_count": 4}]}}
    panel = PA.envelope_to_panel(_pages(spark, [page], product="GTe"), _progs(spark), default_entity="Head office").collect()
    assert [(r["entity"], r["product"], r["direction"], r["programme"], r["APP"]) for r in panel] == [
        ("Head office", "GTe", "unknown", "GTe", 4)]


def test_month_windows_edges_partial_and_reversed(spark):
    b = spark.createDataFrame([("2024-01-15", "2024-03-10")], "start string, end string")
    rows = [(r["month"], str(r["window_start"]), str(r["window_end"])) for r in PA.month_windows(b).collect()]
    assert rows == [("2024-01", "2024-01-15", "2024-01-31"), ("2024-02", "2024-02-01", "2024-02-29"),
                    ("2024-03", "2024-03-01", "2024-03-10")]
    bad = spark.createDataFrame([("2024-03-01", "2024-01-01")], "start string, end string")
    with pytest.raises(Exception):
        PA.month_windows(bad).collect()


def test_redact(spark):
    df = spark.createDataFrame([("a?token=s3cr3t&b=s3cr3t", "s3cr3t"), ("keep", None), ("keep", "")], "t string, k string")
    out = [r[0] for r in df.select(PA.redact(F.col("t"), F.col("k"))).collect()]
    assert out == ["a?token=***REDACTED***&b=***REDACTED***", "keep", "keep"]


def test_envelope_roundtrip(spark, tmp_path):
    from funnelcast.sources import envelope as EN

    pages = _pages(spark, [NESTED_A, {"response": {"1": _node(i_applied_7=1)}}])
    EN.write_envelope(pages, str(tmp_path / "env"), {"source": "test"})
    back = EN.read_envelope(spark, str(tmp_path / "env"))
    assert back.count() == 2
    doc = tmp_path / "doc.json"
    doc.write_text(json.dumps({"metadata": {}, "records": [{"month": "2024-01", "product": "GV", "pages": [NESTED_A]}]}))
    assert EN.read_envelope(spark, str(doc)).count() == 1
    with pytest.raises(FileNotFoundError):
        EN.read_envelope(spark, str(tmp_path / "missing"))


def test_huge_counts_and_ids_do_not_abort(spark):
    from pyspark.sql import functions as F

    from funnelcast.operators import parsing

    page = spark.createDataFrame([('{"doc_count": 1e300}',), ('{"doc_count": "x"}',), ('{"doc_count": 7}',)], "page string")
    got = parsing.with_variant_page(page).select(parsing._count(F.col("page")).alias("n")).collect()
    assert [r.n for r in got] == [0, 0, 7]


def test_duplicate_names_do_not_multiply_rows(spark):
    from funnelcast.sources.envelope import with_names

    rows = spark.createDataFrame([("1", 3), ("2", 4)], "office_id string, n int")
    names = spark.createDataFrame([("1", "A"), ("1", "B")], "office_id string, entity string")
    assert sorted((r.entity, r.n) for r in with_names(rows, names).collect()) == [("B", 3), ("office 2", 4)]
