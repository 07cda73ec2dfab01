"""Nothing is lost without a count: faulty pages, lines, counts and ids; versions and failures of windows."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from funnelcast.operators import parsing as PA
from funnelcast.operators import reports as A
from funnelcast.plans.analysis import build_panel
from funnelcast.sources import envelope as EN
from funnelcast.streaming import ingest as ST

PAGES = "month string, record_product string, page string"


def flat(month, office, **cells):
    node = {"applied_total": {"doc_count": 1}, **{k: {"doc_count": v} for k, v in cells.items()}}
    return (month, None, json.dumps({"response": {str(office): node, "applied_total": {"doc_count": 1}}}))


@pytest.fixture(scope="module")
def programmes(spark):
    return spark.createDataFrame([(7, "GV"), (8, "GT")], "programme_id int, product string")


def test_integers_as_the_source_reads_them(spark):
    cases = {'"12"': 12, '" 12 "': 12, '"12.5"': 0, "12.5": 12, "-3": -3, '"+4"': 4, '"x"': 0, "null": 0, "true": 1, "{}": 0, "[1]": 0, "1e300": 0,
             "9223372036854775808": 0, '"9223372036854775808"': 0, "9223372036854775807": 9223372036854775807}
    pages = PA.with_variant_page(spark.createDataFrame([(f'{{"doc_count": {k}}}',) for k in [*cases]], "page string"))
    rows = pages.select(F.to_json("page").alias("p"), PA._count(F.col("page")).alias("n"), PA._count_fault(F.col("page")).alias("fault")).collect()
    assert [r.n for r in rows] == list(cases.values())
    faulty = {k for k, r in zip(cases, rows) if r.fault}
    assert faulty == {'"12.5"', '"x"', "{}", "[1]", "1e300", "9223372036854775808", '"9223372036854775808"'}
    assert PA.with_variant_page(spark.createDataFrame([("{}",)], "page string")).select(PA._count_fault(F.col("page"))).first()[0] is None


def test_ids_of_any_size_keep_their_cells_apart(spark, programmes):
    big = [str(2**31 + 5), str(2**70)]
    pages = spark.createDataFrame([flat("2024-01", 1, **{f"o_applied_{big[0]}": 2, f"o_applied_{big[1]}": 3, "o_applied_007": 4, "o_applied_9": 5})], PAGES)
    got = {r["product"]: r["n"] for r in PA.flat_cells(pages, programmes).collect()}
    assert got == {f"programme_{big[0]}": 2, f"programme_{big[1]}": 3, "GV": 4, "programme_9": 5}
    node = {"response": {f"open_i_programme_{big[0]}": {"doc_count": 6}, "open_o_programme_7": {"doc_count": 1, "total_openings": {"value": "12.5"}}}}
    opened = PA.flat_open_openings(spark.createDataFrame([("2024-01", None, json.dumps(node))], PAGES), programmes).collect()
    assert {(r["product"], r["open_openings"]) for r in opened} == {(f"programme_{big[0]}", 6), ("GV", 0)}


def test_a_response_that_is_no_object_is_not_flat(spark):
    texts = ['{"response": [1], "applied_total": 1}', '{"response": {"applied_total": 1}}', '{"applied_total": 1}', '{"response": {"i_applied_7": 1}}', "[1]"]
    pages = spark.createDataFrame([(t,) for t in texts], "page string")
    assert [r[0] for r in pages.select(PA.is_flat_payload(F.try_parse_json("page"))).collect()] == [False, True, True, True, False]


def test_unreadable_pages_and_counts_are_listed_and_counted(spark, programmes):
    rows = [flat("2024-01", 1, o_applied_7=5, i_applied_8="many"), ("2024-01", None, '{"broken": '), ("2024-01", None, "3"), ("2024-02", "GT", None)]
    pages = spark.createDataFrame(rows, PAGES)
    assert sorted((r.month, r.record_product, r.reason, r.raw) for r in PA.quarantine(pages).collect() if r.month == "2024-01") == [
        ("2024-01", None, "neither object nor list", "3"), ("2024-01", None, "not JSON", '{"broken": ')]
    cells = PA.payload_cells(pages, programmes)
    audit = {(r.month, r.record_product): (r.pages, r.malformed_pages, r.cells, r.faulty_counts) for r in PA.page_audit(pages, cells).collect()}
    assert audit == {("2024-01", None): (3, 2, 2, 1), ("2024-02", "GT"): (1, 1, 0, 0)}
    expected = spark.createDataFrame([("2024-01",), ("2024-02",)], "month string")
    whole = EN.ingest_audit(expected, cells, pages=PA.page_audit(pages, cells)).first().asDict()
    assert whole == {"windows_attempted": 2, "windows_succeeded": 1, "windows_failed": 1, "success_rate": 0.5,
                     "pages": 4, "malformed_pages": 3, "faulty_counts": 1}


def test_one_bad_line_does_not_stop_the_rest(spark, programmes, tmp_path):
    EN.write_envelope(spark.createDataFrame([flat("2024-01", 1, o_applied_7=5)], PAGES), str(tmp_path / "e"))
    spark.createDataFrame([('{"month": "2024-02", "pages": [',), ("",)], "value string").coalesce(1).write.mode("append").text(str(tmp_path / "e" / "records" / "version=1"))
    pages = EN.read_envelope(spark, str(tmp_path / "e"))
    assert pages.count() == 3 and PA.quarantine(pages).count() == 2
    panel, _ = build_panel(pages, programmes)
    assert [(r["entity"], r["APP"]) for r in panel.collect()] == [("office 1", 5)]


def test_no_records_is_an_error(spark, programmes):
    with pytest.raises(ValueError, match="No records"):
        build_panel(spark.createDataFrame([], PAGES), programmes)


def test_a_window_collected_again_replaces_the_earlier_one(spark, programmes, tmp_path):
    path = str(tmp_path / "e")
    EN.write_envelope(spark.createDataFrame([flat("2024-01", 1, o_applied_7=3), flat("2024-02", 1, o_applied_7=4)], PAGES), path)
    failures = spark.createDataFrame([("2024-02", None, "timeout"), ("2024-03", None, "401")], "month string, product string, reason string")
    EN.write_envelope(spark.createDataFrame([flat("2024-01", 1, o_applied_7=6)], PAGES), path, {"note": "again"}, failures)
    panel = PA.envelope_to_panel(EN.read_envelope(spark, path), programmes).collect()
    assert {(str(r["date"]), r["APP"]) for r in panel} == {("2024-01-01", 6), ("2024-02-01", 4)}
    failed = {(r["month"], r["reason"], r["has_earlier"]) for r in EN.failed_windows(EN.read_manifest(spark, path)).collect()}
    assert failed == {("2024-02", "timeout", True), ("2024-03", "401", False)}
    assert {r.failed_windows for r in spark.read.json(f"{path}/metadata").collect()} == {0, 2}


def test_a_collection_without_manifest_is_not_read(spark, programmes, tmp_path):
    path = str(tmp_path / "e")
    EN.write_envelope(spark.createDataFrame([flat("2024-01", 1, o_applied_7=3)], PAGES), path, version=1, source="a")
    lost = json.dumps({"source": "a", "month": "2024-01", "product": None, "version": 2, "pages": [{"cut": 1}]})
    spark.createDataFrame([(lost,)], "value string").write.text(f"{path}/records/version=2")
    panel = PA.envelope_to_panel(EN.read_envelope(spark, path), programmes).collect()
    assert [r["APP"] for r in panel] == [3]


def test_the_stream_replaces_a_window_too(spark, programmes, tmp_path):
    landing, cells = str(tmp_path / "landing"), str(tmp_path / "cells")
    for n in (3, 6):
        EN.write_envelope(spark.createDataFrame([flat("2024-01", 1, o_applied_7=n), flat("2024-02", n, o_applied_7=1)], PAGES), landing + "/a")
        ST.start_cell_stream(spark, landing + "/a/records", cells, programmes).awaitTermination()
    got = {(str(r["date"]), r["entity"], r["APP"]) for r in ST.panel_from_cells(spark, cells).collect()}
    assert got == {("2024-01-01", "office 1", 6), ("2024-02-01", "office 6", 1)}


def test_overlay_of_given_years_refuses_others(panel_small):
    with pytest.raises(Exception, match="a year outside the overlay"):
        A.year_overlay(panel_small, years=(1995, 1996)).collect()
    assert A.year_overlay(panel_small).columns[0] == "month"
