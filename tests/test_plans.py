"""Joins of unpacked rows never send a side through the driver, whatever its guessed size."""

from clearwright.operators import decide as D
from clearwright.operators import patches as PT
from clearwright.plans import views as W
from clearwright.sources import vex as SV


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_line_joins_are_shuffled(spark):
    lines = spark.createDataFrame([(1, "a.c", "new", 3)], "patch_id bigint, path string, side string, line int")
    spans = spark.createDataFrame([(1, "a.c", "new", "f", 1, 700)], "patch_id bigint, path string, side string, function string, start_line int, end_line int")
    found = PT.enclosing_functions(lines, spans)
    assert "BroadcastExchange" not in _plan(found) and found.count() == 1
    fixes = spark.createDataFrame([("CVE-1", 1)], "cve string, patch_id bigint")
    assert "BroadcastExchange" not in _plan(PT.touched_functions(lines, spans, fixes))


def test_csaf_joins_are_shuffled(spark):
    body = ('{"vulnerabilities":[{"cve":"CVE-1","product_status":{"fixed":["o:x"]},"flags":[{"label":"l","product_ids":["o:x"]}]}],'
            '"product_tree":{"branches":[{"product":{"product_id":"x","product_identification_helper":{"purl":"pkg:a/x@1"}}}],'
            '"relationships":[{"product_reference":"x","relates_to_product_reference":"o","full_product_name":{"product_id":"o:x"}}]}}')
    rows = SV.csaf_statements(spark.createDataFrame([("d", body)], "doc_id string, content string"))
    assert "BroadcastExchange" not in _plan(rows)
    assert [(r.products, r.justification, r.indirect) for r in rows.collect()] == [(["pkg:a/x@1"], "l", True)]


def test_one_row_group_of_texts_is_worked_on_by_several_tasks(spark):
    sf = "/root/testdata/sf0.001"
    assert spark.read.parquet(f"{sf}/documents.parquet").rdd.getNumPartitions() == 1
    for rows in (W.ro_strings(spark, sf), W.symbols(spark, sf), W.inventories(spark, sf)):
        assert rows.rdd.getNumPartitions() > 1


def test_few_artifacts_do_not_shuffle_the_symbols(spark):
    symbols = spark.createDataFrame([("a", "i", "f", "f"), ("b", "i", "f", "f")], "artifact_id string, inventory_id string, raw string, normalized string")
    asked = D._asked(symbols.repartition(3), spark.createDataFrame([("a", "c")], "artifact_id string, component string"), "artifact_id")
    assert "SortMergeJoin" not in _plan(asked) and [r.artifact_id for r in asked.collect()] == ["a"]
