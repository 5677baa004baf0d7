"""Registered queries against DuckDB on the smallest tables, and properties of the registry."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = ("part", "lineitem", "orders", "documents", "benchmark", "labels", "events", "pages")
PICKED = ("a06_stage_histogram", "d00_decisions", "a21_vex_audit", "k04_openvex_lines", "s11_csaf_statements", "j21_lines_in_functions",
          "j18_evidence_pack", "i03_inventory_facts", "o05_inventories_by_path", "o06_string_rows", "a09_label_agreement", "a13_materiality_verdict", "p18_explanations",
          "f32_reason_and_rule_texts", "f15_debian_versions", "f16_alpine_versions", "f17_rpm_versions", "f18_cosmetic_suffixes", "j06_string_identity_hits", "j07_component_inventories", "a24_artifact_hashes")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables absent")


@pytest.mark.parametrize("name", PICKED)
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    want = sorted((repr([r[names.index(c)] for c in cols]) for r in cur.fetchall()))
    assert sorted(names) == cols
    assert sorted(repr([r[c] for c in cols]) for r in df.collect()) == want


def test_entry(spark):
    assert entry.entry(spark).count() == 24


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
