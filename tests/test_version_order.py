"""Sort keys against the order that each ecosystem's rule gives, and the opt-in gate."""

import itertools

import pytest
from pyspark.sql import functions as F
from test_decide import run

from clearwright.functions import version_order as O
from clearwright.operators import decide as D

# Each list is in ascending order; entries of one tuple are equal.
ORDER = {
    "deb": ["1.0~~", "1.0~~a", "1.0~", "1.0~rc1", ("1.0", "1.0-0", "0:1.0", "1.00"), "1.0-1", "1.0-1+b1", "1.0-1.1", "1.0-10", "1.0a", "1.0+dfsg-1", "1.0.1", "1.2", "1.10", "2.0~beta-1", "2.0-1", "1:0.1", "2:0.0.1-1", "10:0"],
    "rpm": ["1.0~rc1-1", ("1.0-1", "0:1.0-1", "1_0-1"), "1.0-1.fc39", "1.0-1.fc40", "1.0-2", "1.0-10", "1.0^git1-1", "1.0a-1", "1.0.1-1", "1.2-1", "1.10-1", "1:0.5-1"],
    "apk": ["1.2_alpha", "1.2_alpha2", "1.2_beta", "1.2_pre1", "1.2_rc1", "1.2_rc2", "1.2", "1.2-r0", "1.2-r1", "1.2-r10", "1.2_cvs", "1.2_git2", "1.2_p1", "1.2_p1-r1", "1.2a", "1.2b", "1.2.1", "1.10", "2"],
}


@pytest.mark.parametrize("kind", ORDER)
def test_keys_have_the_order_of_the_ecosystem(spark, kind):
    groups = [(g,) if isinstance(g, str) else g for g in ORDER[kind]]
    rows = [(n, v) for n, g in enumerate(groups) for v in g]
    keys = {r.v: r.k for r in spark.createDataFrame(rows, "n int, v string").select("v", O.version_key(F.lit(kind), F.col("v")).alias("k")).collect()}
    for (a, x), (b, y) in itertools.combinations(rows, 2):
        assert (keys[x] < keys[y]) == (a < b) and (keys[x] == keys[y]) == (a == b), (x, y)


def test_other_ecosystems_have_no_key(spark):
    got = spark.createDataFrame([("npm", "1.0"), ("deb", ""), ("deb", None), (None, "1")], "t string, v string").select(O.version_key(F.col("t"), F.col("v")).alias("k")).collect()
    assert [r.k for r in got] == [None] * 4


def test_gate_is_off_by_default_and_takes_entries_away_when_on(spark):
    findings, cat, facts = run(spark)
    libm = "pkg:deb/debian/libm@1-2?upstream=msrc"
    ranges = spark.createDataFrame([("mapped", "cve-2024-0001", "deb", "2", None)], "component string, cve string, ecosystem string, introduced string, fixed string")
    inside = ranges.withColumn("introduced", F.lit("0.5"))
    got = {name: {r.component_purl: r.rule_id + (r.reason_code or "") for r in D.decide(findings, cat, facts, x).collect()} for name, x in (("off", None), ("out", ranges), ("in", inside))}
    assert got["off"][libm] == got["in"][libm] == "D01" and got["out"][libm] == "D03manifest_no_entry"
    assert {k: v for k, v in got["out"].items() if k != libm} == {k: v for k, v in got["off"].items() if k != libm}
