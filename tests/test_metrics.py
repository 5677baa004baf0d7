import pytest
from pyspark.sql import functions as F

from clearwright.functions import stats
from clearwright.operators import metrics as M
from clearwright.operators import sampling as S


def test_wilson(spark):
    df = spark.createDataFrame([(5, 15385), (0, 0), (0, 15641)], "k int, n int")
    rows = df.select(stats.wilson(F.col("k"), F.col("n")).alias("w")).collect()
    assert (rows[0]["w"]["pct"], rows[0]["w"]["ci_low_pct"], rows[0]["w"]["ci_high_pct"]) == (0.0325, 0.0139, 0.0761)
    assert tuple(rows[1]["w"]) == (0.0, 0.0, 0.0)
    assert rows[2]["w"]["ci_low_pct"] == 0.0 and rows[2]["w"]["ci_high_pct"] == 0.0246


def labelled(spark, n):
    rows = [(str(i), "NOT_AFFECTED" if i < 20 else "UNDER_INVESTIGATION", None if i < 20 else "manifest_no_entry",
             "UNDER_INVESTIGATION") for i in range(n)]
    return spark.createDataFrame(rows, "id string, pipeline_verdict string, reason_code string, human_label string")


def test_agreement_on_a_complete_set(spark):
    r = M.agreement(labelled(spark, 100)).first()
    assert (r["false_not_affected"], r["agreement_count"], r["agreement_rate_pct"], r["full_evaluable"]) == (20, 80, 80.0, True)
    pr = {x["reason_code"]: x for x in M.precision_recall(labelled(spark, 100)).collect()}
    assert pr["manifest_no_entry"]["precision"] == 1.0 and pr["(none)"]["precision"] is None and pr["(none)"]["recall"] == 0.0


def test_sample_quotas_and_replay(spark):
    rows = [("fw" if i % 5 == 0 else "app", f"a{i % 7}", f"CVE-{i}", "p", "not_affected" if i % 11 == 0 else "refusal",
             None if i % 11 == 0 else f"r{i % 3}") for i in range(600)]
    df = spark.createDataFrame(rows, "class string, artifact_id string, cve string, component_purl string, kind string, reason_code string").withColumn(
        "class", F.when(F.col("class") == "fw", "firmware").otherwise("oci-app"))
    a = S.stratified_sample(df, 7)
    got = a.collect()
    assert len(got) == 100 and len({tuple(r[c] for c in S.KEY) for r in got}) == 100
    assert sum(r["class"] == "firmware" for r in got) >= 40 and sum(r["kind"] == "not_affected" for r in got) >= 20
    assert sorted(map(tuple, got)) == sorted(map(tuple, S.stratified_sample(df.repartition(3), 7).collect()))
    with pytest.raises(ValueError):
        S.stratified_sample(df.where(F.col("class") != "firmware"), 7)


def test_sample_of_short_quotas_takes_what_there_is(spark):
    rows = [("firmware" if i < 10 else "oci-app", "a", f"CVE-{i}", "p", "not_affected" if i % 40 == 0 else "refusal",
             None if i % 40 == 0 else f"r{i % 3}") for i in range(160)]
    df = spark.createDataFrame(rows, "class string, artifact_id string, cve string, component_purl string, kind string, reason_code string")
    got = S.stratified_sample(df, 7, strict=False).collect()
    assert len(got) == len({r["cve"] for r in got}) == 100
    assert sum(r["class"] == "firmware" for r in got) >= 10 and sum(r["kind"] == "not_affected" for r in got) == 4
    few = S.stratified_sample(df.limit(30), 7, strict=False)
    assert few.count() == 30
    assert S.stratified_sample(df.limit(0), 7, strict=False).count() == 0
