"""Corpus metrics over decisions, inventories, scan summaries and hand labels."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clearwright.functions import stats
from clearwright.functions import verdict as V
from clearwright.operators.tables import materialize
from clearwright.functions.text import blank_to_null

# Strata reported next to the overall histogram.
STRATA = ("firmware", "substitute-container")
CONTAINER_CLASSES = ("oci-base", "oci-app", "substitute-container")
# Percentage points from which two strata count as different.
MATERIAL_POINTS = 15.0
# Fixed value: how many points less stripped firmware must be for a static difference to count.
CLEAR_POINTS = 10.0
# The evaluability gate: this share or more stopping before the symbol stages.
UPSTREAM_LIMIT_PCT = 99.0


def with_class(df: DataFrame, classes: DataFrame) -> DataFrame:
    """Left join of the artifact class, `unknown` when the catalogue lacks it."""
    known = classes.select("artifact_id", F.col("class").alias("__class"))
    return (
        df.join(known, "artifact_id", "left")
        .withColumn("class", F.coalesce("__class", F.lit("unknown"))).drop("__class")
    )


def count_where(condition: Column, name: str) -> Column:
    return F.count_if(condition).alias(name)


def _breakdown(df: DataFrame, key: str, label: Column, out: str) -> DataFrame:
    """Counts per label as a map with sorted keys, one row per `key`."""
    counted = df.groupBy(key, label.alias("__label")).agg(F.count(F.lit(1)).alias("__n"))
    pairs = F.array_sort(F.collect_list(F.struct("__label", "__n")))
    return counted.groupBy(key).agg(F.map_from_entries(pairs).alias(out))


def scan_summaries(decisions: DataFrame, inventories: DataFrame) -> DataFrame:
    """One summary per artifact; labels are a fixed vocabulary, so the maps stay small."""
    verdict = F.col("verdict")
    counts = decisions.groupBy("artifact_id").agg(
        F.count(F.lit(1)).alias("cves_in"),
        count_where(verdict == V.NOT_AFFECTED, "not_affected"),
        count_where(verdict == V.AFFECTED, "affected"),
        count_where(verdict == V.UNDER_INVESTIGATION, "refused"),
    )
    binaries = inventories.groupBy("artifact_id").agg(
        F.count(F.lit(1)).alias("binaries_scanned"), count_where(F.col("stripped"), "stripped"),
        count_where(F.col("static_linked"), "static_linked"),
    )
    cleared = _breakdown(
        decisions.where(verdict == V.NOT_AFFECTED), "artifact_id",
        F.coalesce(blank_to_null(F.col("justification")), F.lit("unspecified")), "not_affected_breakdown")
    refused = _breakdown(
        decisions.where(verdict == V.UNDER_INVESTIGATION), "artifact_id",
        V.reason_label(F.col("reason_code")), "refused_breakdown")
    joined = (
        binaries.join(counts, "artifact_id", "full").join(cleared, "artifact_id", "left")
        .join(refused, "artifact_id", "left")
    )
    numbers = ("binaries_scanned", "stripped", "static_linked", "cves_in", "not_affected", "affected", "refused")
    filled = joined.select(
        "artifact_id", *[F.coalesce(n, F.lit(0)).alias(n) for n in numbers],
        "not_affected_breakdown", "refused_breakdown",
    )
    return filled.withColumn(
        "coverage_percent", stats.whole_percent(F.col("not_affected") + F.col("affected"), F.col("cves_in"))
    ).withColumn("success", F.lit(True))


def coverage_rollup(summaries: DataFrame) -> DataFrame:
    """Totals, per class and per artifact; coverage is recomputed from the sums of each level."""
    decided = F.sum(F.col("not_affected") + F.col("affected"))
    level = F.grouping_id()
    rolled = summaries.rollup("class", "artifact_id").agg(
        level.alias("__level"), F.countDistinct("artifact_id").alias("artifacts"),
        F.sum("cves_in").alias("cves_in"), F.sum("not_affected").alias("not_affected"),
        F.sum("affected").alias("affected"), F.sum("refused").alias("refused"), decided.alias("decided"),
    )
    return rolled.select(
        F.when(F.col("__level") == 3, "total").when(F.col("__level") == 1, "class").otherwise("artifact").alias("level"),
        "class", "artifact_id",
        F.when(F.col("__level") == 0, F.lit(1)).otherwise(F.col("artifacts")).cast("bigint").alias("artifacts"),
        "cves_in", "not_affected", "affected", "refused", "decided",
        stats.whole_percent(F.col("decided"), F.col("cves_in")).alias("coverage_percent"),
    )


def stage_dimension(df: DataFrame) -> DataFrame:
    rows = [(i, stage, name) for i, (stage, name, _) in enumerate(V.STAGES)]
    return df.sparkSession.createDataFrame(rows, "stage_ord int, stage_id string, stage_name string")


def stage_histogram(staged: DataFrame, strata: tuple[str, ...] = STRATA) -> DataFrame:
    """Per scope and stage: count, percent and cumulative percent; empty stages show zero."""
    spark = staged.sparkSession
    by_class = staged.groupBy("class", "stage_id").agg(F.count(F.lit(1)).alias("n"))
    scopes = spark.createDataFrame([("all",), *[(s,) for s in strata]], "scope string")
    counted = (
        by_class.where(F.col("class").isin(*strata))
        .select(F.col("class").alias("scope"), "stage_id", "n")
        .unionByName(by_class.select(F.lit("all").alias("scope"), "stage_id", "n"))
        .groupBy("scope", "stage_id").agg(F.sum("n").alias("n"))
    )
    # Eight stages by a handful of scopes: a fixed grid, and windows of eight rows.
    grid = scopes.select("scope", F.explode(F.array(*[F.lit(s) for s in V.STAGE_IDS])).alias("stage_id")).join(
        stage_dimension(staged), "stage_id")
    full = grid.join(counted, ["scope", "stage_id"], "left").withColumn("count", F.coalesce("n", F.lit(0)))
    totals = counted.groupBy("scope").agg(F.sum("n").alias("total"))
    running = W.partitionBy("scope").orderBy("stage_ord").rowsBetween(W.unboundedPreceding, W.currentRow)
    return full.join(totals, "scope", "left").select(
        "scope", "stage_id", "stage_name", "count",
        F.round(stats.percent(F.col("count"), F.coalesce("total", F.lit(0))), 4).alias("percent"),
        F.round(stats.percent(F.sum("count").over(running), F.coalesce("total", F.lit(0))), 4)
        .alias("cumulative_percent"),
    )


def reached_stages(staged: DataFrame) -> DataFrame:
    order = V.stage_order(F.col("stage_id"))
    s3 = V.STAGE_IDS.index("S3")
    return staged.agg(
        F.count(F.lit(1)).alias("total"),
        count_where(F.coalesce(order >= s3, F.lit(False)), "symbol_stage_or_later"),
        count_where((F.col("stage_id") == "S7") & (F.col("termination") == "decided"), "evidence_stage"),
        count_where(F.col("stage_id").isin("S3", "S5"), "symbol_refusals"),
        count_where(F.col("stage_id").isin("S1", "S2"), "upstream_terminations"),
    )


def empty_reasons(decisions: DataFrame) -> DataFrame:
    """Rows without a reason code, by verdict and by rule."""
    empty = decisions.where(F.coalesce("reason_code", F.lit("")) == "")
    return empty.groupingSets([["verdict"], ["rule_id"]], "verdict", "rule_id").agg(
        F.count(F.lit(1)).alias("n"))


def refusals_by_reason(decisions: DataFrame) -> DataFrame:
    refused = decisions.where(F.col("verdict") == V.UNDER_INVESTIGATION)
    reason = F.coalesce(blank_to_null(F.col("reason_code")), F.lit("unspecified"))
    return refused.groupBy(reason.alias("reason_code")).agg(F.count(F.lit(1)).alias("n")).orderBy(
        F.desc("n"), "reason_code")


def evaluability(reached: DataFrame) -> DataFrame:
    """NOT EVALUABLE when symbol gates never fire and nearly everything stops upstream."""
    pct = F.round(stats.percent(F.col("upstream_terminations"), F.col("total")), 4)
    ok = (F.col("total") > 0) & ((F.col("symbol_refusals") != 0) | (pct < UPSTREAM_LIMIT_PCT))
    return reached.select("total", "symbol_refusals", pct.alias("upstream_pct"), ok.alias("evaluable"))


def threshold_verdict(pct: Column, threshold: float, evaluable: Column) -> Column:
    return F.when(~evaluable, "NOT EVALUABLE").when(pct >= threshold, "PASS").otherwise("FAIL")


def binary_profile(inventories: DataFrame, by: list[str]) -> DataFrame:
    """Binaries, stripped, static and dynamic-only counts with their shares."""
    n = F.count(F.lit(1))
    return inventories.groupBy(*by).agg(
        n.alias("binaries"), count_where(F.col("stripped"), "stripped"),
        count_where(F.col("static_linked"), "static_linked"),
        count_where(F.col("stripped") & F.col("has_dynamic"), "dynsym_only"),
        F.round(stats.percent(F.count_if(F.col("stripped")), n), 4).alias("stripped_pct"),
        F.round(stats.percent(F.count_if(F.col("static_linked")), n), 4).alias("static_pct"),
        F.round(stats.percent(F.count_if(F.col("stripped") & F.col("has_dynamic")), n), 4).alias("dynsym_only_pct"),
    )


def materiality(inventories: DataFrame) -> DataFrame:
    """Firmware against containers on stripped and static shares, with a verdict."""
    def share(flag: str, mine: Column) -> Column:
        return stats.percent(F.count_if(mine & F.col(flag)), F.count_if(mine))

    firmware, container = F.col("class") == "firmware", F.col("class").isin(*CONTAINER_CLASSES)
    row = inventories.agg(
        F.count_if(firmware).alias("firmware_binaries"), F.count_if(container).alias("container_binaries"),
        share("stripped", firmware).alias("fs"), share("stripped", container).alias("cs"),
        share("static_linked", firmware).alias("ft"), share("static_linked", container).alias("ct"),
    )
    strip, static = F.col("fs") - F.col("cs"), F.col("ft") - F.col("ct")
    # Named facts first; the verdict is the first of a list of outcomes whose facts all hold.
    facts = {
        "no_firmware": F.col("firmware_binaries") == 0,
        "no_container": F.col("container_binaries") == 0,
        "stripped_differs": F.abs(strip) >= MATERIAL_POINTS,
        "static_differs": F.abs(static) >= MATERIAL_POINTS,
        "less_stripped": strip < 0,
        "clearly_less_stripped": strip < -CLEAR_POINTS,
        "more_static": static > 0,
    }
    outcomes = (
        ("no firmware binaries", ["no_firmware"]),
        ("no container binaries", ["no_container"]),
        ("firmware less stripped or more static", ["stripped_differs", "less_stripped"]),
        ("firmware less stripped or more static", ["static_differs", "more_static", "clearly_less_stripped"]),
        ("firmware at least as stripped", ["stripped_differs"]),
        ("mixed", ["static_differs"]),
    )
    verdict = F.coalesce(
        *(F.when(reduce(and_, (facts[f] for f in needed)), F.lit(name)) for name, needed in outcomes), F.lit("not materially different"))
    return row.select(
        "firmware_binaries", "container_binaries", F.round(strip, 4).alias("stripped_delta"),
        F.round(static, 4).alias("static_delta"), verdict.alias("verdict"))


# ------------------------------------------------------------- hand labels

def _scored(labelled: DataFrame) -> DataFrame:
    def norm(c: str) -> Column:
        return F.upper(F.trim(F.coalesce(c, F.lit(""))))

    return labelled.withColumn("pipe", norm("pipeline_verdict")).withColumn("human", norm("human_label"))


def agreement(labelled: DataFrame, complete: int = 100) -> DataFrame:
    """Soundness against hand labels: false clearances and agreement at any number of labels.

    `full_evaluable` tells whether the set has the `complete` labels a published figure needs.
    """
    df = _scored(labelled)
    has, cleared = F.col("human") != "", F.col("pipe") == V.NOT_AFFECTED
    counts = df.agg(
        F.count(F.lit(1)).alias("label_count"), count_where(~has, "empty_labels"),
        count_where(cleared, "not_affected_total"), count_where(cleared & has, "not_affected_labeled"),
        count_where(has & (F.col("pipe") == F.col("human")), "agreement_count"),
        count_where(has & cleared & (F.col("human") != V.NOT_AFFECTED), "false_not_affected"),
    )
    sound = (F.col("not_affected_total") > 0) & (F.col("not_affected_labeled") == F.col("not_affected_total"))
    full = (F.col("empty_labels") == 0) & (F.col("label_count") == complete)
    labels = F.col("label_count") - F.col("empty_labels")
    return counts.select(
        "label_count", "empty_labels", "not_affected_total", "not_affected_labeled",
        sound.alias("soundness_evaluable"), full.alias("full_evaluable"), (sound | full).alias("evaluable"),
        "false_not_affected", "agreement_count",
        F.round(stats.percent(F.col("agreement_count"), labels), 4).alias("agreement_rate_pct"),
    )


def disagreements(labelled: DataFrame) -> DataFrame:
    return _scored(labelled).where((F.col("human") != "") & (F.col("pipe") != F.col("human")))


def false_clearances(labelled: DataFrame) -> DataFrame:
    return _scored(labelled).where(
        (F.col("human") != "") & (F.col("pipe") == V.NOT_AFFECTED) & (F.col("human") != V.NOT_AFFECTED))


def precision_recall(labelled: DataFrame) -> DataFrame:
    """Refusal precision and recall per reason code; NULL on a zero denominator."""
    df = _scored(labelled)
    pipe, human = F.col("pipe") == V.UNDER_INVESTIGATION, F.col("human") == V.UNDER_INVESTIGATION
    reason = F.coalesce(blank_to_null(F.col("reason_code")), F.lit("(none)"))
    counted = df.groupBy(reason.alias("reason_code")).agg(
        count_where(pipe & human, "tp"), count_where(pipe & ~human, "fp"), count_where(~pipe & human, "fn"))
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    return counted.select(
        "reason_code", "tp", "fp", "fn", stats.ratio(tp, tp + fp).alias("precision"),
        stats.ratio(tp, tp + fn).alias("recall"))


def metric_rows(wide: DataFrame) -> DataFrame:
    """A one-row frame of numbers as (metric, value) rows."""
    columns = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in wide.columns)
    return wide.selectExpr(f"stack({len(wide.columns)}, {columns}) AS (metric, value)")


def library_carriers(files: DataFrame, needed: DataFrame, is_library: Column) -> DataFrame:
    """(artifact_id, path, is_library): library files of each artifact, and the binaries that load one, directly or through others.

    `files` has (artifact_id, path), `needed` (artifact_id, path, needed) the file names that a binary asks its loader for.
    The closure grows by rounds: each joins the last round's new files, by name, with the binaries that need them, so a
    round costs what is new, and there are as many rounds as the longest chain of libraries has links.
    """
    name = F.substring_index("path", "/", -1)
    found = materialize(files.where(is_library).select("artifact_id", "path", F.lit(True).alias("is_library")).distinct())
    last = found
    while not last.isEmpty():
        provided = last.select("artifact_id", name.alias("needed")).distinct()
        loading = needed.join(provided, ["artifact_id", "needed"], "left_semi").select("artifact_id", "path").distinct()
        last = materialize(loading.join(found, ["artifact_id", "path"], "left_anti").withColumn("is_library", F.lit(False)))
        found = found.unionByName(last)
    return found


def artifacts_with_library(matched: DataFrame, carriers: DataFrame) -> DataFrame:
    """Artifacts with a match on a library (artifact_id): how many library files and carriers of it each holds, 0 where none."""
    counted = carriers.groupBy("artifact_id").agg(F.count_if("is_library").alias("library_files"), F.count(F.lit(1)).alias("carriers"))
    return matched.join(counted, "artifact_id", "left").select(
        "artifact_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("library_files", "carriers")))


def reconcile(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Two traversals of one measure per key: where they differ, and by how much."""
    left, right = a.select(key, F.col(value).alias("a")), b.select(key, F.col(value).alias("b"))
    state = (
        F.when(F.col("b").isNull(), "only_a").when(F.col("a").isNull(), "only_b")
        .when(F.col("a") != F.col("b"), "different").otherwise("same")
    )
    delta = F.coalesce("b", F.lit(0)) - F.coalesce("a", F.lit(0))
    return left.join(right, key, "full").select(key, "a", "b", state.alias("state"), delta.alias("delta"))


def check_figures(expected: DataFrame, computed: DataFrame) -> DataFrame:
    """Published figures that do not match the recomputed ones."""
    return (
        expected.join(computed.withColumnRenamed("value", "actual"), "metric", "left")
        .where(~F.coalesce(F.abs(F.col("actual") - F.col("value")) < 1e-9, F.lit(False)))
        .select("metric", F.col("value").alias("expected"), "actual")
    )
