"""Changed lines of patches and the functions they touch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Lines of one bucket in the range join; spans are split over the buckets they cross.
BUCKET_LINES = 256


def _path(text: Column) -> Column:
    return F.regexp_replace(F.substring_index(F.trim(text), "\t", 1), r"^[ab]/", "")


def _start(header: Column, sign: str) -> Column:
    n = F.regexp_extract(header, r"^@@\s*-(\d+)(?:,\d+)?\s+\+(\d+)", 1 if sign == "-" else 2)
    return F.greatest(F.lit(1), F.nullif(n, F.lit("")).cast("int"))


def changed_lines(patches: DataFrame) -> DataFrame:
    """(patch_id, path, side, line) of every added or removed line.

    `patches` has patch_id and patch (unified diff text).  Headers before a line
    are carried down by windows within one patch; line numbers are running counts
    within a hunk, and the function name after `@@` is never read.
    """
    lines = patches.select("patch_id", F.posexplode(F.split("patch", "\n")).alias("n", "text"))
    order = W.partitionBy("patch_id").orderBy("n").rowsBetween(W.unboundedPreceding, W.currentRow)
    text = F.col("text")
    old, new, hunk = text.startswith("--- "), text.startswith("+++ "), text.startswith("@@")
    carried = lines.select(
        "patch_id", "n", "text", (old | new).alias("is_file"), hunk.alias("is_hunk"),
        F.last(F.when(old, _path(F.substr(text, F.lit(5)))), ignorenulls=True).over(order).alias("old_path"),
        F.last(F.when(new, _path(F.substr(text, F.lit(5)))), ignorenulls=True).over(order).alias("new_path"),
        F.last(F.when(hunk, text).when(old | new, F.lit("")), ignorenulls=True).over(order).alias("header"),
        F.count_if(hunk | old | new).over(order).alias("block"),
    ).where(~F.col("is_file") & (F.coalesce("header", F.lit("")) != "") & ~F.col("is_hunk"))
    within = W.partitionBy("patch_id", "block").orderBy("n").rowsBetween(W.unboundedPreceding, -1)
    added, removed = F.col("text").startswith("+"), F.col("text").startswith("-")
    note = F.col("text").startswith("\\")
    counted = carried.select(
        "patch_id", "n", "old_path", "new_path", added.alias("added"), removed.alias("removed"),
        (_start(F.col("header"), "-") + F.coalesce(F.count_if(~added & ~note).over(within), F.lit(0))).alias("old_line"),
        (_start(F.col("header"), "+") + F.coalesce(F.count_if(~removed & ~note).over(within), F.lit(0))).alias("new_line"),
    ).where("added OR removed")

    def or_else(a: str, b: str) -> Column:
        missing = F.coalesce(F.col(a), F.lit("")).isin("", "/dev/null")
        return F.when(missing, F.col(b)).otherwise(F.col(a))

    return counted.select(
        "patch_id",
        F.when(F.col("added"), or_else("new_path", "old_path")).otherwise(or_else("old_path", "new_path")).alias("path"),
        F.when(F.col("added"), "new").otherwise("old").alias("side"),
        F.when(F.col("added"), F.col("new_line")).otherwise(F.col("old_line")).cast("int").alias("line"),
    ).where(~F.coalesce("path", F.lit("")).isin("", "/dev/null"))


def enclosing_functions(lines: DataFrame, spans: DataFrame) -> DataFrame:
    """Changed lines inside function spans of the same file and side.

    The range condition is joined on line buckets as well, so one huge file
    spreads over many keys and no line meets every span of its file.  Both sides are
    shuffled: sizes guessed from well-packed files would send all spans through the driver.
    """
    bucketed = lines.withColumn("__bucket", F.floor(F.col("line") / BUCKET_LINES))
    crossing = F.sequence(F.floor(F.col("start_line") / BUCKET_LINES), F.floor(F.col("end_line") / BUCKET_LINES))
    split = spans.where(F.col("start_line") <= F.col("end_line")).withColumn("__bucket", F.explode(crossing))
    inside = F.col("line").between(F.col("start_line"), F.col("end_line"))
    return bucketed.join(split.hint("merge"), ["patch_id", "path", "side", "__bucket"]).where(inside).drop("__bucket")


def touched_functions(lines: DataFrame, spans: DataFrame, fixes: DataFrame) -> DataFrame:
    """Distinct functions per fixed CVE, as rows; `fixes` has cve and patch_id."""
    return enclosing_functions(lines, spans).select("patch_id", "function").distinct().join(
        fixes.hint("merge"), "patch_id").select("cve", "function").distinct()
