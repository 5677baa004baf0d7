"""Order-independent content digests of groups of any size.

One sequential hash over a whole group would pin the group to one task, so the
digest is a tree: lines are hashed, leaf digests are grouped by prefix, and each
level hashes its sorted children.  Equal sets of lines give equal digests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Hex digits of the leaf digest that name a node on each level, finest first.
# Six digits spread a group over 16.7 million nodes.
LEVELS = (6, 3, 0)


def directory_line(path: Column, sha256: Column) -> Column:
    return F.concat(path, F.lit("\u0000"), sha256, F.lit("\u0000"))


def artifact_line(path: Column, sha256: Column) -> Column:
    return F.concat(path, F.lit("\n"), sha256, F.lit("\n"))


def manifest_line(path: Column, body: Column) -> Column:
    return F.concat(path, F.lit("\n"), body, F.lit("\u0000"))


def bundle_line(path: Column, sha256: Column) -> Column:
    return F.concat(sha256, F.lit("  "), path, F.lit("\n"))


# The four line layouts in use.
LINE_FORMATS = {
    "directory": directory_line,
    "artifact": artifact_line,
    "manifest": manifest_line,
    "bundle": bundle_line,
}


def content_digest(df: DataFrame, keys: list[str], line: Column, out: str = "digest") -> DataFrame:
    """One digest per `keys` over the distinct lines of the group."""
    leaf, node = f"__{out}_leaf", f"__{out}_node"
    level = df.select(*keys, F.sha2(line, 256).alias(leaf)).distinct().withColumn(node, F.col(leaf))
    for digits in LEVELS:
        level = (
            level.withColumn(node, F.left(F.col(node), F.lit(digits)))
            .groupBy(*keys, node)
            .agg(F.sha2(F.array_join(F.array_sort(F.collect_list(leaf)), ""), 256).alias(leaf))
        )
    return level.select(*keys, F.col(leaf).alias(out))
