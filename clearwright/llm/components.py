"""Connected components of a distributed edge list by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clearwright.llm.common import written


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("hi", "lo"))).first())


def _to_minimum(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("hi").alias("at")).agg(F.min("lo").alias("least"))


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): component is the smallest node that links reach; nodes without a link are absent.

    `a` and `b` are integer columns; loops and rows with a null are ignored, repeated edges count once.
    A round hangs every node below the smallest neighbour known so far (large star on the lower
    end, small star on the upper end), so paths shrink geometrically.  Each round is written to the
    shared folder and only two numbers reach the driver.  A hub is a hot join key of one join side
    with a unique other side, which adaptive execution splits; minima are pre-aggregated.
    """
    x, y = F.col(a), F.col(b)
    edges = written(edges.filter(x != y).select(F.greatest(x, y).alias("hi"), F.least(x, y).alias("lo")).distinct(), "edges")
    mark = _mark(edges)
    while mark[0]:
        low = _to_minimum(edges)
        large = written(
            edges.join(low, edges.lo == low.at, "left")
            .select("hi", F.least("lo", "least").alias("lo")).distinct(), "edges")
        low = _to_minimum(large)
        joined = large.join(low, large.hi == low.at)
        edges = written(
            joined.select(F.explode(F.array(F.struct(F.col("hi"), F.col("least").alias("lo")),
                                            F.struct(F.col("lo").alias("hi"), F.col("least").alias("lo")))).alias("e"))
            .select("e.hi", "e.lo").filter("hi != lo").distinct(), "edges")
        before, mark = mark, _mark(edges)
        if mark == before:
            break
    return (
        edges.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
        .unionByName(edges.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
    )
