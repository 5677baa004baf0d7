"""Seeded, replayable sampling of decisions with quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEY = ("artifact_id", "cve", "component_purl")


def shuffle_key(seed: int, *key: str) -> Column:
    """Order of a seeded shuffle: a digest of seed and key, equal on every engine and run."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k) for k in key]))


def pick(pool: DataFrame, n: int, seed: int) -> DataFrame:
    """`n` rows of the pool in seeded order; a top-n sort, so no full shuffle."""
    return pool.orderBy(shuffle_key(seed, *KEY), *KEY).limit(n)


def round_robin(pool: DataFrame, group: str, n: int, seed: int) -> DataFrame:
    """Rows taken in turns across groups until `n` are taken.

    No group can give more than `n` rows, so the rank filter lets Spark keep only
    the first `n` of each group per task before it shuffles.
    """
    order = W.partitionBy(group).orderBy(shuffle_key(seed, *KEY), *KEY)
    ranked = pool.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= n)
    return ranked.orderBy("turn", group).limit(n)


def stratified_sample(rows: DataFrame, seed: int, size: int = 100, firmware: int = 40,
                      cleared: int = 20, refusals: int = 20, strict: bool = True) -> DataFrame:
    """Quotas first (firmware, cleared, refusals over reasons), the rest at random.

    `rows` has KEY, class, kind and reason_code, one row per KEY.  The samples
    are at most `size` rows, so counting them on the driver is safe.  A quota that the
    rows cannot fill is an error; without `strict` all rows there are of it are taken, and the rest fills up.
    """
    def enough(found: DataFrame, n: int, what: str) -> None:
        if strict and found.count() < n:
            raise ValueError(f"stratification failed: too few {what}")

    def rest(pool: DataFrame, taken: DataFrame) -> DataFrame:
        return pool.join(F.broadcast(taken.select(*KEY)), list(KEY), "left_anti")

    def have(taken: DataFrame, kind: str) -> int:
        return taken.where(F.col("kind") == kind).count()

    def fixed(df: DataFrame) -> DataFrame:
        return df.sparkSession.createDataFrame(df.collect(), df.schema)

    taken = fixed(pick(rows.where(F.col("class") == "firmware"), firmware, seed))
    enough(taken, firmware, "firmware rows")
    need = max(0, cleared - have(taken, "not_affected"))
    more = fixed(pick(rest(rows.where(F.col("kind") == "not_affected"), taken), need, seed))
    enough(more, need, "cleared rows")
    taken = taken.unionByName(more)
    need = max(0, refusals - have(taken, "refusal"))
    turns = round_robin(rest(rows.where(F.col("kind") == "refusal"), taken), "reason_code", need, seed).drop("turn")
    more = fixed(turns)
    enough(more, need, "refusals")
    taken = taken.unionByName(more)
    remainder = fixed(pick(rest(rows, taken), max(0, size - taken.count()), seed))
    taken = taken.unionByName(remainder)
    enough(taken, size, "rows")
    return numbered(taken, "real-", seed)


def numbered(sampled: DataFrame, prefix: str, seed: int, width: int = 3) -> DataFrame:
    """Sequential ids in seeded order over a bounded sample."""
    n = F.row_number().over(W.orderBy(shuffle_key(seed + 1, *KEY), *KEY)).cast("string")
    pad = F.repeat(F.lit("0"), F.greatest(F.lit(0), width - F.length(n)))
    return sampled.withColumn("id", F.concat(F.lit(prefix), pad, n))


def strata_report(sampled: DataFrame) -> DataFrame:
    return sampled.agg(
        F.count(F.lit(1)).alias("sampled"), F.count_if(F.col("class") == "firmware").alias("firmware"),
        F.count_if(F.col("kind") == "not_affected").alias("not_affected"),
        F.count_if(F.col("kind") == "refusal").alias("refusals"),
        F.array_sort(F.collect_set("reason_code")).alias("reasons"),
    )
