"""Proportional stratified interleaving: every shard has the mixture of the whole.

Rows are shuffled by a seeded hash and ranked inside their source; row k of n has the fractional
rank (k - u) / n with a seeded offset u of the source in (0, 1].  Sorting by it spreads each source
evenly over the order, and cutting the order into equal counts gives shards whose counts differ by
at most one (law `rows`) and whose share of any source differs by about one row.

Neither rank needs a window over a whole source or table: rows are counted in hash slices, slice
counts are summed up, and only the rows of one slice are ordered together.  There are as many slices as keep about
ROWS_PER_SLICE rows in one.  Rows that repeat are numbered, in parts of a bounded size, and the number enters the hash, so a row that
makes up a third of the table is spread like any other third.

Cases: a null source is a source of its own; null texts have size 1; ties fall to (hash, doc_id,
digest, repeat); repeats of a row are interchangeable, and each gets a place of its own, in the files too; other columns are not
read by `interleave`; `write_shards` keeps them, and replaces columns named shard and slot; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clearwright.llm.common import text_digest, written

ROWS_PER_SLICE = 65_536
NUMBERED_TOGETHER = 4096
_UNIT = float(1 << 52)


_KEY = ["doc_id", "digest", "stratum"]


def _stratum(source: str):
    return F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit(""))


def _unit(*cols):
    """A hash of the columns in [0, 1)."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 12) / F.lit(_UNIT)


def numbered(rows: DataFrame, key: list[str], together: int = NUMBERED_TOGETHER) -> DataFrame:
    """`rows` with `repeat`: 0, 1, ... among rows of equal key, which are numbered in parts of at most `together` rows.

    `rows` must be stored, so that the parts stay as they are when a task is repeated.
    """
    dealt = rows.withColumn("part", F.floor(F.monotonically_increasing_id() / together))
    inside = Window.partitionBy(*key, "part").orderBy(F.lit(0))
    own = written(dealt.withColumn("place", F.row_number().over(inside) - 1), "shard-repeats")
    upto = Window.partitionBy(*key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = own.groupBy(*key, "part").agg(F.count(F.lit(1)).alias("n"))
    before = sums.withColumn("before", F.sum("n").over(upto)).filter("before is not null").select(
        *(F.col(k).alias(f"of_{k}") for k in key), F.col("part").alias("of_part"), "before")
    same = F.col("part") == F.col("of_part")
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"of_{k}"))
    repeat = (F.col("place") + F.coalesce("before", F.lit(0))).cast("long")
    return own.join(before, same, "left").select(*rows.columns, repeat.alias("repeat"))


def interleave(docs: DataFrame, shards: int = 16, seed: int = 7, slices: int | None = None, source: str = "source") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot), a row per row of `docs`; texts never leave the scan."""
    return _placed(docs, shards, seed, slices, source).select("doc_id", "size", "text_crc32", "shard", "slot")


def _placed(docs: DataFrame, shards: int, seed: int = 7, slices: int | None = None, source: str = "source") -> DataFrame:
    """(doc_id, digest, stratum, repeat, size, text_crc32, shard, slot)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id", text_digest().alias("digest"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        _stratum(source).alias("stratum"))
    rows = numbered(written(rows, "shard-given"), _KEY)
    rows = written(rows.withColumn("h", _unit(F.lit(seed), "doc_id", "digest", "repeat")), "shard-rows")
    slices = slices or max(64, -(-rows.count() // ROWS_PER_SLICE))
    rows = rows.withColumn("slice", (F.col("h") * slices).cast("int"))

    by_slice = rows.groupBy("stratum", "slice").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("stratum").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("stratum")
    offsets = by_slice.select(
        F.col("stratum").alias("s"), F.col("slice").alias("b"),
        F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"), F.sum("n").over(whole).alias("n"))
    inside = Window.partitionBy("stratum", "slice").orderBy("h", "doc_id", "digest", "repeat")
    ranked = (
        rows.withColumn("k", F.row_number().over(inside))
        .join(offsets, (F.col("stratum") == F.col("s")) & (F.col("slice") == F.col("b")))
        .withColumn("part", (F.col("before") + F.col("k") - F.lit(1.0) + _unit(F.lit(seed + 1), "stratum")) / F.col("n"))
        .withColumn("cell", F.least(F.lit(slices - 1), (F.col("part") * slices).cast("int")))
        .select(*_KEY, "repeat", "size", "text_crc32", "h", "part", "cell")
    )
    ranked = written(ranked, "shard-ranks")

    by_cell = ranked.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))  # at most `slices` rows
    upto = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_cell.select(F.col("cell").alias("c"), F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"),
                            F.sum("n").over(Window.partitionBy()).alias("total"))
    inside = Window.partitionBy("cell").orderBy("part", "h", "doc_id", "digest", "repeat")
    at = F.col("before") + F.col("k") - 1
    return (
        ranked.withColumn("k", F.row_number().over(inside)).join(starts, F.col("cell") == F.col("c"))
        .withColumn("at", at).withColumn("shard", F.expr(f"at * {shards} div total").cast("int"))
        .withColumn("slot", F.expr(f"at - (shard * total + {shards} - 1) div {shards}"))
        .select(*_KEY, "repeat", "size", "text_crc32", "shard", "slot")
    )


def write_shards(docs: DataFrame, folder: str, shards: int = 16, source: str = "source", **options) -> None:
    """`docs` with shard and slot, written to one folder per shard and ordered by slot inside its files."""
    placed = _placed(docs, shards, source=source, **options).select(*(F.col(k).alias(f"to_{k}") for k in (*_KEY, "repeat")), "shard", "slot")
    # A row travels as one column, so that no column of it can clash with ours.
    given = docs.select("doc_id", text_digest().alias("digest"), _stratum(source).alias("stratum"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    keyed = numbered(written(given, "shard-texts"), _KEY)
    same = F.col("repeat") == F.col("to_repeat")
    for k in _KEY:
        same = same & F.col(k).eqNullSafe(F.col(f"to_{k}"))
    kept = [F.col("row")[c].alias(c) for c in docs.columns if c not in ("shard", "slot")]
    (keyed.join(placed, same).select(*kept, "shard", "slot")
     .repartition("shard", (F.col("slot") / 1_000_000).cast("int")).sortWithinPartitions("shard", "slot")
     .write.partitionBy("shard").parquet(folder))
