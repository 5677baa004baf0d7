"""Shards: counts, slots, mixture, and the same result for any partitioning."""

import zlib
from collections import Counter

from pyspark.sql import functions as F
from tables import SF, documents, empty, rows

from clearwright.llm import sharding


def check(placed, data, shards):
    assert len(placed) == len(data)
    want = Counter((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in data)
    assert Counter((str(r.doc_id), r["size"], r.text_crc32) for r in placed) == want
    counts = Counter(r.shard for r in placed)
    assert set(counts) <= set(range(shards))
    sizes = [counts[s] for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    for s in range(shards):
        assert sorted(r.slot for r in placed if r.shard == s) == list(range(counts[s]))


def test_small(spark):
    for shards in (1, 4, 16, 200):
        check(sharding.interleave(documents(spark), shards).collect(), rows(), shards)


def test_mixture_and_order(spark):
    data = [(i, f"text {i}") for i in range(3000)]
    docs = documents(spark, data, clash=False)
    docs = docs.selectExpr("doc_id", "text", "lang", "if(doc_id % 3 = 0, 'hot', if(doc_id % 10 = 1, null, concat('s', doc_id % 7))) AS source", "n_chars")
    placed = sharding.interleave(docs, 16, slices=64).collect()
    check(placed, data, 16)
    source = {r.doc_id: r.source for r in docs.collect()}
    for s, n in Counter(source.values()).items():
        each = Counter(r.shard for r in placed if source[r.doc_id] == s)
        assert all(abs(each[k] - n / 16) <= 2 for k in range(16)), (s, each)
    again = sharding.interleave(docs.repartition(7), 16, slices=64).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in again} == {(r.doc_id, r.shard, r.slot) for r in placed}
    other = sharding.interleave(docs, 16, seed=8).collect()
    assert {(r.doc_id, r.shard) for r in other} != {(r.doc_id, r.shard) for r in placed}


def test_empty_table(spark):
    assert sharding.interleave(empty(documents(spark))).collect() == []


def test_written_shards(spark, tmp_path):
    docs = documents(spark, [(i, f"text {i}") for i in range(50)])
    sharding.write_shards(docs, str(tmp_path / "s"), 4)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert sorted(r.doc_id for r in back.collect()) == list(range(50))
    assert set(docs.columns) | {"shard", "slot"} == set(back.columns)


def test_a_row_that_repeats_a_hundred_thousand_times(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS_PER_SLICE", 1000)
    hot = spark.range(100_000).selectExpr("7L AS doc_id", "'the same text' AS text", "'a' AS source", "'x' AS shard", "1 AS size", "2 AS text_crc32", "3 AS repeat", "'r' AS row")
    rest = spark.range(5_000).selectExpr("id AS doc_id", "concat('text ', id) AS text", "if(id % 2 = 0, 'a', null) AS source", "'x' AS shard", "1 AS size", "2 AS text_crc32", "3 AS repeat", "'r' AS row")
    docs = hot.unionByName(rest)
    placed = sharding.interleave(docs, 16)
    counts = {r.shard: (r.n, r.slots, r.most, r.hot) for r in placed.groupBy("shard").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("slot").alias("slots"), F.max("slot").alias("most"), F.count_if(F.col("doc_id") == 7).alias("hot")).collect()}
    assert len(counts) == 16 and max(c[0] for c in counts.values()) - min(c[0] for c in counts.values()) <= 1
    assert all(c[1] == c[0] == c[2] + 1 for c in counts.values())
    assert max(c[3] for c in counts.values()) - min(c[3] for c in counts.values()) < 60
    sharding.write_shards(docs, str(tmp_path / "s"), 16)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert set(back.columns) == set(docs.columns) | {"slot"}
    files = {r.shard: (r.n, r.slots) for r in back.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("slot").alias("slots")).collect()}
    assert files == {k: (c[0], c[1]) for k, c in counts.items()}


def test_query(spark):
    from clearwright.llm.queries import QUERIES

    data = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = QUERIES["op10_interleaved_shards"](spark, SF)
    assert got.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    check(got.collect(), data, 16)
