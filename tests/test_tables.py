"""Tables that are built once."""

import os
import uuid

from pyspark.sql import functions as F

from clearwright.operators import tables as T


def jobs(spark, action):
    context, group = spark.sparkContext, uuid.uuid4().hex
    context.setJobGroup(group, group)
    try:
        result = action()
        return result, len(context.statusTracker().getJobIdsForGroup(group))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)


def test_second_call_builds_and_starts_nothing(spark, tmp_path):
    path, calls = str(tmp_path / "in"), []
    spark.range(10).write.parquet(path)

    def build():
        calls.append(1)
        return spark.read.parquet(path).select((F.col("id") * 2).alias("twice"))

    first, started = jobs(spark, lambda: T.once(spark, "twice", [path], build))
    assert started > 0 and sorted(r.twice for r in first.collect()) == list(range(0, 20, 2))
    again, started = jobs(spark, lambda: T.once(spark, "twice", [path], build))
    assert again is first and started == 0 and len(calls) == 1
    T._DONE.clear()  # as another application would find it
    assert T.once(spark, "twice", [path], build).count() == 10 and len(calls) == 1


def test_rewritten_input_is_noticed(spark, tmp_path):
    path = str(tmp_path / "in")

    def table():
        return sorted(r.id for r in T.once(spark, "copy", [path], lambda: spark.read.parquet(path)).collect())

    spark.range(3).coalesce(1).write.parquet(path)
    assert table() == [0, 1, 2]
    spark.range(5, 8).coalesce(1).write.mode("overwrite").parquet(path)
    assert table() == [5, 6, 7]


def test_names_and_missing_inputs_are_apart(spark, tmp_path):
    a = T.once(spark, "a", [str(tmp_path / "none")], lambda: spark.range(1))
    b = T.once(spark, "b", [str(tmp_path / "none")], lambda: spark.range(2))
    assert (a.count(), b.count()) == (1, 2)


def shuffle_files(spark):
    return spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ").count("shuffle_")


def test_shuffles_and_scratch_tables_go_with_the_build(spark, tmp_path):
    """Nothing but the table itself keeps disk, however long the driver's memory is not collected."""
    before, inside = shuffle_files(spark), []

    def build():
        some = T.stored(spark.range(1000).repartition(3, "id"))
        with T.scratch(spark):
            gone, kept = T.stored(some.where("id < 10")), T.stored(some.groupBy("id").count(), beyond=True)
        inside.extend(x.inputFiles()[0].removeprefix("file:").rpartition("/")[0] for x in (some, gone, kept))
        assert [os.path.exists(x) for x in inside] == [True, False, True]
        return kept.join(some.hint("merge"), "id")

    left = T.once(spark, "left", [str(tmp_path / "none")], build)
    assert shuffle_files(spark) <= before
    assert left.count() == 1000 and not any(map(os.path.exists, inside))
