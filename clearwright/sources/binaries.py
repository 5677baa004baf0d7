"""File inventory of extracted artifacts, and facts of binaries from their parsed sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clearwright.functions import symbols as S
from clearwright.operators.tables import materialize

_SYMBOLS = "array<struct<name: string, bind: int, kind: int, defined: boolean, version: string>>"
# One row per binary as a section parser gives it; `warning` is set where parsing failed.
SECTIONS = (f"path string, sha256 string, machine int, has_symtab boolean, has_interp boolean, needed array<string>, note binary, "
            f"rodata binary, dyn_syms {_SYMBOLS}, symtab {_SYMBOLS}, warning string")

# ELF machine numbers, symbol bindings and symbol kinds by name.
MACHINES = {62: "amd64", 3: "386", 183: "arm64", 40: "arm", 21: "ppc64", 22: "s390x", 243: "riscv"}
BINDINGS = {0: "LOCAL", 1: "GLOBAL", 2: "WEAK"}
KINDS = {0: "NOTYPE", 1: "OBJECT", 2: "FUNC", 3: "SECTION", 4: "FILE", 5: "COMMON", 6: "TLS", 10: "IFUNC"}


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """Files under `root` with their whole content; a file too large for one value fails the read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", "content")


def file_inventory(files: DataFrame) -> DataFrame:
    """Binaries among the files: path, size, format and SHA-256, from one pass over the content."""
    facts = files.select("path", "length", S.magic_format(F.col("content")).alias("format"), F.sha2("content", 256).alias("sha256"))
    return facts.where(F.col("format") != "unknown")


def binaries(files: DataFrame) -> DataFrame:
    """Files worth parsing."""
    return files.where(S.magic_format(F.col("content")) != "unknown")


def positions_by_path(inventories: DataFrame) -> DataFrame:
    """(artifact_id, path, position): place of each binary in its artifact, by lower-case path.

    Rows are range-sorted over all tasks and numbered inside a task; the counts of the tasks
    before it are added, so no artifact has to fit one task.
    """
    key = ["artifact_id", "folded", "path"]
    rows = inventories.select("artifact_id", F.lower("path").alias("folded"), "path")
    dealt = materialize(rows.repartitionByRange(*key).withColumn("task", F.spark_partition_id()))
    earlier = Window.partitionBy("artifact_id").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = dealt.groupBy("artifact_id", "task").agg(F.count(F.lit(1)).alias("n")).select(
        "artifact_id", "task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("artifact_id", "task").orderBy("folded", "path"))
    return dealt.withColumn("place", place).join(before, ["artifact_id", "task"]).select(
        "artifact_id", "path", (F.col("place") + F.col("before")).cast("int").alias("position"))


def inventory_facts(sections: DataFrame) -> DataFrame:
    """Facts per binary; one that could not be parsed keeps its warning, and nothing is claimed about it."""
    parsed = F.col("warning").isNull()
    arch = F.try_element_at(F.create_map(*[F.lit(x) for kv in MACHINES.items() for x in kv]), F.col("machine"))
    return sections.select(
        "path", "sha256", F.lit("ELF").alias("format"),
        F.when(parsed, F.coalesce(arch, F.col("machine").cast("string"))).alias("arch"),
        F.when(parsed, S.gnu_build_id(F.col("note"))).alias("build_id"),
        F.when(parsed, ~F.col("has_symtab")).alias("stripped"), F.when(parsed, F.array_sort("needed")).alias("needed"),
        F.when(parsed, ~F.col("has_interp") & (F.size("needed") == 0)).alias("static_linked"),
        _symbols("dyn_syms"), _symbols("symtab"), "warning")


def string_rows(sections: DataFrame) -> DataFrame:
    """(path, position, value): every distinct read-only string of a binary, at its first place."""
    strings = F.array_distinct(S.printable_runs(F.col("rodata")))
    return sections.select("path", F.posexplode(strings).alias("position", "value"))


def _symbols(column: str):
    kinds = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    binds = F.create_map(*[F.lit(x) for kv in BINDINGS.items() for x in kv])

    def one(s):
        split = S.split_version(s["name"], s["version"])
        return F.struct(
            S.normalize(split["name"]).alias("normalized"), split["name"].alias("raw"), split["version"].alias("version"),
            F.coalesce(F.try_element_at(binds, s["bind"]), F.concat(F.lit("BIND_"), s["bind"].cast("string"))).alias("bind"),
            F.coalesce(F.try_element_at(kinds, s["kind"]), F.concat(F.lit("TYPE_"), s["kind"].cast("string"))).alias("type"),
            s["defined"].alias("defined"))

    named = F.filter(column, lambda s: F.coalesce(s["name"], F.lit("")) != "")
    return F.array_sort(F.transform(named, one)).alias(column)
