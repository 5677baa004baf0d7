"""Tables that are computed once and read by several jobs."""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import cache
from importlib.resources import files

from pyspark.sql import DataFrame, SparkSession

_DONE: dict[tuple, DataFrame] = {}
# Folders of `stored` tables by the open `scratch` blocks, the innermost last.
_OPEN: ContextVar[tuple[list[str], ...]] = ContextVar("open", default=())
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _checkpoint_folder(spark: SparkSession) -> str:
    """The folder all executors share; a local session without one gets a folder of its own."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if folder is None and not context.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return (folder or context.getCheckpointDir()).rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write `df` to the session's checkpoint folder and read it from there.

    The folder is the cluster's `spark.checkpoint.dir`.  A local session without one gets a folder of its
    own; any other master is an error, as its executors could not read a driver's folder.
    """
    _checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def _written(df: DataFrame, folder: str) -> None:
    """Write `df` as Parquet; the shuffle files behind it are freed at once and not when the driver's memory is next collected."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(folder)
    finally:
        conf.unset(_CLEANUP) if before is None else conf.set(_CLEANUP, before)


def _place(spark: SparkSession, folder: str):
    """A folder's file system and path."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that `stored` writes within are deleted at the end: nothing may read them afterwards."""
    mine: list[str] = []
    token = _OPEN.set((*_OPEN.get(), mine))
    try:
        yield
    finally:
        _OPEN.reset(token)
        for folder in mine:
            fs, path = _place(spark, folder)
            fs.delete(path, True)


def stored(df: DataFrame, beyond: bool = False) -> DataFrame:
    """As `materialize`, for tables that grow with the findings: packed columns, one run of the plan, and no shuffle files left.

    The table lives as long as the innermost `scratch`, with `beyond` as long as the one around that, and outside of any as
    long as the application.
    """
    spark = df.sparkSession
    folder = f"{_checkpoint_folder(spark)}/scratch/{uuid.uuid4().hex}"
    around = _OPEN.get()[:-1] if beyond else _OPEN.get()
    if around:
        around[-1].append(folder)
    else:
        fs, path = _place(spark, folder)
        fs.deleteOnExit(path)
    _written(df, folder)
    return spark.read.schema(df.schema).parquet(folder)


@cache
def _code_version() -> str:
    """A digest of the library's sources, so that tables of older code are not read."""
    digest = hashlib.sha256()

    def add(folder) -> None:
        for entry in sorted(folder.iterdir(), key=lambda e: e.name):
            if entry.name.endswith(".py"):
                digest.update(entry.name.encode() + b"\0" + entry.read_bytes())
            elif entry.is_dir() and entry.name in ("functions", "operators", "plans", "sources"):
                add(entry)

    add(files("clearwright"))
    return digest.hexdigest()


def listing(spark: SparkSession, paths: Iterable[str]) -> list[tuple[str, int, int]]:
    """(path, length, time) of every file below the paths; no job is started."""
    found = []
    for text in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(text)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(path):
            each = fs.listFiles(path, True)
            while each.hasNext():
                f = each.next()
                found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return sorted(found)


def once(spark: SparkSession, name: str, inputs: Iterable[str], build: Callable[[], DataFrame]) -> DataFrame:
    """The stored table `name`, built only where its input files, or the library's code, are new.

    The key is the listing of the input files (path, length, time) and the code version, and it is looked up before
    anything is built: first in this application, then in `spark.checkpoint.dir`, where other applications find the table
    too.  A table is written beside its place and renamed, so readers see all of it or nothing.
    """
    key = hashlib.sha256(json.dumps([name, _code_version(), listing(spark, inputs)]).encode()).hexdigest()
    own = (spark.sparkContext.applicationId, key)
    if own not in _DONE:
        folder = f"{_checkpoint_folder(spark)}/tables/{name}-{key}"
        fs, place = _place(spark, folder)
        if not fs.exists(place):
            beside = f"{folder}.{uuid.uuid4().hex}"
            with scratch(spark):
                _written(build(), beside)
            if fs.exists(place) or not fs.rename(spark._jvm.org.apache.hadoop.fs.Path(beside), place):
                folder = beside  # another application was first; both tables hold the same rows
        _DONE[own] = spark.read.parquet(folder)
    return _DONE[own]
