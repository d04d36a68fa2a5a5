"""Tables written to the folder that driver and executors share: they cut lineage and survive lost executors.

A table made inside a scope (`scope()`, or a function under `tidy`) is deleted when the scope ends, unless the plan that
comes out of it reads the table; then it belongs to the scope around, if there is one. What is left when the driver ends
is deleted with the application's folder.
"""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`, or (local runs only) a temporary one, which
    goes when the driver ends. A master that isn't local has no business with a folder of the driver: an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    base = os.path.join(tempfile.gettempdir(), f"huescape-{spark.sparkContext.applicationId}")
    if not os.path.isdir(base):
        os.makedirs(base)
        atexit.register(shutil.rmtree, base, ignore_errors=True)
    return f"file://{base}"


_folders: set[str] = set()


def work_path(spark: SparkSession, name: str) -> str:
    """A path of its own for one table or set of files, in the application's folder, which goes when the driver ends."""
    folder = f"{shared_dir(spark)}/huescape-{spark.sparkContext.applicationId}"
    if folder not in _folders:
        _folders.add(folder)
        atexit.register(_at_exit, spark, folder)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def _at_exit(spark: SparkSession, folder: str) -> None:
    if SparkContext._gateway is not None:
        with contextlib.suppress(Exception):  # the JVM may have ended first
            discard(spark, folder)


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a table that nothing will read again."""
    jvm = SparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    conf = spark.sparkContext._jsc.hadoopConfiguration() if spark.sparkContext._jsc else jvm.org.apache.hadoop.conf.Configuration()
    p.getFileSystem(conf).delete(p, True)


def roots(df: DataFrame) -> set[str]:
    """Names (last parts of paths) of the folders that a plan reads."""
    leaves, found = df._jdf.queryExecution().analyzed().collectLeaves(), set()
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if leaf.getClass().getSimpleName() == "LogicalRelation" and leaf.relation().getClass().getSimpleName() == "HadoopFsRelation":
            paths = leaf.relation().location().rootPaths()
            found |= {paths.apply(j).getName() for j in range(paths.size())}
    return found


_scopes = threading.local()


def _made() -> list[list[Stored]]:
    if not hasattr(_scopes, "stack"):
        _scopes.stack = []
    return _scopes.stack


def carried(work: Callable) -> Callable:
    """work, to be run in another thread: what it writes belongs to this thread's scope."""
    stack = _made()

    @wraps(work)
    def run(*args, **kwargs):
        _scopes.stack = stack
        try:
            return work(*args, **kwargs)
        finally:
            _scopes.stack = []

    return run


class Scope:
    """Tables made since it began. keep(df): leave alone what df reads."""

    def __init__(self):
        self.names: set[str] = set()

    def keep(self, df: DataFrame) -> DataFrame:
        self.names |= roots(df)
        return df


@contextlib.contextmanager
def scope() -> Iterator[Scope]:
    mine, stack = Scope(), _made()
    stack.append([])
    try:
        yield mine
    finally:
        made = stack.pop()
        for t in made:
            if t.path.rsplit("/", 1)[1] not in mine.names:
                t.drop()
            elif stack:
                stack[-1].append(t)


def tidy(make: Callable) -> Callable:
    """make in a scope of its own; of the tables written on the way, those that its resulting DataFrame reads stay."""

    @wraps(make)
    def run(*args, **kwargs):
        with scope() as s:
            out = make(*args, **kwargs)
            return s.keep(out) if isinstance(out, DataFrame) else out

    return run


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


_writing, _lock, _before = 0, threading.Lock(), ""


@contextlib.contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Bounds what a Python worker is handed at once, as long as any table is being written."""
    global _writing, _before
    with _lock:
        if not _writing:
            _before = spark.conf.get(_BATCH)
            spark.conf.set(_BATCH, "8m")
        _writing += 1
    try:
        yield
    finally:
        with _lock:
            _writing -= 1
            if not _writing:
                spark.conf.set(_BATCH, _before)


class Stored:
    """A table written to the shared folder, and its path, to drop it before its scope ends."""

    def __init__(self, df: DataFrame, name: str, **options: str):
        self.spark, self.path = df.sparkSession, work_path(df.sparkSession, name)
        with _small_batches(self.spark):
            df.write.options(**options).parquet(self.path)
        self.df, self.dropped = self.spark.read.schema(df.schema).parquet(self.path), False
        if _made():
            _made()[-1].append(self)

    def drop(self) -> None:
        if not self.dropped:
            self.dropped = True
            discard(self.spark, self.path)


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    return Stored(df, name, **options).df
