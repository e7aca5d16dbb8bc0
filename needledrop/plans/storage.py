"""Intermediate tables in the shared folder: they cut lineage, survive lost executors and are read again with their schema."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from contextvars import ContextVar, copy_context

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_known: dict[tuple[str, str, str], DataFrame] = {}
#: The folder of the run that is open in this thread, and in those that it starts by ``together``.
_run: ContextVar[str | None] = ContextVar("run", default=None)
#: Rows that a counted side may have to be broadcast.
BROADCAST_ROWS = 100_000
#: Steps that run at the same time; their jobs share the executors.
SIDE_BY_SIDE = 8


def shared_dir(spark: SparkSession) -> str:
    """The open run's folder, else ``spark.checkpoint.dir``; where that is unset, one of our own, on a local master only."""
    if run := _run.get():
        return run
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="needledrop-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _path(spark: SparkSession, path: str):
    """A path and its file system, as Spark's readers see them."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """One folder for all that this thread writes inside, removed at the end: results that are read later must be saved before.

    Runs of several threads have folders of their own, and what is remembered of one (``once``) is forgotten with it.
    """
    folder = new_path(spark, "run")
    token = _run.set(folder)
    try:
        yield folder
    finally:
        _run.reset(token)
        for at in [k for k in _known if k[1] == folder]:
            del _known[at]
        remove(spark, folder)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder or file that this library has written."""
    at, fs = _path(spark, path)
    fs.delete(at, True)


def run_key(spark: SparkSession) -> tuple[str, str]:
    """What remembered results belong to: the application, and the run that is open ('': none)."""
    return spark.sparkContext.applicationId, _run.get() or ""


def new_path(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder that nothing is at."""
    return f"{shared_dir(spark)}/needledrop-{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str, *by: str, **options: str) -> DataFrame:
    """``df`` as a table in the shared folder, one folder for each value of the columns ``by``."""
    path = new_path(df.sparkSession, tag)
    df.write.partitionBy(*by).options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def together(spark: SparkSession, *steps: Callable) -> list:
    """What some independent steps return, run side by side: each is a chain of small tables that leaves most cores idle."""
    with ThreadPoolExecutor(SIDE_BY_SIDE) as pool:
        return [started.result() for started in [pool.submit(copy_context().run, inheritable_thread_target(spark)(s)) for s in steps]]


def stamp(spark: SparkSession, *paths: str) -> str:
    """The sizes and times of the files at some paths: another one if a table has changed."""
    found = []
    for p in paths:
        path, fs = _path(spark, p)
        files = fs.listFiles(path, True)
        while files.hasNext():
            f = files.next()
            found.append(f"{f.getPath().toString()}:{f.getLen()}:{f.getModificationTime()}")
    return ",".join(sorted(found))


def once(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table ``make`` gives, written the first time this application, or the run that is open, asks for ``name``.

    The caller puts into ``name`` what the table depends on (``stamp`` for files).
    """
    at = *run_key(spark), name
    if at not in _known:
        _known[at] = written(make(), "once")
    return _known[at]


def forget() -> None:
    """Make ``once`` compute anew from here on."""
    _known.clear()


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast of a written table if it has at most ``most`` rows; else leave the join to a shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
