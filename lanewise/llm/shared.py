"""Intermediate tables in the folder that the whole cluster shares."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []
_scopes: list[list[DataFrame]] = []


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables stored inside are removed at the end, but for those given to the function that this yields.

    Kept tables, which a result still reads, belong to the scope around it, if there is one.
    """
    made: list[DataFrame] = []

    def keep(df: DataFrame) -> DataFrame:
        made[:] = [x for x in made if x is not df]
        if outer:
            outer[-1].append(df)
        return df

    outer = list(_scopes[-1:])
    _scopes.append(made)
    try:
        yield keep
    finally:
        _scopes.pop()
        drop(*made)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a single-process ``local`` session may leave it unset; it gets a temporary folder that
    goes with the process. On any other master an unset folder is an error, since a machine's own
    disk is invisible to other executors.
    """
    set_to = spark.conf.get("spark.checkpoint.dir", None)
    if set_to:
        return set_to.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="lanewise-"))
        atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
    return "file://" + _local[0]


BATCH_ROWS = 1000
_BATCHES = "spark.sql.execution.arrow.maxRecordsPerBatch"


def for_python(df: DataFrame) -> DataFrame:
    """``df``, its session made ready for functions of this package.

    Arrow batches are held to BATCH_ROWS rows: whole texts travel in them, and some are long. Python
    workers look for the package where the driver found it; a cluster without that folder gets it by ``--py-files``.
    """
    environment = df.sparkSession.sparkContext.environment
    root = str(Path(__file__).resolve().parents[2])
    if root not in environment.get("PYTHONPATH", "").split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, (environment.get("PYTHONPATH"), root)))
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(_BATCHES, "10000")) <= BATCH_ROWS:
        conf.set(_BATCHES, str(BATCH_ROWS))
    return df


def tasks_for(spark: SparkSession, n_bytes: int) -> int:
    """Tasks for ``n_bytes`` of rows that are compared with each other: as many as keep the cores busy, and more as the bytes grow."""
    return max(4 * spark.sparkContext.defaultParallelism, min(n_bytes >> 23, 50_000), n_bytes >> 29)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, files_a_core: int = 0) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts lineage, survives lost executors.

    ``files_a_core`` bounds the files of a table that a shuffle would leave in many small ones: 1 for what stays small, 4 for
    ids, counts and links that grow with the input, 0 for no bound, as whole texts and sets need. Its partitions are run through one after the other, never held together.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    (df.coalesce(files_a_core * spark.sparkContext.defaultParallelism) if files_a_core else df).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    if _scopes:
        _scopes[-1].append(out)
    return out


def _at(spark: SparkSession, path: str):
    """A Hadoop path and its file system."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath, jpath.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    jpath, system = _at(spark, path)
    return system.exists(jpath)


def rename(spark: SparkSession, old: str, new: str) -> None:
    """Give a finished folder its lasting name, unless another session was first."""
    if not exists(spark, new):
        source, system = _at(spark, old)
        system.rename(source, _at(spark, new)[0])


def drop(*frames: DataFrame) -> None:
    """Remove tables made by ``stored`` that nothing reads any more."""
    for df in frames:
        if path := getattr(df, "_stored_at", None):
            jpath, system = _at(df.sparkSession, path)
            system.delete(jpath, True)
