"""Cutting lineage on storage that survives the loss of executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder the session names in ``spark.checkpoint.dir``.

    Only a local session that names none gets a temporary one.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if folder is None:
        # Executors of a local cluster are processes of their own, as on any cluster.
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        folder = tempfile.mkdtemp(prefix="recall-checkpoint-")
        context.setCheckpointDir(folder)
    return folder


#: Folders that this process has named, for :func:`clear`.
_named: list[str] = []


def scratch_folder(spark: SparkSession) -> str:
    """A new folder name below the shared folder."""
    folder = f"{shared_folder(spark).rstrip('/')}/recall-{uuid.uuid4()}"
    _named.append(folder)
    return folder


#: Folders of intermediate tables that are still in use, for :func:`discard`.
_folders: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clear(spark: SparkSession) -> None:
    """Delete all intermediate tables of this process; call it when the results that read them are written."""
    while _named:
        _delete(spark, _named.pop())


def kept_in(table: DataFrame, folder: str) -> DataFrame:
    """Note which scratch folder an intermediate table lies in, for :func:`discard`."""
    _folders[table] = folder
    return table


def discard(*tables: DataFrame) -> None:
    """Delete intermediate tables that nothing reads any more, as :func:`durable` gave them."""
    for table in tables:
        folder = _folders.pop(table, None)
        if folder in _named:
            _named.remove(folder)
            _delete(table.sparkSession, folder)


#: Whether Spark deletes the shuffles of a query when it ends, not when the driver's JVM next collects them.
SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Writes within leave no shuffles behind: what they wrote is read from its files, never computed again."""
    before = spark.conf.get(SHUFFLES, "false")
    spark.conf.set(SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLES, before)


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it from there from now on.

    As a Parquet table it keeps column pruning, and its size is known to the
    planner, which picks join strategies by it.
    """
    spark = df.sparkSession
    folder = scratch_folder(spark)
    with shuffles_dropped(spark):
        df.write.option("compression", "zstd").parquet(folder)
    return kept_in(spark.read.schema(df.schema).parquet(folder), folder)
