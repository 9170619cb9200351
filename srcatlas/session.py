"""Session helpers: the shared folder and durable cuts of lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach.

    A cluster names it in ``spark.checkpoint.dir``.  Only where that is unset in a local run (a test) a
    temporary folder is made and set on the session, so later calls share it; on a cluster that would scatter
    tables over machines, so it is an error.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="srcatlas-"))
        folder = context.getCheckpointDir()
    return folder


def new_shared_path(spark: SparkSession, label: str) -> str:
    """A path nobody used before, inside the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def durable(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage in a way that outlives lost executors, and fixes values that a second evaluation
    may compute differently (such as partition numbers after a range shuffle).
    """
    path = new_shared_path(df.sparkSession, label)
    for held in _scratch:
        held.append(path)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_scratch: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Remove the tables that ``durable`` writes inside the block, at its end.

    For a job that ends with a write: ``with scratch(spark): write_index(index_files(files, embedder), path)``.
    A DataFrame that is still to be read later must not come out of the block.
    """
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            remove(spark, path)


def _place(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def remove(spark: SparkSession, path: str) -> None:
    """Remove a file or folder on any file system that Spark knows."""
    system, place = _place(spark, path)
    system.delete(place, True)


def exists(spark: SparkSession, path: str) -> bool:
    system, place = _place(spark, path)
    return system.exists(place)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of a folder's entries; none where it does not exist."""
    system, place = _place(spark, path)
    return sorted(entry.getPath().getName() for entry in system.listStatus(place)) if system.exists(place) else []


def move(spark: SparkSession, path: str, to: str) -> bool:
    """Move a folder to a name that nobody has, at once; False where the file system refuses."""
    system, place = _place(spark, path)
    return not exists(spark, to) and system.rename(place, _place(spark, to)[1])


#: Bytes that Python gets at a time; rows alone (10,000) say nothing about memory where texts are long.
BATCH_BYTES = 8 << 20
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Bound the batches that Python gets by ``BATCH_BYTES``, unless the session has a bound of its own."""
    if spark.conf.get(_BATCH_BYTES, None) is None:
        spark.conf.set(_BATCH_BYTES, str(BATCH_BYTES))


def spread(df: DataFrame) -> DataFrame:
    """Spread a table that comes in fewer splits than there are cores; leave any other where it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
