"""Storing and loading an index."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from srcatlas.schemas import CHUNKS, INDEX_JSON
from srcatlas.session import durable, exists, scratch
from srcatlas.sources.fs import add_file
from srcatlas.sources.json_array import RANGE_BYTES, array_objects


def write_index(index: DataFrame, path: str, partition_by: Sequence[str] = (), clustered: bool = False) -> None:
    """Write an index as Parquet.

    By default rows are written where they are, without a shuffle.  ``clustered`` range-partitions by
    repository and file, so that row-group statistics prune a read of one repository; it holds with any
    number of repositories and splits a large one.  ``partition_by=("repo",)`` makes a directory per
    repository and suits a small, known number of them.
    """
    if clustered:
        index = index.repartitionByRange("repo", "file").sortWithinPartitions("repo", "file", "chunk_idx")
    index.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CHUNKS).parquet(path)


def write_index_json(index: DataFrame, path: str) -> None:
    """Export as JSON lines, one object per chunk."""
    index.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_index_json(spark: SparkSession, path: str, repo: str | None = None, array: bool = True, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Import a JSON index.

    ``array``: each file is one JSON array of ``file, content, embedding`` (no repository: ``repo`` names
    it, else the file's own path does; chunks keep their order per file), read by ranges of ``range_bytes``.  Otherwise JSON
    lines with all index columns.
    """
    if not array:
        return spark.read.schema(CHUNKS).json(path)
    found = array_objects(spark, path, range_bytes)
    rows = found.select(F.col("path") if repo is None else F.lit(repo).alias("path"), "at", F.col("path").alias("source"), F.from_json("json", INDEX_JSON).alias("o"))
    rows = rows.select(F.col("path").alias("repo"), "source", "at", "o.*")
    place = F.row_number().over(Window.partitionBy("repo", "file").orderBy("source", "at")) - 1
    return rows.select("repo", "file", place.cast("int").alias("chunk_idx"), "content", "embedding")


def write_index_array(index: DataFrame, path: str) -> None:
    """Export as one JSON array per part, in the exchange form (no repository, no number): a file is a text of its own.

    Range bounds are taken from a sample, which reads all rows once more; so the index, whose vectors are costly, is written first.
    """
    rows = index.select("repo", "file", "chunk_idx", F.to_json(F.struct("file", "content", "embedding")).alias("json"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [line for batch in batches for line in batch["json"].to_pylist()]
        if parts:
            add_file(f"{path.rstrip('/')}/{uuid.uuid4().hex}.json", ("[\n  " + ",\n  ".join(parts) + "\n]\n").encode())
        yield pa.RecordBatch.from_pydict({"n": [len(parts)]}, schema=pa.schema([("n", pa.int64())]))

    with scratch(index.sparkSession):
        ordered = durable(rows, "array-rows").repartitionByRange("repo", "file").sortWithinPartitions("repo", "file", "chunk_idx")
        ordered.select("json").mapInArrow(write, "n long").write.format("noop").mode("overwrite").save()


def index_exists(spark: SparkSession, path: str) -> bool:
    """Whether an index was written to its end: a job that died leaves no ``_SUCCESS``."""
    return exists(spark, f"{path.rstrip('/')}/_SUCCESS")


def load_or_build(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Read the index at ``path``; where there is none, or only what a build that died has left, write what ``build()`` returns first."""
    if not index_exists(spark, path):
        write_index(build(), path)
    return read_index(spark, path)
