"""Continuous re-indexing: a stream of file versions in, an index of the newest versions out.

Each micro-batch appends its own folder of chunks and of file versions; nothing is rewritten.  A folder is
named by the batch id and overwritten as a whole, so a batch that runs twice leaves one copy.  Readers keep
the newest version of every file; ``compact`` does so for good, in place or elsewhere.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from srcatlas.functions.tables import CHUNK_BYTES
from srcatlas.operators.embed import Embedder
from srcatlas.plans.indexing import index_files, refresh_table
from srcatlas.schemas import CHUNKS
from srcatlas.session import durable, names_in, remove, scratch
from srcatlas.sources.code_tree import Roots, read_files, stream_code_files
from srcatlas.sources.index_table import IndexTable

_VERSIONS = "repo string, file string, mtime timestamp, deleted boolean, batch bigint"
_CHUNKS = T.StructType([*CHUNKS.fields, T.StructField("batch", T.LongType())])


def _newest(versions: DataFrame) -> DataFrame:
    """``repo, file, batch`` of the newest version of every file that is not deleted: latest ``mtime``, then batch."""
    last = versions.groupBy("repo", "file").agg(F.max(F.struct("mtime", "batch", "deleted")).alias("_last"))
    return last.where(~F.col("_last.deleted")).select("repo", "file", F.col("_last.batch").alias("batch"))


def index_batch(files: DataFrame, batch: int, target: str, embedder: Embedder | None, max_bytes: int) -> None:
    """Index the newest version of each file in a batch.  A row without content marks a deleted file.

    Of versions with the same ``mtime`` a deletion comes last, then the greatest content.  The batch's contents are
    written to the shared folder while it runs; chunks come before versions, and a chunk counts once its version does.
    """
    spark = files.sparkSession
    newest = F.max(F.struct("mtime", F.col("content").isNull().alias("deleted"), "content"))
    with scratch(spark):
        rows = durable(files.groupBy("repo", "path").agg(newest.alias("_v")).select("repo", "path", "_v.*"), "batch")
        chunks = index_files(rows.where(~F.col("deleted")).drop("deleted"), embedder, max_bytes)
        chunks.write.mode("overwrite").parquet(f"{target}/chunks/batch={batch}")
        versions = rows.select("repo", F.col("path").alias("file"), "mtime", "deleted")
        versions.write.mode("overwrite").parquet(f"{target}/versions/batch={batch}")


def start_reindex(
    stream: DataFrame,
    target: str,
    checkpoint: str,
    embedder: Embedder | None = None,
    max_bytes: int = CHUNK_BYTES,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Start re-indexing ``stream`` (``repo, path, mtime, content``) into ``target``."""

    def each(files: DataFrame, batch: int) -> None:
        index_batch(files, batch, target, embedder, max_bytes)

    return (
        stream.writeStream.foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def current_index(spark: SparkSession, target: str, since: Column | None = None) -> DataFrame:
    """The index as it stands: chunks of the newest version of every file, of versions that are written to the end.

    ``since``: versions with an earlier ``mtime`` have expired and are left out.
    """
    versions = spark.read.schema(_VERSIONS).parquet(f"{target}/versions")
    newest = _newest(versions if since is None else versions.where(F.col("mtime") >= since))
    chunks = spark.read.schema(_CHUNKS).parquet(f"{target}/chunks")
    return chunks.join(newest, ["repo", "file", "batch"], "left_semi").drop("batch")


def compact(spark: SparkSession, target: str, out: str | None = None, since: Column | None = None) -> None:
    """Keep the newest versions only (and with ``since`` no expired ones): as an index at ``out``, or in place.

    In place, they are written as one batch of their own with a number below all others, deletions included; then the
    batches it replaces are removed, versions first.  At every moment a reader finds each file's newest version either
    in its old batch or in the new one, and batches that a running stream adds meanwhile are not touched.
    """
    if out is not None:
        current_index(spark, target, since).write.mode("overwrite").parquet(out)
        return
    versions = spark.read.schema(_VERSIONS).parquet(f"{target}/versions")
    ends = versions.agg(F.min("batch").alias("first"), F.max("batch").alias("last")).first()
    last_batch, merged = ends.last if ends.last is not None else -1, min(0, ends.first or 0) - 1
    old = versions.where(F.col("batch") <= last_batch)
    kept = old if since is None else old.where(F.col("mtime") >= since)
    last = kept.groupBy("repo", "file").agg(F.max(F.struct("mtime", "batch", "deleted")).alias("_v"))
    last = durable(last.select("repo", "file", "_v.*"), "newest")
    chunks = spark.read.schema(_CHUNKS).parquet(f"{target}/chunks").where(F.col("batch") <= last_batch)
    chunks = chunks.join(last.where(~F.col("deleted")), ["repo", "file", "batch"], "left_semi").drop("batch")
    chunks.write.mode("overwrite").parquet(f"{target}/chunks/batch={merged}")
    last.drop("batch").write.mode("overwrite").parquet(f"{target}/versions/batch={merged}")
    for kind in ("versions", "chunks"):
        for name in names_in(spark, f"{target}/{kind}"):
            if name.startswith("batch=") and merged < int(name.removeprefix("batch=")) <= last_batch:
                remove(spark, f"{target}/{kind}/{name}")


def watch_tree(
    spark: SparkSession,
    roots: Roots,
    table: IndexTable,
    checkpoint: str,
    ttl: Column,
    embedder: Embedder | None = None,
    max_bytes: int = CHUNK_BYTES,
    names: Sequence[str] = (),
    trigger: dict | None = None,
) -> StreamingQuery:
    """Keep an index with snapshots up to date with directory trees: files added, changed and removed between two triggers.

    Every micro-batch lists the trees, compares the listing with the table's state and reads changed files only; a batch that
    runs again finds what it had done already.  Directories that cannot be listed keep their files.
    """

    def each(listing: DataFrame, batch: int) -> None:
        with scratch(spark):
            now = F.lit(dt.datetime.now(dt.timezone.utc))
            refresh_table(table, durable(listing, "listing"), now, ttl, embedder, max_bytes, read_files)

    return (
        stream_code_files(spark, roots, names)
        .writeStream.foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
