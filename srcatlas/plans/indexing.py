"""The indexing job: files in, chunks with vectors out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcatlas.functions.hashed_bag import hashed_bag
from srcatlas.functions.tables import CHUNK_BYTES, ERRORS_SHOWN
from srcatlas.functions.text import embeddable, normalize
from srcatlas.operators.chunk import paragraph_chunks, with_paragraph_chunks
from srcatlas.operators.definitions import semantic_chunks
from srcatlas.operators.embed import Embedder, attach_vectors, digest, distinct_texts, embed_texts
from srcatlas.operators.incremental import changed_files
from srcatlas.session import bounded_batches, durable
from srcatlas.sources.index_table import IndexTable

NO_VALID_TEXT = "no valid texts to embed"
NOT_EMBEDDED = "failed to get embeddings"


def with_vectors(chunks: DataFrame, embedder: Embedder | None = None) -> DataFrame:
    """Chunks with ``embedding``; those that get none are dropped.

    The built-in embedder is a function of the row: no shuffle.  A user's embedder is assumed to be costly,
    so it sees each distinct text once.  Chunks, texts and vectors are written to the shared folder: chunking runs
    once, and a lost executor does not make the embedder run again for what is done.
    """
    if embedder is None:
        bounded_batches(chunks.sparkSession)
        valid = chunks.where(embeddable(F.col("content")))
        return valid.withColumn("embedding", hashed_bag(normalize(F.col("content"))))
    chunks = durable(chunks, "chunks")
    texts = durable(distinct_texts(chunks), "texts")
    vectors = durable(embed_texts(texts, embedder).select(digest(F.col("text")).alias("digest"), "embedding"), "vectors")
    return attach_vectors(chunks, vectors, texts)


def index_files(files: DataFrame, embedder: Embedder | None = None, max_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``repo, file, chunk_idx, content, embedding`` for every chunk that got a vector."""
    chunks = with_vectors(paragraph_chunks(files, max_bytes), embedder)
    return chunks.select("repo", "file", "chunk_idx", "content", "embedding")


def refresh_index(
    index: DataFrame,
    files: DataFrame,
    changes: DataFrame,
    embedder: Embedder | None = None,
    max_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """An index brought up to date: chunks of changed and deleted files go, changed files are indexed.

    ``changes`` comes from ``changed_files``; only its keys meet the stored chunks and the files.
    """
    gone = changes.select("repo", F.col("path").alias("file"))
    again = files.join(changes.where(F.col("status") != "deleted").select("repo", "path"), ["repo", "path"], "left_semi")
    kept = index.join(gone, ["repo", "file"], "left_anti")
    return kept.unionByName(index_files(again, embedder, max_bytes))


def refresh_table(
    table: IndexTable,
    files: DataFrame,
    now: Column,
    ttl: Column,
    embedder: Embedder | None = None,
    max_bytes: int = CHUNK_BYTES,
    read: Callable[[DataFrame], DataFrame] | None = None,
) -> int:
    """Bring an index with snapshots up to date with ``files``; only the buckets of changed files are read and written.

    ``files`` has contents, or is a listing and ``read`` fetches the contents of a part of it (``read_files``); a file that
    cannot be read then stays as it is indexed.  The first call makes the table.  Returns the snapshot's number.
    """
    changes = durable(changed_files(files, table.state(), now, ttl), "changes")
    again = files.join(changes.where(F.col("status") != "deleted").select("repo", "path"), ["repo", "path"], "left_semi")
    if read is not None:
        again = durable(read(again), "contents")
        failed = again.where(F.col("_error").isNotNull()).select("repo", "path")
        again, changes = again.where(F.col("_error").isNull()), changes.join(failed, ["repo", "path"], "left_anti")
    fresh = index_files(again, embedder, max_bytes)
    if not table.version():
        return table.write(fresh, changes.select("repo", "path", "mtime", now.alias("indexed_at")))
    return table.refresh(changes, fresh, now)


def refresh_state(state: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """``repo, path, mtime, indexed_at`` after a refresh: changed files stamped, deleted ones removed."""
    kept = state.join(changes.select("repo", "path"), ["repo", "path"], "left_anti")
    stamped = changes.where(F.col("status") != "deleted").select("repo", "path", "mtime", now.alias("indexed_at"))
    return kept.select("repo", "path", "mtime", "indexed_at").unionByName(stamped)


def file_errors(files: DataFrame, max_bytes: int = CHUNK_BYTES, index: DataFrame | None = None) -> DataFrame:
    """``repo, file, error``: files that could not be read, or whose chunks are all unfit to embed.

    A blank file has no chunks and is no error.  Given the ``index`` made of the files, those that have fit chunks but
    none in it are errors too: the embedder failed on all of them.
    """
    read_error = F.col("_error") if "_error" in files.columns else F.lit(None).cast("string")
    fit = F.exists("chunks", embeddable)
    error = F.coalesce(read_error, F.when((F.size("chunks") > 0) & ~fit, NO_VALID_TEXT))
    if index is not None:
        error = F.coalesce(error, F.when(fit, NOT_EMBEDDED))
    # No row or one per file, by a generator: a filter on the column would compute the chunks again.
    found = F.explode(F.filter(F.array(error), lambda e: e.isNotNull())).alias("error")
    rows = with_paragraph_chunks(files, max_bytes).select("repo", F.col("path").alias("file"), found)
    if index is None:
        return rows
    embedded = index.select("repo", "file").distinct()
    failed = rows.where(F.col("error") == NOT_EMBEDDED).join(embedded, ["repo", "file"], "left_anti")
    return rows.where(F.col("error") != NOT_EMBEDDED).unionByName(failed)


def error_report(errors: DataFrame, shown: int = ERRORS_SHOWN) -> DataFrame:
    """The first ``shown`` errors by repository and file, with the total and how many are not shown."""
    errors = durable(errors, "errors")  # a row per failed file, read twice
    total = errors.agg(F.count(F.lit(1)).alias("n")).scalar()
    return (
        errors.orderBy("repo", "file")
        .limit(shown)
        .withColumn("total", total)
        .withColumn("not_shown", F.greatest(F.col("total") - shown, F.lit(0).cast("long")))
    )


def index_stats(files: DataFrame, max_bytes: int = CHUNK_BYTES, index: DataFrame | None = None) -> DataFrame:
    """Per repository: files found and chunks saved.

    Rows that stand for a directory (an ``_error`` and no ``size``) are not files.  Given the ``index`` made of the
    files, its rows are what was saved; otherwise every fit chunk is.
    """
    if {"_error", "size"} <= set(files.columns):
        files = files.where(F.col("_error").isNull() | F.col("size").isNotNull())
    if index is None:
        saved = F.coalesce(F.size(F.filter("chunks", embeddable)), F.lit(0)).cast("long")
        rows = with_paragraph_chunks(files, max_bytes).select("repo", F.lit(1).alias("f"), saved.alias("n"))
    else:
        one = lambda df, f, n: df.select("repo", F.lit(f).alias("f"), F.lit(n).cast("long").alias("n"))
        rows = one(files, 1, 0).unionByName(one(index, 0, 1))
    return rows.groupBy("repo").agg(F.sum("f").alias("files_found"), F.sum("n").alias("chunks_saved"))


def code_embeddings(files: DataFrame, embedder: Embedder | None = None) -> DataFrame:
    """``repo, file, embedding, metadata<filename, function, class, start_line, end_line, content>`` of every
    definition (or block, where a file has none) that got a vector."""
    embedded = with_vectors(semantic_chunks(files), embedder)
    metadata = F.struct("filename", "function", "class", "start_line", "end_line", "content")
    return embedded.select("repo", "file", "embedding", metadata.alias("metadata"))
