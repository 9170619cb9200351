"""Embedding: which texts qualify, how they are batched, vectors per text, vectors back on chunks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcatlas.functions.hashed_bag import hashed_bag
from srcatlas.functions.tables import EMBED_BATCH
from srcatlas.functions.text import embeddable, normalize, skip_reason, token_estimate
from srcatlas.operators.skew import hot_keys, salted_join
from srcatlas.schemas import VECTORS
from srcatlas.session import bounded_batches

#: A user's embedder: batches with columns ``text`` (stored) and ``prepared`` (to be sent) in,
#: ``text`` and ``embedding`` out.  Rows it leaves out count as not embedded.
Embedder = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def embed_eligibility(chunks: DataFrame) -> DataFrame:
    """Per file: texts, those that will be embedded and those skipped, by reason."""
    reason = chunks.withColumn("_why", skip_reason(F.col("content")))
    return reason.groupBy("repo", "file").agg(
        F.count(F.lit(1)).alias("texts"),
        F.count_if(F.col("_why").isNull()).alias("valid"),
        F.count_if(F.col("_why") == "blank").alias("skipped_blank"),
        F.count_if(F.col("_why") == "long").alias("skipped_long"),
    )


def distinct_texts(chunks: DataFrame) -> DataFrame:
    """Embeddable texts, each once, with the number of chunks that hold it."""
    return (
        chunks.where(embeddable(F.col("content")))
        .groupBy(F.col("content").alias("text"))
        .agg(F.count(F.lit(1)).alias("copies"))
    )


def embed_batches(chunked: DataFrame, size: int = EMBED_BATCH) -> DataFrame:
    """Batch number of each embeddable chunk: its rank among the file's embeddable chunks over ``size``.

    Ranks come from the file's own array of chunks, so there is nothing to shuffle or sort.
    """
    size = size if size > 0 else EMBED_BATCH
    numbered = F.transform("chunks", lambda c, i: F.struct(i.cast("int").alias("idx"), c.alias("text")))
    valid = F.filter(numbered, lambda x: embeddable(x["text"]))
    rows = chunked.select("repo", F.col("path").alias("file"), F.posexplode(valid).alias("_rank", "_c"))
    return rows.select(
        "repo",
        "file",
        F.col("_c.idx").alias("chunk_idx"),
        F.floor(F.col("_rank") / size).cast("int").alias("batch"),
        token_estimate(F.col("_c.text")).alias("tokens"),
    )


def embed_texts(texts: DataFrame, embedder: Embedder | None = None) -> DataFrame:
    """``text, embedding`` for a table of distinct texts.

    A user's embedder runs on executors over Arrow batches (``spark.sql.execution.arrow.
    maxRecordsPerBatch`` rows each, and no more than ``BATCH_BYTES``); rows without a vector are dropped.
    """
    bounded_batches(texts.sparkSession)
    prepared = texts.select("text", normalize(F.col("text")).alias("prepared"))
    if embedder is None:
        return prepared.select("text", hashed_bag(F.col("prepared")).alias("embedding"))
    return prepared.mapInPandas(embedder, VECTORS).where(F.size("embedding") > 0)


def digest(text: Column) -> Column:
    """What texts are joined by: 32 bytes in place of the text."""
    return F.unhex(F.sha2(text, 256))


def attach_vectors(chunks: DataFrame, vectors: DataFrame, copies: DataFrame | None = None) -> DataFrame:
    """Give every chunk the vector of its text; chunks without one are dropped.

    ``vectors`` holds ``text`` or its ``digest``, with ``embedding``.  The join is by digest, so a text moves once,
    with its chunk.  Copies of one text may be a large share of all chunks, so hot digests are salted; ``copies``
    (``copies`` with ``text`` or its ``digest``) tells how often each text occurs where that is known, otherwise the chunks are counted.
    """
    left = chunks.drop("embedding").withColumn("_d", digest(F.col("content")))
    key = F.col("digest") if "digest" in vectors.columns else digest(F.col("text"))
    right = vectors.select(key.alias("_d"), "embedding")
    if copies is None:
        counts = left.groupBy("_d").agg(F.count(F.lit(1)).alias("_n"))
    else:
        of_copies = F.col("digest") if "digest" in copies.columns else digest(F.col("text"))
        counts = copies.select(of_copies.alias("_d"), F.col("copies").alias("_n"))
    salt_by = [c for c in chunks.columns if c in ("repo", "file", "chunk_idx", "start_line")]
    return salted_join(left, right, ["_d"], salt_by, hot=hot_keys(counts, ["_d"], "_n")).drop("_d")


def embed_coverage(chunks: DataFrame, embedded: DataFrame) -> DataFrame:
    """Per file: valid texts, texts with a vector, and whether the file failed (none of them has one)."""
    valid = chunks.select("repo", "file", F.lit(0).alias("e"), embeddable(F.col("content")).cast("int").alias("v"))
    got = embedded.select("repo", "file", F.lit(1).alias("e"), F.lit(0).alias("v"))
    counts = valid.unionByName(got).groupBy("repo", "file").agg(
        F.sum("v").alias("valid"), F.sum("e").alias("embedded")
    )
    return counts.withColumn("failed", F.col("embedded") == 0)
