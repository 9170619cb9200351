"""Vectors that outlive a run: a folder of small files by digest of text, to which embedding tasks add as they go.

A task writes what its embedder gives batch by batch, each batch as a file of its own that appears as a whole.  So a run that
fails keeps what is done, a later run sends only texts whose digest is not there, and a repeated task at worst writes vectors
twice, of which readers take one.
"""

from __future__ import annotations

import hashlib
import io
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srcatlas.functions.text import embeddable, normalize
from srcatlas.operators.embed import Embedder, attach_vectors, digest
from srcatlas.session import bounded_batches, durable, names_in
from srcatlas.sources.fs import add_file

STORED = "digest binary, embedding array<float>"


class VectorStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _files(self) -> DataFrame:
        if not any(n.endswith(".parquet") for n in names_in(self.spark, self.path)):
            return self.spark.createDataFrame([], STORED)
        return self.spark.read.schema(STORED).parquet(self.path)

    def vectors(self) -> DataFrame:
        """``digest``, ``embedding``: one row per text."""
        return self._files().groupBy("digest").agg(F.first("embedding").alias("embedding"))

    def missing(self, texts: DataFrame) -> DataFrame:
        """The distinct ``texts`` (``text``) that have no vector; they meet the store by digest."""
        return texts.withColumn("digest", digest(F.col("text"))).join(self._files().select("digest"), "digest", "left_anti").drop("digest")

    def fill(self, texts: DataFrame, embedder: Embedder) -> int:
        """Embed the missing ones of distinct ``texts``; returns how many vectors were added."""
        path = self.path

        def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for out in embedder(batches):
                out = out[[v is not None and len(v) > 0 for v in out["embedding"]]]
                if len(out):
                    rows = pa.table({"digest": pa.array([hashlib.sha256(t.encode()).digest() for t in out["text"]], pa.binary()), "embedding": pa.array([list(map(float, v)) for v in out["embedding"]], pa.list_(pa.float32()))})
                    held = io.BytesIO()
                    pq.write_table(rows, held)
                    add_file(f"{path}/{uuid.uuid4().hex}.parquet", held.getvalue())
                yield pd.DataFrame({"n": [len(out)]})

        bounded_batches(self.spark)
        prepared = self.missing(texts.select("text")).select("text", normalize(F.col("text")).alias("prepared"))
        return durable(prepared.mapInPandas(add, "n long"), "added").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def attach(self, chunks: DataFrame, embedder: Embedder) -> DataFrame:
        """``chunks`` with ``embedding``, new texts embedded first; those without a vector are dropped.

        Digests are counted and meet the store; of the texts only those without a vector are dealt, once, and are sent once.
        """
        chunks = durable(chunks, "chunks")
        fit = chunks.where(embeddable(F.col("content"))).select(F.col("content").alias("text"), digest(F.col("content")).alias("digest"))
        digests = durable(fit.groupBy("digest").agg(F.count(F.lit(1)).alias("copies")), "digests")
        new = durable(digests.join(self._files().select("digest"), "digest", "left_anti").select("digest"), "new-digests")
        if new.limit(1).count():
            self.fill(fit.join(new, "digest", "left_semi").select("text").distinct(), embedder)
        return attach_vectors(chunks, durable(self.vectors().join(digests, "digest", "left_semi"), "vectors"), digests)
