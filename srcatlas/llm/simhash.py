"""Near duplicates by SimHash and covering locality-sensitive hashing.

Fingerprint: lower-cased (A-Z) words, shingles of ``words`` words with repeats, XXH64 with seed 42 of each; a bit is set
if more than half of the hashes have it.  A text with fewer words is one shingle; a text without words has fingerprint 0.

Links: fingerprints that differ in at most two bits.  Covering LSH (Pagh, "CoveringLSH", 2016): each bit position i gets a
non-zero vector m(i) of three bits, and table v (v = 1..7) keeps the positions with <m(i), v> = 1.  Two positions span at
most two dimensions of three, so some v is orthogonal to both: every pair within two bits agrees on all kept bits of some
table.  A bucket is never opened into pairs: its fingerprints can only differ in the bits that its table leaves out, so
each emits itself and its one-bit neighbours over those bits, and two of them are within two bits exactly if they share
such a midpoint.  At most 28 bits are left out, so at most 29 distinct fingerprints meet at a midpoint, whatever the size
of the bucket or of a group of copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcatlas.llm.common import columns_of, shielded, UID, whole_text, with_uid
from srcatlas.llm.components import components
from srcatlas.session import durable

BITS = 64
RADIUS = 2
TABLES = 2 ** (RADIUS + 1) - 1
FP = "__sa_fp"
_PIECE = 1 << 20
_SPACES = b" \t\n\v\f\r"


def masks() -> list[int]:
    """The kept bits of each table."""
    vector = [i % TABLES + 1 for i in range(BITS)]
    return [sum(1 << i for i in range(BITS) if (vector[i] & v).bit_count() & 1) for v in range(1, TABLES + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _word_runs(data: bytes) -> Iterator[list[bytes]]:
    """Words of a text of any length, a bounded piece at a time; pieces are cut at white space."""
    start = 0
    while start < len(data):
        end = start + _PIECE
        while end < len(data) and data[end] not in _SPACES:
            end += 1
        yield data[start:end].split()
        start = end


def fingerprint(data: bytes, words: int = 3) -> int:
    """Unsigned SimHash of one UTF-8 text; memory is bounded by a piece of it."""
    ones, total, last = np.zeros(BITS, np.int64), 0, []
    digest = xxhash.xxh64_intdigest
    for run in _word_runs(data.lower()):
        run = last + run
        if len(run) < words:
            last = run
            continue
        ends = np.cumsum([len(w) + 1 for w in run]).tolist()
        joined = b" ".join(run)
        hashes = [digest(joined[a:b], 42) for a, b in zip([0, *ends], [e - 1 for e in ends[words - 1 :]])]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
        total += len(hashes)
        last = run[len(run) - words + 1 :]
    if not total:
        return digest(b" ".join(last), 42) if last else 0
    return int.from_bytes(np.packbits(ones * 2 > total, bitorder="little").tobytes(), "little")


def with_fingerprint(docs: DataFrame, words: int = 3, out: str = FP) -> DataFrame:
    """Add the fingerprint as a signed long with the same bits."""

    @F.pandas_udf("long")
    def prints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([_signed(fingerprint(x, words)) for x in batch], dtype="int64")

    return docs.withColumn(out, prints(whole_text().cast("binary")))


def links(prints: DataFrame) -> DataFrame:
    """Distinct fingerprints ``fp`` -> edges (``a``, ``b``) whose components are those of all links."""
    kept = F.array(*[F.struct(F.lit(v).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("k")) for v, m in enumerate(masks())])
    cells = prints.select("fp", F.inline(kept))
    # written, so that the join has shuffles of its own on both sides and a bucket of any size can be split
    shared = durable(cells.groupBy("t", "k").count().where("count > 1").select("t", "k"), "buckets")
    flips = F.array(
        *[F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << i)) for i in range(BITS) if not m >> i & 1]) for m in masks()]
    )
    return (
        cells.join(shared, ["t", "k"])
        .select("t", "fp", F.explode(F.get(flips, F.col("t"))).alias("flip"))
        .groupBy("t", F.col("fp").bitwiseXOR(F.col("flip")).alias("mid"))
        .agg(F.collect_set("fp").alias("fps"))  # at most 29
        .where(F.size("fps") > 1)
        .select(F.array_min("fps").alias("b"), F.explode("fps").alias("a"))
        .where("a <> b")
        .select("a", "b")
    )


def near_groups(rows: DataFrame) -> DataFrame:
    """A written table with ``doc_id``, ``UID`` and ``FP`` -> the same rows with ``component_id`` and ``__sa_keeper``.

    ``component_id`` is the smallest ``doc_id`` that links reach (null only if all of them are null); ``__sa_keeper``
    is the UID of one row that has it.  Rows without text share fingerprint 0 and form one group, and so do repeated rows.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", UID)).alias("first")
    prints = durable(rows.groupBy(F.col(FP).alias("fp")).agg(first), "prints")
    roots = components(links(prints.select("fp")))
    joined = prints.join(roots, prints.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    lowest = durable(joined.groupBy("root").agg(F.min("first").alias("lowest")), "lowest")
    classes = joined.join(lowest, "root").select(
        F.col("fp").alias(FP), F.col("lowest.doc_id").alias("component_id"), F.col(f"lowest.{UID}").alias("__sa_keeper")
    )
    return rows.drop("component_id").join(durable(classes, "classes"), FP)


def near_duplicates(docs: DataFrame, words: int = 3) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``fingerprint`` (16 hex digits), ``component_id``.

    Null texts are empty, and empty texts are linked to each other.  An empty table gives no rows.
    """
    rows = durable(with_uid(with_fingerprint(docs.select("doc_id", "text"), words).drop("text")), "fingerprints")
    return near_groups(rows).select("doc_id", F.lpad(F.lower(F.hex(FP)), 16, "0").alias("fingerprint"), "component_id")


@shielded
def drop_near_duplicates(docs: DataFrame, words: int = 3) -> DataFrame:
    """``docs`` with one row of each group: one that carries the smallest ``doc_id`` (of repeated rows, just one)."""
    rows = durable(with_uid(with_fingerprint(docs, words)), "documents")
    # the rows that go are written: where they are few, they are sent to every task and no text is shuffled
    gone = durable(near_groups(rows.select("doc_id", UID, FP)).where(F.col(UID) != F.col("__sa_keeper")).select(UID), "gone")
    return rows.join(gone, UID, "left_anti").select(*columns_of(docs))
