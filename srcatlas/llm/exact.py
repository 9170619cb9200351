"""Exact duplicates by progressive refinement: length, then a hash of the prefix, then a hash of the full text.

Each level counts its keys and marks those seen more than once in a bitmap of fixed size, which the next level uses to
skip rows that cannot have a copy.  Lengths and prefix hashes are counted with partial sums, so a key with a third of all
rows is one row per task; the full text is hashed only where the prefix level left the row over, and texts are not
shuffled for it.  A bitmap may let a row through needlessly (two keys, one bit), never the reverse, and the final groups
are by length and SHA-256, so the result is exact at any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcatlas.llm.common import columns_of, shielded, UID, whole_text, with_uid
from srcatlas.session import durable

PREFIX_CHARS = 256
#: Bits of a level's bitmap: 8 MB, the most that is broadcast.
FILTER_BITS = 1 << 26

LENGTH, PREFIX, DIGEST = "__sa_length", "__sa_prefix", "__sa_digest"


def _bitmap_of_repeated(rows: DataFrame, key: list[str]) -> DataFrame:
    """(``__sa_chunk``, ``__sa_bitmap``): a bit for each key with two rows or more; at most FILTER_BITS / 8 bytes in all."""
    slot = F.pmod(F.xxhash64(*key), F.lit(FILTER_BITS))
    repeated = rows.groupBy(*key).count().where("count > 1").select(slot.alias("slot"))
    return repeated.groupBy(F.bitmap_bucket_number("slot").alias("__sa_chunk")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("__sa_bitmap")
    )


def _with_mark(rows: DataFrame, key: list[str], bitmap: DataFrame, out: str) -> DataFrame:
    """Add ``out``: whether the bit of the row's key is set.  The bitmap's size is fixed, so every task gets it."""
    slot = F.pmod(F.xxhash64(*key), F.lit(FILTER_BITS))
    byte = F.expr("conv(hex(substring(__sa_bitmap, cast(__sa_bit div 8 as int) + 1, 1)), 16, 10)").cast("int")
    return (
        rows.withColumn("__sa_chunk", F.bitmap_bucket_number(slot))
        .withColumn("__sa_bit", F.bitmap_bit_position(slot))
        .join(F.broadcast(bitmap), "__sa_chunk", "left")
        .withColumn("__sa_byte", F.coalesce(byte, F.lit(0)))
        .withColumn(out, F.expr("shiftright(__sa_byte, cast(__sa_bit % 8 as int)) & 1") == 1)
        .drop("__sa_chunk", "__sa_bit", "__sa_bitmap", "__sa_byte")
    )


def _refined(docs: DataFrame, keep: list[Column]) -> DataFrame:
    """``keep`` plus ``LENGTH``, ``DIGEST`` and ``UID``, written; ``DIGEST`` is null where no other row can be equal."""
    length = F.octet_length(whole_text()).cast("long").alias(LENGTH)
    prefix = F.xxhash64(F.substring(whole_text(), 1, PREFIX_CHARS)).alias(PREFIX)
    by_length = durable(_bitmap_of_repeated(docs.select(length), [LENGTH]), "lengths")
    left = _with_mark(docs.select(length, prefix), [LENGTH], by_length, "__sa_maybe").where("__sa_maybe")
    by_prefix = durable(_bitmap_of_repeated(left, [LENGTH, PREFIX]), "prefixes")
    rows = docs.select(*keep, length, prefix, whole_text().alias("__sa_text"))
    rows = _with_mark(rows, [LENGTH], by_length, "__sa_by_length")
    rows = _with_mark(rows, [LENGTH, PREFIX], by_prefix, "__sa_by_prefix")
    full = F.when(F.col("__sa_by_length") & F.col("__sa_by_prefix"), F.sha2("__sa_text", 256)).alias(DIGEST)
    kept = [c for c, name in zip(columns_of(rows), rows.columns) if not name.startswith("__sa_")]
    return durable(with_uid(rows.select(*kept, LENGTH, full)), "refined")


def _classes(rows: DataFrame) -> DataFrame:
    """One row per group of equal texts with a digest: its size and the row that stays (largest doc_id, then UID).

    Written, so that the join back to the rows sends a small table to every task, and otherwise has shuffles of its own
    on both sides, which adaptive execution splits where a group is large.
    """
    groups = (
        rows.where(F.col(DIGEST).isNotNull())
        .groupBy(LENGTH, DIGEST)
        .agg(F.count("*").alias("__sa_n"), F.max(F.struct("doc_id", UID)).alias("__sa_last"))
    )
    return durable(groups, "groups")


def exact_duplicates(docs: DataFrame, *carry: Column) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``keep_id``, ``group_size``, ``kept`` and the row-local columns ``carry``.

    Texts are equal if identical; a null text equals an empty one.  ``keep_id`` is the largest ``doc_id`` of the group
    (null only if all are null) and ``kept`` tells whether the row has it: of repeated rows with that id all say so,
    since they are one document (``drop_exact_duplicates`` leaves one).  An empty table gives no rows.
    """
    rows = _refined(docs, ["doc_id", *carry])
    names = [c for c in rows.columns if not c.startswith("__sa_") and c != "doc_id"]  # the carried columns
    alone = rows.where(F.col(DIGEST).isNull()).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), *names
    )
    grouped = (
        rows.where(F.col(DIGEST).isNotNull())
        .join(_classes(rows), [LENGTH, DIGEST])
        .select(
            "doc_id",
            F.col("__sa_last.doc_id").alias("keep_id"),
            F.col("__sa_n").alias("group_size"),
            F.col("doc_id").eqNullSafe(F.col("__sa_last.doc_id")).alias("kept"),
            *names,
        )
    )
    return alone.unionByName(grouped)


@shielded
def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of equal texts: one with the largest ``doc_id`` (of repeated rows, just one)."""
    rows = _refined(docs, columns_of(docs))
    last = _classes(rows).select(LENGTH, DIGEST, F.col(f"__sa_last.{UID}").alias("__sa_keeper"))
    alone = rows.where(F.col(DIGEST).isNull()).select(*columns_of(docs))
    chosen = rows.where(F.col(DIGEST).isNotNull()).join(last, [LENGTH, DIGEST]).where(F.col(UID) == F.col("__sa_keeper"))
    return alone.union(chosen.select(*columns_of(docs)))
