"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcatlas.session import durable

#: A key with more rows than one task should get is hot, and is dealt over as many shuffle keys as that takes.
ROWS_PER_TASK = 1_000_000
#: No more keys than this can be hot: beyond ROWS_PER_TASK times as many rows, tasks get more rows each.
MAX_HOT_KEYS = 100_000


def hot_keys(counts: DataFrame, keys: Sequence[str], n: str, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """``keys`` and ``_fan`` (shuffle keys to use) of the keys with more than ``rows_per_task`` rows, from a table of
    counts per key.

    At most ``MAX_HOT_KEYS`` rows can qualify, whatever the data, so the result may be broadcast.
    """
    limit = F.greatest(F.lit(float(rows_per_task)), counts.agg(F.sum(n)).scalar() / F.lit(float(MAX_HOT_KEYS)))
    return counts.where(F.col(n) > limit).select(*keys, F.ceil(F.col(n) / limit).cast("int").alias("_fan"))


def salted_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    salt_by: Sequence[str],
    how: str = "inner",
    hot: DataFrame | None = None,
    hot_on: Sequence[str] | None = None,
    rows_per_task: int = ROWS_PER_TASK,
    written: str | None = None,
) -> DataFrame:
    """Equi-join whose hot keys are split by a salt.

    ``left`` may be skewed on ``on``; ``right`` has few rows per key.  Rows of ``left`` with a hot key
    get a salt from ``salt_by`` (a value of the row, so a rerun task gives the same salt) and only the
    hot rows of ``right`` are repeated, each as often as its key has salts.  ``hot_on`` names a short key to
    find hot rows by when ``on`` holds long texts.  ``written`` names a table that ``right`` with its salts is written to, so
    that the planner knows its size and sends it to every task where it is small, without a shuffle of ``left``.
    """
    keys, hot_on = list(on), list(hot_on or on)
    if hot is None:
        hot = hot_keys(left.groupBy(*hot_on).agg(F.count(F.lit(1)).alias("_n")), hot_on, "_n", rows_per_task)
    hot = F.broadcast(hot)
    spread = F.pmod(F.xxhash64(*salt_by), F.coalesce("_fan", F.lit(1))).cast("int")
    salted = left.join(hot, hot_on, "left").withColumn("_salt", spread)
    every = F.sequence(F.lit(0), F.coalesce("_fan", F.lit(1)) - 1)
    repeated = right.join(hot, hot_on, "left").withColumn("_salt", F.explode(every))
    repeated = repeated.drop("_fan")
    if written:
        repeated = durable(repeated, written)
    return salted.drop("_fan").join(repeated, [*keys, "_salt"], how).drop("_salt")
