"""Which files need indexing again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcatlas.session import durable


def _not_seen(gone: DataFrame, errors: DataFrame) -> DataFrame:
    """``gone`` without files at or below a path of ``errors``: what could not be listed or read is not deleted."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    below = gone.select("repo", "path", F.explode(above).alias("_up"))
    # written: failures are few as a rule, and are then sent to every task instead of dealing all deleted paths of a repository
    failed = durable(errors.select("repo", F.col("path").alias("_up")).distinct(), "failed")
    return gone.join(below.join(failed, ["repo", "_up"], "left_semi").select("repo", "path"), ["repo", "path"], "left_anti")


def changed_files(files: DataFrame, state: DataFrame, now: Column, ttl: Column) -> DataFrame:
    """``repo, path, mtime, status`` of files to index (``new``, ``modified``, ``expired``) or to remove
    (``deleted``); unchanged files are left out.

    ``state`` holds ``repo, path, mtime, indexed_at``, one row per indexed file.  Both sides are keyed by
    file, so one full join answers all four questions with one shuffle per side and no skew.

    Where ``files`` has ``_error``, its rows with an error are no files: what is known at or below their paths
    stays as it is, since a directory that cannot be listed says nothing about its files.
    """
    failing = "_error" in files.columns
    errors = files.where(F.col("_error").isNotNull()) if failing else None
    seen = state.select(
        "repo", "path", F.col("mtime").alias("_mtime"), F.col("indexed_at").alias("_at"), F.lit(True).alias("_known")
    )
    current = (files.where(F.col("_error").isNull()) if failing else files).select("repo", "path", "mtime", F.lit(True).alias("_here"))
    status = (
        F.when(F.col("_here").isNull(), "deleted")
        .when(F.col("_known").isNull(), "new")
        .when(F.col("mtime") > F.col("_mtime"), "modified")
        .when(now - F.col("_at") > ttl, "expired")
    )
    changes = (
        current.join(seen, ["repo", "path"], "full")
        .select("repo", "path", F.coalesce("mtime", "_mtime").alias("mtime"), status.alias("status"))
        .where(F.col("status").isNotNull())
    )
    if not failing:
        return changes
    return changes.where("status <> 'deleted'").unionByName(_not_seen(changes.where("status = 'deleted'"), errors))
