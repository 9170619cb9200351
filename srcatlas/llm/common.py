"""Helpers shared by the operators of this folder.

Input conventions, the same for every operator: a null text counts as empty, extra columns are carried or ignored but
never read.  Working columns start with ``__sa_``; operators that carry all columns rename input columns of that kind first
(``shielded``), so that none can clash.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from srcatlas.session import durable

UID = "__sa_uid"
BUCKET = "__sa_bucket"


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def free_name(df: DataFrame, label: str) -> str:
    """A name for a working column that no column of ``df`` has, in any letter case."""
    taken, name = {c.lower() for c in df.columns}, f"__sa_{label}"
    while name in taken:
        name += "_"
    return name


def columns_of(df: DataFrame) -> list[Column]:
    """All columns of ``df``, whatever characters their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def shielded(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """For operators whose result has the columns of their first argument: names like those of working columns are hidden meanwhile."""

    @wraps(operator)
    def run(docs: DataFrame, *args, **kwargs) -> DataFrame:
        names = docs.columns
        if not any(c.lower().startswith("__sa_") for c in names):
            return operator(docs, *args, **kwargs)
        taken, hidden = {c.lower() for c in names}, []
        for i, c in enumerate(names):
            other = f"carried_{i}"
            while other in taken:
                other += "_"
            hidden.append(other if c.lower().startswith("__sa_") else c)
        return operator(docs.toDF(*hidden), *args, **kwargs).toDF(*names)

    return run


def with_uid(df: DataFrame) -> DataFrame:
    """A number unique to each row, repeated rows included.  Stable only once the result is written (``durable``)."""
    return df.withColumn(UID, F.monotonically_increasing_id())


def running_total_by(df: DataFrame, group: list[str], order: list[Column], weight: Column, out: str) -> DataFrame:
    """Add ``out``: the sum of ``weight`` over the rows that precede this one in its group (a long; 0 for the first).

    ``order`` says which precede, whatever tasks wrote the rows; equal rows come in any order.  ``df`` has ``UID``.  Rows are
    dealt by ranges of group, order and ``UID``, so a group of any size, and also one of equal rows, is split; what is gathered
    per group is one sum per range.
    """
    keys = [*map(F.col, group), *order, F.col(UID)]
    ranged = df.withColumn("__sa_w", weight.cast("long")).repartitionByRange(*keys).withColumn(BUCKET, F.spark_partition_id())
    dealt = durable(ranged, "ranges")
    earlier = Window.partitionBy(*group).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy(*group, BUCKET).agg(F.sum("__sa_w").alias("__sa_sum"))
    offsets = sums.select(*group, BUCKET, F.coalesce(F.sum("__sa_sum").over(earlier), F.lit(0)).alias("__sa_offset"))
    inside = Window.partitionBy(*group, BUCKET).orderBy(*order, UID).rowsBetween(Window.unboundedPreceding, -1)
    run = dealt.withColumn("__sa_inside", F.coalesce(F.sum("__sa_w").over(inside), F.lit(0))).join(offsets, [*group, BUCKET])
    return run.withColumn(out, F.col("__sa_inside") + F.col("__sa_offset")).drop(BUCKET, "__sa_w", "__sa_inside", "__sa_offset")


def numbered(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """Add ``out``: the row's number from 0 in the order of ``order``, which should tell any two rows apart.

    Rows are dealt by ranges of ``order``; what is gathered is one count per partition.
    """
    part = durable(df.repartitionByRange(*order).withColumn("__sa_part", F.spark_partition_id()), "ranges")
    before = Window.orderBy("__sa_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = part.groupBy("__sa_part").count().select("__sa_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__sa_before"))
    inside = F.row_number().over(Window.partitionBy("__sa_part").orderBy(*order))
    return part.withColumn("__sa_inside", inside).join(counts, "__sa_part").withColumn(out, F.col("__sa_inside") - 1 + F.col("__sa_before")).drop(
        "__sa_part", "__sa_before", "__sa_inside"
    )
