"""Mixing sources to target weights: each document floor(rate) times, plus one hash-seeded Bernoulli copy.

Sources in code-point order (null last) weigh 1, 2, 3, 1, 2, 3 ... and share all words by weight.  A target stops at
MAX_REPEAT times the source's size; what is over is shared by weight among the rest, until none is above.  A source's rate
is target / size; the extra copy of a document comes with probability equal to the rate's fraction, decided by a hash of
the document and a seed.  SEEDS seeds are tried per source in one pass of sums, and the one whose sum of words is closest
to the target is used: the copies stay hash-seeded draws of that probability, and small sources come near their target.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcatlas.llm.common import columns_of, numbered, shielded, whole_text
from srcatlas.session import durable

MAX_REPEAT = 3
WEIGHTS = 3
SEEDS = 32

SIZE, SOURCE = "__sa_size", "__sa_source"


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """``SOURCE``, ``source_size`` -> with ``target``, written.  Each round reads two sums and fixes the sources above their stop."""
    ranked = numbered(sizes, [F.col(SOURCE).asc_nulls_last()], "rank").select(SOURCE, "source_size", (F.col("rank") % WEIGHTS + 1).alias("weight"))
    state = durable(ranked.withColumn("stopped", F.lit(False)), "weights")
    total = state.agg(F.sum("source_size")).first()[0] or 0
    while True:
        free = state.agg(
            F.sum(F.when(~F.col("stopped"), F.col("weight"))).alias("weight"),
            F.coalesce(F.sum(F.when(F.col("stopped"), F.col("source_size") * MAX_REPEAT)), F.lit(0)).alias("fixed"),
        ).first()
        if not free.weight:
            break
        # exact test in whole numbers: weight * rest / free weights > stop
        rest, stop = total - free.fixed, F.col("source_size") * MAX_REPEAT
        above = ~F.col("stopped") & (
            F.col("weight").cast("decimal(38,0)") * F.lit(rest).cast("decimal(20,0)") > stop.cast("decimal(20,0)") * F.lit(free.weight).cast("decimal(17,0)")
        )
        if not state.where(above).limit(1).count():
            break
        state = durable(state.withColumn("stopped", F.col("stopped") | above), "weights")
    share = F.col("weight").cast("double") * F.lit(float(total - free.fixed)) / F.lit(float(free.weight or 1))
    target = F.when(F.col("stopped"), (F.col("source_size") * MAX_REPEAT).cast("double")).otherwise(share)
    return durable(state.select(SOURCE, "source_size", target.alias("target")), "targets")


def _draw(seed: Column | int) -> Column:
    """A number in [0, 1) that depends on the document and the seed."""
    return F.shiftrightunsigned(F.xxhash64("__sa_key", F.lit(seed) if isinstance(seed, int) else seed), 11) / F.lit(float(1 << 53))


def rates(sized: DataFrame) -> DataFrame:
    """``SOURCE`` -> ``source_size``, ``target``, ``__sa_whole``, ``__sa_part``, ``__sa_seed``, written: one row per source."""
    sizes = sized.groupBy(SOURCE).agg(F.sum(SIZE).alias("source_size"))
    goal = targets(sizes)
    rate = F.coalesce(F.col("target") / F.expr("nullif(source_size, 0)"), F.lit(0.0))
    goal = goal.withColumn("__sa_whole", F.floor(rate)).withColumn("__sa_part", rate - F.floor(rate)).withColumnRenamed(SOURCE, "__sa_of")
    goal = durable(goal, "rates")
    joined = sized.join(goal, F.col(SOURCE).eqNullSafe(F.col("__sa_of")))
    tried = joined.groupBy("__sa_of").agg(
        *[F.sum(F.when(_draw(s) < F.col("__sa_part"), F.col(SIZE)).otherwise(0)).alias(f"s{s}") for s in range(SEEDS)]
    )
    wanted = F.col("target") - F.col("source_size") * F.col("__sa_whole")
    goal2 = goal.join(tried.withColumnRenamed("__sa_of", "__sa_of2"), F.col("__sa_of").eqNullSafe(F.col("__sa_of2"))).drop("__sa_of2")
    best = F.array_min(F.array(*[F.struct(F.abs(F.col(f"s{s}") - wanted).alias("off"), F.lit(s).alias("seed")) for s in range(SEEDS)]))
    return durable(goal2.select("__sa_of", "source_size", "target", "__sa_whole", "__sa_part", best["seed"].alias("__sa_seed")), "rates")


def with_copies(docs: DataFrame, whole: bool) -> DataFrame:
    """Rows of ``docs`` (``whole``, or ``doc_id`` alone) with ``SIZE`` and ``__sa_copies``; without ``whole``, ``source_size`` and ``target`` too."""
    key = F.xxhash64("doc_id", whole_text())
    sized = lambda cols: docs.select(*cols, word_count(whole_text()).alias(SIZE), F.col("source").alias(SOURCE), key.alias("__sa_key"))
    narrow = durable(sized(["doc_id"]), "sizes")
    rate = rates(narrow)
    rows = sized(columns_of(docs)) if whole else narrow
    if whole:  # nothing that a column of docs may be called
        rate = rate.drop("source_size", "target")
    copies = (F.col("__sa_whole") + F.when(_draw(F.col("__sa_seed")) < F.col("__sa_part"), 1).otherwise(0)).cast("int")
    return rows.join(rate, F.col(SOURCE).eqNullSafe(F.col("__sa_of"))).withColumn("__sa_copies", copies)


def mixture(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``size``, ``source_size``, ``target``, ``taken``.

    A null text has size 0; a source without words has target 0.  Repeated rows are drawn alike.  Reruns agree: draws
    depend on ``doc_id`` and text alone.  An empty table gives no rows.
    """
    return with_copies(docs, whole=False).select(
        "doc_id", F.col(SIZE).alias("size"), "source_size", "target", (F.col(SIZE) * F.col("__sa_copies")).alias("taken")
    )


@shielded
def mixed(docs: DataFrame) -> DataFrame:
    """``docs`` with each row as often as the mix takes it: not at all, or up to MAX_REPEAT times."""
    rows = with_copies(docs, whole=True).where("__sa_copies > 0")
    return rows.select(*columns_of(docs), F.explode(F.sequence(F.lit(1), "__sa_copies")).alias("__sa_copy")).drop("__sa_copy")
