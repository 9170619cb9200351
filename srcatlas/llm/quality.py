"""Quality rules with thresholds that follow the data, per language and source.

Features are expressions on one row.  Each feature's distribution is held in a log-linear sketch: a value falls in a
bucket named by its leading six bits, and counts per (language, source, feature, bucket) are added up.  Such sketches merge
by addition in any order with the same result, and a quantile is within 1/32 of the exact one.  A group's upper bound for a
feature is found by a gap test above its median (the upper half may be junk): the bound goes up from bucket to bucket as long as the
next one that has a row is within reach, which is FENCE times the distance from the lower quartile to the median (a bucket's width
and the feature's STEPS at least).  So what stands apart from the upper end of a group is rejected, and a group whose values are
alike, whatever they are (a source of tables, of long words), loses nothing.  Below GUARDS, far under what is usual for noise, nothing is rejected.
Groups with few rows use the merged sketch of their language, and that of all rows if the language is rare as well.  The bounds
are joined back to the rows by language and source.

Only DataFrame functions are used.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from srcatlas.llm.common import columns_of, shielded, whole_text
from srcatlas.session import durable

# Fixed values of the base rule.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

#: Rates in parts per 10,000 (word_length: 10,000 times the mean) that are judged: below these no row is rejected.
GUARDS = {"symbol_rate": 50, "dup_line_rate": 1000, "repeat_rate": 1000, "word_length": 55_000}
#: The least distance from the lower quartile to the median that counts for each.
STEPS = {"symbol_rate": 10, "dup_line_rate": 500, "repeat_rate": 300, "word_length": 1000}
FENCE = 6
MIN_GROUP = 200
LEADING_BITS = 6

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
F_ = "__sa_f"


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and name it inside ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _windows(words: Column) -> Column:
    """(hash, position) of every three-word window, sorted."""
    hashed = F.transform(words, lambda w, i: F.struct(F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("p")))
    return F.sort_array(F.slice(hashed, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0))))


def _repeated_positions(windows: Column) -> Column:
    """Positions of the windows that have an equal one, ascending."""

    def same(x, i):
        return F.coalesce(F.get(windows, i)["h"] == x["h"], F.lit(False))

    return F.sort_array(F.transform(F.filter(windows, lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["p"]))


def _covered(starts: Column) -> Column:
    """Words under windows of three that begin at ``starts`` (ascending)."""
    steps = F.transform(starts, lambda p, i: F.least(F.coalesce(F.get(starts, i + 1) - p, F.lit(3)), F.lit(3)))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda a, s: a + s)


def features(text: Column) -> Column:
    """Struct of ``COUNTS`` and ``n_lines`` of one whole text, longs.

    Repeated windows are found by sorting 64-bit hashes with their positions: n log n steps in one text, no shuffle.
    """
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))
    return _let(
        F.struct(words.alias("words"), lines.alias("lines")),
        lambda t: F.struct(
            F.size(t["words"]).cast("long").alias("n_words"),
            F.aggregate(t["words"], F.lit(0).cast("long"), lambda a, w: a + F.length(w)).alias("word_chars"),
            F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            (F.size(t["lines"]) - F.size(F.array_distinct(t["lines"]))).cast("long").alias("n_dup_lines"),
            _let(_let(t["words"], _windows), lambda s: _let(_repeated_positions(s), _covered)).alias("n_repeat_words"),
            F.size(t["lines"]).cast("long").alias("n_lines"),
        ),
    )


def _base_failed() -> Column:
    f = F.col(F_)
    return (f["n_words"] < MIN_WORDS) | (f["n_repeat_words"] * 100 > f["n_words"] * MAX_REPEAT_PERCENT)


def _rates() -> dict[str, Column]:
    rate = lambda part, whole: F.coalesce(F.expr(f"{F_}.{part} * 10000 div nullif({F_}.{whole}, 0)"), F.lit(0).cast("long"))
    return {
        "symbol_rate": rate("n_symbols", "word_chars"),
        "dup_line_rate": rate("n_dup_lines", "n_lines"),
        "repeat_rate": rate("n_repeat_words", "n_words"),
        "word_length": rate("word_chars", "n_words"),
    }


def sketch(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, ``feature``, ``bucket``, ``n``: one mergeable sketch per group and feature, of rows that pass the base rule."""
    pairs = F.array(*[F.struct(F.lit(k).alias("feature"), v.alias("value")) for k, v in _rates().items()])
    flat = rows.where(~_base_failed()).select(*keys, F.inline(pairs))
    shift = F.expr(f"greatest(length(bin(value)) - {LEADING_BITS}, 0)")
    bucket = F.expr("shiftleft(shiftright(value, __sa_shift), __sa_shift)")
    return flat.withColumn("__sa_shift", shift).groupBy(*keys, "feature", bucket.alias("bucket")).agg(F.count("*").alias("n"))


def merged(parts: DataFrame, keys: list[str]) -> DataFrame:
    return parts.groupBy(*keys, "feature", "bucket").agg(F.sum("n").alias("n"))


def bounds(parts: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    """One row per group: ``{prefix}rows`` and a bound for each feature.  A group has at most 2^6 buckets per magnitude."""
    group = Window.partitionBy(*keys, "feature")
    ordered = group.orderBy("bucket")
    ranked = parts.select(
        *keys, "feature", "bucket", F.sum("n").over(ordered).alias("upto"), F.sum("n").over(group).alias("total"), F.lead("bucket").over(ordered).alias("next")
    )
    width = F.expr(f"shiftleft(1L, greatest(length(bin(bucket)) - {LEADING_BITS}, 0))")
    least = reduce(lambda rest, k: F.when(F.col("feature") == k, STEPS[k]).otherwise(rest), STEPS, F.lit(0)).cast("long")
    quartile = lambda part: F.min(F.when(F.col("upto") * 4 >= F.col("total") * part, F.col("bucket"))).over(group)
    spread = ranked.withColumn("low", quartile(1)).withColumn("mid", quartile(2)).withColumn("edge", F.col("bucket") + width - 1)
    wide = F.max(F.when(F.col("bucket") == F.col("mid"), width)).over(group)
    spread = spread.withColumn("reach", F.greatest(F.col("mid") - F.col("low"), wide, least) * FENCE)
    apart = (F.col("bucket") >= F.col("mid")) & (F.col("next").isNull() | (F.col("next") - F.col("edge") > F.col("reach")))
    found = spread.groupBy(*keys, "feature").agg(F.min(F.when(apart, F.col("edge"))).alias("bound"), F.max("total").alias("total"))
    return found.groupBy(*keys).agg(
        F.max("total").alias(f"{prefix}rows"),
        *[F.greatest(F.lit(guard).cast("long"), F.max(F.when(F.col("feature") == k, F.col("bound")))).alias(f"{prefix}{k}") for k, guard in GUARDS.items()],
    )


def thresholds(rows: DataFrame) -> DataFrame:
    """(``lang``, ``source``) -> a bound per feature, written: one row per pair that has a row passing the base rule."""
    own = durable(sketch(rows, ["lang", "source"]), "sketches")
    by_lang = merged(own, ["lang"])
    pair = bounds(own, ["lang", "source"], "s_")
    lang = bounds(by_lang, ["lang"], "l_").withColumnRenamed("lang", "l_lang")
    everything = bounds(merged(by_lang, []), [], "a_").first()  # a number per feature
    joined = pair.join(lang, F.col("lang").eqNullSafe(F.col("l_lang")), "left")

    def pick(k: str) -> Column:
        own_or_lang = F.when(F.col("s_rows") >= MIN_GROUP, F.col(f"s_{k}")).when(F.col("l_rows") >= MIN_GROUP, F.col(f"l_{k}"))
        return own_or_lang.otherwise(F.lit(everything[f"a_{k}"])).alias(f"__sa_{k}")

    return durable(joined.select(F.col("lang").alias("__sa_lang"), F.col("source").alias("__sa_source"), *map(pick, GUARDS)), "bounds")


def judged(rows: DataFrame) -> DataFrame:
    """A written table with ``lang``, ``source`` and ``F_`` -> the same rows with ``__sa_failed`` and ``__sa_kept``."""
    limits = thresholds(rows)
    same = F.col("lang").eqNullSafe(F.col("__sa_lang")) & F.col("source").eqNullSafe(F.col("__sa_source"))
    within = reduce(lambda a, b: a & b, [rate <= F.col(f"__sa_{k}") for k, rate in _rates().items()])
    joined = rows.join(limits, same, "left")
    return joined.withColumn("__sa_failed", _base_failed()).withColumn("__sa_kept", ~F.col("__sa_failed") & F.coalesce(within, F.lit(True)))


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``COUNTS``, ``base_failed``, ``kept``.

    A null or empty text has counts 0 and fails the base rule.  Null languages and sources form groups of their own.
    Repeated rows count as often as they come and get the same verdict.  An empty table gives no rows.
    """
    rows = durable(docs.select("doc_id", "lang", "source", features(whole_text()).alias(F_)), "features")
    return judged(rows).select(
        "doc_id", *[F.col(F_)[c].alias(c) for c in COUNTS], F.col("__sa_failed").alias("base_failed"), F.col("__sa_kept").alias("kept")
    )


@shielded
def keep_good(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that the rules reject."""
    rows = durable(docs.withColumn(F_, features(whole_text())), "documents")
    return judged(rows).where("__sa_kept").select(*columns_of(docs))
