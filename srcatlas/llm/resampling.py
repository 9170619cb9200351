"""Importance resampling towards a target distribution, ranked by parallel sorting by regular sampling.

Features are runs of one to three words, counted in BUCKETS hashed buckets over all documents and over all target texts.  A
bucket's gain is the scaled log ratio of its two smoothed shares; a document's weight is the sum of the gains of its features,
looked up with numpy arrays, and its score adds Gumbel noise drawn from its ``doc_id``, so the highest scores are a weighted
draw without replacement.

Ranks (Shi and Schaeffer, "Parallel Sorting by Regular Sampling", 1992): every task sorts its rows into a run; every STEP-th
row of each run is a sample, and every so-many-th sample in order is a splitter.  Runs count their rows between splitters, so
prefix sums of these counts give the first rank of each segment before any row moves.  Only segments that reach below the
number of rows to draw are exchanged; each is sorted by its task, and the place in the segment plus the prefix is the rank.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from srcatlas.llm.common import columns_of, free_name, whole_text
from srcatlas.session import durable

BUCKETS = 10_000
GRAMS = 3
SCALE = 1000
DRAW_PERCENT = 5
MIN_WORDS = 20

#: One sample for so many rows of a run, and the most samples the driver sorts; of more, samples are taken again.
STEP = 256
DRIVER_SAMPLES = 1 << 16
#: Rows of a segment, and the most segments: with more than their product of rows, segments grow.
SEGMENT_ROWS = 1 << 20
MAX_SEGMENTS = 1 << 14

_PIECE = 1 << 20
_LONG_WORD = 64
_PLACE = (1 << 33) - 1
_LAST_ID = (1 << 63) - 1

# Lower-cases A-Z; every other ASCII character but 0-9 and a-z becomes a space.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


@lru_cache(maxsize=1)
def _shifts() -> np.ndarray:
    """[n, k, b]: what byte k of a CRC-32, with value b, contributes after n more bytes are read; n up to _LONG_WORD.

    The CRC of a text AB is that of B xor that of A carried over the length of B, so CRCs of word runs need no text.
    """
    step = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)
    out = np.empty((_LONG_WORD + 1, 4, 256), np.uint32)
    for k in range(4):
        out[0, k] = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
    for n in range(1, _LONG_WORD + 1):
        out[n] = (out[n - 1] >> np.uint32(8)) ^ step[out[n - 1] & np.uint32(255)]
    return out


def _carried(crcs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRCs carried over ``lengths`` further bytes."""
    table, left = _shifts(), lengths
    while True:
        n = np.minimum(left, _LONG_WORD)
        crcs = table[n, 0, crcs & 255] ^ table[n, 1, crcs >> 8 & 255] ^ table[n, 2, crcs >> 16 & 255] ^ table[n, 3, crcs >> 24]
        left = left - n
        if not left.any():
            return crcs


def _pieces(data: bytes) -> Iterator[list[bytes]]:
    """Words of a text of any length, a bounded piece at a time."""
    data = data.translate(_TABLE)
    start = 0
    while start < len(data):
        end = start + _PIECE
        end = data.find(b" ", end) if end < len(data) else len(data)
        end = len(data) if end < 0 else end
        yield data[start:end].split()
        start = end


def buckets(data: bytes) -> Iterator[np.ndarray]:
    """Buckets of all features of one UTF-8 text, some at a time; the first array of a piece holds its single words."""
    words_before: list[bytes] = []
    for words in _pieces(data):
        fresh, words = len(words), words_before + words
        if not fresh:
            continue
        crcs = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        spaced = _carried(crcs, np.ones(len(words), np.int64)) ^ np.uint32(zlib.crc32(b" "))  # of each word and a space
        grams = crcs
        yield crcs[len(words_before):] % BUCKETS
        for n in range(2, GRAMS + 1):
            # a run of n words is the run of n - 1 words from the same place, a space and the word after it
            heads = spaced[: len(words) - 1] if n == 2 else _carried(grams[:-1], np.ones(len(grams) - 1, np.int64)) ^ np.uint32(zlib.crc32(b" "))
            if len(words) < n:
                break
            grams = _carried(heads, sizes[n - 1 :]) ^ crcs[n - 1 :]
            # runs that end in words seen before are counted already
            yield grams[max(0, len(words_before) - n + 1):] % BUCKETS
        words_before = words[-(GRAMS - 1):]


def bucket_counts(texts: DataFrame) -> DataFrame:
    """``texts`` -> ``bucket``, ``n`` over all features of all rows; a task sends a row per bucket at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for text in batch["text"]:
                for found in buckets(text.as_py()):
                    held += np.bincount(found, minlength=BUCKETS)
        used = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(held[used], pa.int64())], ["bucket", "n"])

    counted = texts.select(whole_text().cast("binary").alias("text")).mapInArrow(count, "bucket int, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def _counts(texts: DataFrame) -> list[int]:
    found = dict.fromkeys(range(BUCKETS), 0) | {r.bucket: r.n for r in bucket_counts(texts).collect()}  # BUCKETS rows at most
    return [found[b] for b in range(BUCKETS)]


def gains(source: list[int], target: list[int]) -> list[int]:
    """The gain of each bucket from its counts in the documents and in the target texts."""
    total, wanted = sum(source), sum(target)
    return [math.floor(SCALE * math.log(((t + 1) * (total + BUCKETS)) / ((s + 1) * (wanted + BUCKETS)))) for s, t in zip(source, target)]


def with_weights(docs: DataFrame, gain: list[int], id_column: str, names: list[str]) -> DataFrame:
    """``docs`` with four columns of these names: words, features, weight (long) and the score that adds the noise."""
    n_words, n_features, weight, score = names

    @F.pandas_udf("n_words long, n_features long, weight long")
    def weigh(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        table = np.array(gain, np.int64)
        for batch in texts:
            rows = []
            for text in batch:
                parts = list(buckets(text))
                features = sum(map(len, parts))
                # of n words there are n + (n - 1) + (n - 2) features
                rows.append((_words(features), features, sum(int(table[p].sum()) for p in parts)))
            yield pd.DataFrame(rows, columns=["n_words", "n_features", "weight"]).astype("int64")

    found = free_name(docs, "weighed")
    weighed = docs.withColumn(found, weigh(whole_text().cast("binary")))
    out = weighed.select(*columns_of(docs), *[F.col(f"{found}.{k}").alias(n) for k, n in zip(("n_words", "n_features", "weight"), names)])
    return out.withColumn(score, F.col(weight) + noise(F.col(id_column)))


def _words(features: int) -> int:
    """How many words give so many features."""
    return features if features < 2 else 2 if features == 3 else features // 3 + 1


def noise(doc_id: Column) -> Column:
    """Scaled Gumbel noise of a document, drawn from the SHA-256 of its number (of an empty text where it is null)."""
    digits = F.substring(F.sha2(F.concat(F.lit("42:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8)
    share = (F.conv(digits, 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-SCALE * F.log(-F.log(share)))


# Ranks by regular sampling.


def sorted_runs(rows: DataFrame, order: list[Column], uid: str) -> DataFrame:
    """``rows`` sorted within each task and written, with ``uid``: the run above the lower 33 bits, the place below."""
    return durable(rows.sortWithinPartitions(*order).withColumn(uid, F.monotonically_increasing_id()), "runs")


def regular_splitters(keys: DataFrame, segments: int, step: int = STEP, driver_samples: int = DRIVER_SAMPLES) -> list[tuple[int, int, int]]:
    """At most ``segments`` - 1 keys that cut the rows into segments of about one size.

    ``keys``: written runs with ``a``, ``b``, ``uid`` (longs, ascending).  Every ``step``-th row of a run is a sample; more
    samples than the driver takes are runs themselves, of which samples are taken again.
    """
    place = F.col("uid").bitwiseAND(F.lit(_PLACE))
    samples = keys.where(place % step == step - 1).select("a", "b", "uid")
    samples = durable(samples, "samples")
    n = samples.count()
    if n > driver_samples:
        runs = samples.withColumnRenamed("uid", "was").sortWithinPartitions("a", "b", "was")
        runs = durable(runs.withColumn("uid", F.monotonically_increasing_id()), "samples")
        found = regular_splitters(runs, segments, step, driver_samples)
        # the keys of these samples in the rows' own numbers: a handful, looked up by the samples' numbers
        wanted = [u for _, _, u in found]
        return sorted(tuple(r) for r in runs.where(F.col("uid").isin(wanted)).select("a", "b", "was").collect()) if wanted else []
    ordered = sorted(tuple(r) for r in samples.collect())  # at most driver_samples rows of three numbers
    return [ordered[n * i // segments] for i in range(1, min(segments, n))] if n else []


def _packed(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Three longs as bytes that sort like them."""
    cells = np.stack([a, b, c], axis=1).astype(np.int64) ^ np.int64(-(1 << 63))
    return np.frombuffer(cells.astype(">i8").tobytes(), "S24")


def ranked(
    rows: DataFrame, score: str, tie: str, eligible: Column, percent: int = DRAW_PERCENT, out: str = "rank", segments: int | None = None, step: int = STEP,
    driver_samples: int = DRIVER_SAMPLES,
) -> DataFrame:
    """``rows`` with ``out``: 1, 2, 3 ... for the ``percent`` highest scores of the eligible rows (rounded down), else null.

    Ties go to the smaller ``tie`` (null last), then to either of repeated rows.  A row moves only if its segment may hold a
    rank to be drawn; what the driver sees are samples, splitters and a count per segment, all with a fixed bound.
    """
    spark = rows.sparkSession
    uid, fits, a, b = (free_name(rows, x) for x in ("uid", "fits", "a", "b"))
    keyed = rows.withColumn(fits, F.coalesce(eligible, F.lit(False))).withColumn(a, -F.col(score)).withColumn(b, F.coalesce(F.col(tie), F.lit(_LAST_ID)))
    runs = sorted_runs(keyed, [F.col(fits).desc(), F.col(a), F.col(b)], uid)
    able = runs.where(F.col(fits)).select(F.col(a).alias("a"), F.col(b).alias("b"), F.col(uid).alias("uid"))
    total = able.count()
    wanted = total * percent // 100
    plain = [runs[f"`{c}`"] for c in (x.replace("`", "``") for x in rows.columns)]
    if not wanted:
        return runs.select(*plain, F.lit(None).cast("long").alias(out))
    if segments is None:
        shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
        segments = min(MAX_SEGMENTS, max(shuffles, total // SEGMENT_ROWS + 1))
    cuts = regular_splitters(able, segments, step, driver_samples)

    @F.pandas_udf("int")
    def segment_of(xs: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        bounds = _packed(*(np.array(c, np.int64) for c in zip(*cuts))) if cuts else np.zeros(0, "S24")
        for x in xs:
            yield pd.Series(np.searchsorted(bounds, _packed(*(s.to_numpy(np.int64) for s in x)), "right"), dtype="int32")

    segment, first = free_name(rows, "segment"), free_name(rows, "first")
    placed = durable(runs.withColumn(segment, F.when(F.col(fits), segment_of(a, b, uid))), "segments")
    counts = {r[0]: r[1] for r in placed.where(F.col(fits)).groupBy(segment).count().collect()}  # at most MAX_SEGMENTS rows
    firsts, before = [], 0
    for s in sorted(counts):
        if before < wanted:
            firsts.append((s, before))
        before += counts[s]
    prefix = F.broadcast(spark.createDataFrame(firsts, f"`{segment}` int, `{first}` long"))
    last = firsts[-1][0]
    rest = placed.where(~F.col(fits) | (F.col(segment) > last)).select(*columns_of(rows), F.lit(None).cast("long").alias(out))
    inside = F.row_number().over(Window.partitionBy(segment).orderBy(a, b, uid)) + F.col(first)
    moved = placed.where(F.col(fits) & (F.col(segment) <= last)).join(prefix, segment).withColumn(out, inside.cast("long"))
    return rest.union(moved.select(*columns_of(rows), F.when(F.col(out) <= wanted, F.col(out)).alias(out)))


def importance_ranks(docs: DataFrame, target: DataFrame, percent: int = DRAW_PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_features``, ``weight``, ``score`` and ``rank`` (null if not drawn).

    A null or empty text has no features, weight 0 and is never drawn.  A null ``doc_id`` draws its noise as an empty one and
    comes last of equal scores.  Repeated rows are ranked one after the other.  Without target texts all counts of
    theirs are 0.  An empty table gives no rows.
    """
    gain = gains(_counts(docs), _counts(target))
    scored = with_weights(docs.select("doc_id", "text"), gain, "doc_id", ["n_words", "n_features", "weight", "score"]).drop("text")
    return ranked(scored, "score", "doc_id", F.col("n_words") >= min_words, percent).select("doc_id", "n_features", "weight", "score", "rank")


def resample(docs: DataFrame, target: DataFrame, percent: int = DRAW_PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """The drawn rows of ``docs``, all columns, with their rank under a name of its own (``rank`` if that is free).

    Cases as in ``importance_ranks``.
    """
    gain = gains(_counts(docs), _counts(target))
    names = [free_name(docs, x) for x in ("n_words", "n_features", "weight", "score")]
    rank = "rank" if "rank" not in {c.lower() for c in docs.columns} else free_name(docs, "rank")
    drawn = ranked(with_weights(docs, gain, "doc_id", names), names[3], "doc_id", F.col(names[0]) >= min_words, percent, rank)
    return drawn.where(F.col(rank).isNotNull()).select(*columns_of(docs), rank)
