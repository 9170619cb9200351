"""Language of web pages: text, declared markup language, address suffix and host, fused by Bayes' rule.

Text: likelihoods of hashed byte trigrams, counted over all labelled documents.  Declared language and address suffix:
how often pages of each text language carry them, by grouped counts with add-one smoothing.  Host: a prior smoothed towards
that of its domain, which is smoothed towards that of all pages; a page's own vote is taken out of its host's counts.
The log posterior is the sum of the four.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcatlas.llm.html_text import _host, read_page
from srcatlas.session import durable

BUCKETS = 1 << 14
#: Trigrams of a text overlap and are not independent: its evidence is the mean likelihood times at most this many.
TEXT_WEIGHT = 60
#: A page votes for its text language in the grouped counts if that is this likely by text alone.
SURE = 0.9
PRIOR_ROWS = 5.0
#: Languages that are told apart: those with most documents, ties by name.  Others of a dirty column are no evidence.
MAX_LANGS = 200
_PIECE = 1 << 20


def _trigrams(text: str) -> np.ndarray:
    """Counts of the hashed byte trigrams of a whole text in lower case, a piece at a time."""
    data, counts = np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), np.uint8), np.zeros(BUCKETS, np.int64)
    for low in range(0, max(0, len(data) - 2), _PIECE):
        x = data[low : low + _PIECE + 2].astype(np.uint32)
        mixed = (x[:-2] * 961 + x[1:-1] * 31 + x[2:]) * np.uint32(2654435761)
        counts += np.bincount(mixed >> np.uint32(18), minlength=BUCKETS)
    return counts


def train(docs: DataFrame) -> DataFrame:
    """``lang``, ``bucket``, ``n`` over all documents of the MAX_LANGS most frequent languages: one partial sum per task, language and bucket."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"]):
                held[lang] = held.get(lang, 0) + _trigrams(text)
        for lang, counts in held.items():
            used = np.flatnonzero(counts)
            yield pd.DataFrame({"lang": lang, "bucket": used.astype("int32"), "n": counts[used]})

    known = docs.where("lang is not null and text is not null").select("lang", "text")
    most = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGS).collect()
    known = known.where(F.col("lang").isin([r.lang for r in most]))
    return known.mapInPandas(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def model(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and log likelihoods (BUCKETS x languages, MAX_LANGS at most)."""
    rows = train(docs).toPandas()
    langs = sorted(rows["lang"].unique())
    counts = np.ones((BUCKETS, len(langs)))
    for i, lang in enumerate(langs):
        own = rows[rows["lang"] == lang]
        counts[own["bucket"].to_numpy(), i] += own["n"].to_numpy()
    return langs, np.log(counts / counts.sum(0)).astype("float32")


def text_likelihoods(text: str, table: np.ndarray) -> list[float]:
    """Log likelihood per language, zero for a text without trigrams."""
    counts = _trigrams(text) if text.strip() else np.zeros(BUCKETS, np.int64)
    total = counts.sum()
    if not total:
        return [0.0] * table.shape[1]
    used = np.flatnonzero(counts)
    return (counts[used] @ table[used] / total * min(total, TEXT_WEIGHT)).astype(float).tolist()


def _declared() -> Column:
    """Primary part of the page's declared language, null if none."""
    found = F.regexp_extract(F.coalesce("html", F.lit("")), r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?\s*([a-z]{2,3})", 1)
    return F.nullif(F.lower(found), F.lit(""))


def _suffix() -> Column:
    """Top-level label of the host, with a first path step of two letters if there is one: ``org/fr``."""
    step = F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([A-Za-z]{2})(?:[/?#]|$)", 1)
    return F.concat_ws("/", F.substring_index("host", ".", -1), F.lower(step))


def _likelihood(rows: DataFrame, key: str, langs: list[str]) -> DataFrame:
    """``key`` -> ``{key}_l``: log share of each language's sure pages that carry it, add-one smoothed."""
    counts = rows.groupBy(key).agg(*[F.sum(F.when(F.col("text_lang") == x, 1).otherwise(0)).alias(f"n{i}") for i, x in enumerate(langs)])
    totals = counts.agg(F.count("*").alias("values"), *[F.sum(f"n{i}").alias(f"t{i}") for i in range(len(langs))]).first()
    shares = [F.log((F.col(f"n{i}") + 1) / F.lit(float((totals[f"t{i}"] or 0) + (totals["values"] or 0) + 1))) for i in range(len(langs))]
    return durable(counts.select(F.col(key).alias(f"{key}_k"), F.array(*shares).alias(f"{key}_l")), key)


def _counts(rows: DataFrame, key: str, langs: list[str]) -> DataFrame:
    return durable(
        rows.groupBy(F.col(key).alias(f"{key}_k")).agg(F.array(*[F.sum(F.when(F.col("text_lang") == x, 1.0).otherwise(0.0)) for x in langs]).alias(f"{key}_n")), key
    )


def page_languages(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """One row per row of ``pages``: ``page_id``, ``url``, ``lang``, ``score`` (posterior), ``text_lang``, ``declared``, ``suffix``.

    A null or empty page is judged by the other evidence; a missing declaration or suffix is a value of its own.  Ties go
    to the first language by name.  Without any labelled document, ``lang`` is null.
    """
    langs, table = model(docs)
    if not langs:
        nothing = F.lit(None).cast("string")
        return pages.select(
            "page_id", "url", nothing.alias("lang"), F.lit(0.0).alias("score"), nothing.alias("text_lang"), _declared().alias("declared"), nothing.alias("suffix")
        )

    @F.pandas_udf("array<double>")
    def by_text(sources: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in sources:
            yield pd.Series([text_likelihoods("\n".join(t for t, _ in read_page(s).blocks), table) for s in batch], dtype=object)

    names = F.array(*map(F.lit, langs))
    scored = pages.select("page_id", "url", _host().alias("host"), _declared().alias("declared"), by_text(F.coalesce("html", F.lit(""))).alias("ll"))
    best = F.array_max("ll")
    sure = F.lit(1.0) / F.aggregate("ll", F.lit(0.0), lambda a, x: a + F.exp(x - best)) >= SURE
    scored = scored.withColumn("text_lang", F.when(sure, F.element_at(names, F.array_position("ll", best).cast("int"))))
    domain = F.regexp_extract("host", r"([^.]+\.[^.]+\.[^.]+|[^.]+\.[^.]+|[^.]*)$", 1)
    rows = durable(scored.withColumn("suffix", _suffix()).withColumn("domain", domain), "evidence")

    total = rows.agg(*[F.sum(F.when(F.col("text_lang") == x, 1).otherwise(0)).alias(f"n{i}") for i, x in enumerate(langs)]).first()
    everywhere = [(total[i] or 0) + 1.0 for i in range(len(langs))]
    base = F.array(*[F.lit(x / sum(everywhere)) for x in everywhere])
    own = F.transform(names, lambda x: F.coalesce((x == F.col("text_lang")).cast("double"), F.lit(0.0)))

    def smoothed(counts: Column, towards: Column) -> Column:
        left = F.zip_with(counts, own, lambda n, o: n - o)
        rows_left = F.aggregate(left, F.lit(0.0), lambda a, x: a + x)
        return F.zip_with(left, towards, lambda n, p: (n + p * PRIOR_ROWS) / (rows_left + PRIOR_ROWS))

    joined = rows
    for part in (_likelihood(rows, "declared", langs), _likelihood(rows, "suffix", langs), _counts(rows, "domain", langs), _counts(rows, "host", langs)):
        key = part.columns[0].removesuffix("_k")
        joined = joined.join(part, F.col(key).eqNullSafe(F.col(f"{key}_k")))
    joined = joined.withColumn("by_domain", smoothed(F.col("domain_n"), base)).withColumn("prior", smoothed(F.col("host_n"), F.col("by_domain")))
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    fused = joined.withColumn("post", add(add(F.col("ll"), F.transform("prior", lambda p: F.log(p))), add(F.col("declared_l"), F.col("suffix_l"))))
    top = F.array_max("post")
    return fused.select(
        "page_id",
        "url",
        F.element_at(names, F.array_position("post", top).cast("int")).alias("lang"),
        (F.lit(1.0) / F.aggregate("post", F.lit(0.0), lambda a, x: a + F.exp(x - top))).alias("score"),
        "text_lang",
        "declared",
        "suffix",
    )
