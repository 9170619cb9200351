"""Eligibility, batches, vectors and their return to chunks."""

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F

from srcatlas.functions.hashed_bag import MAX_KNOWN, Buckets, bucket_counts, hashed_bag
from srcatlas.functions.text import embeddable, normalize, skip_reason
from srcatlas.operators.chunk import paragraph_chunks, with_paragraph_chunks
from srcatlas.operators.embed import (
    attach_vectors, distinct_texts, embed_batches, embed_coverage, embed_eligibility, embed_texts,
)
from srcatlas.plans.indexing import code_embeddings, error_report, file_errors, index_files, index_stats
from srcatlas.schemas import CHUNKS
from srcatlas.session import BATCH_BYTES

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def length_embedder(batches):
    for b in batches:
        keep = b[~b.text.str.startswith("skip")]
        yield pd.DataFrame({"text": keep.text, "embedding": [[float(len(t))] for t in keep.prepared]})


def test_normalize_and_reasons(files):
    cases = {
        "\n  \n  a\n\n": ("  a\n\n", None),
        "x" * 32771: ("x" * 32771, None),
        "x" * 32772: ("x" * 32772, "long"),
        " \n\t\u3000": ("", "blank"),
        "": ("", "blank"),
        "\n" * 50000 + " a": (" a", None),
        "a\n b": ("a\n b", None),
    }
    df = files({str(i): t for i, t in enumerate(cases)})
    c = F.col("content")
    for r in df.select("content", normalize(c).alias("n"), skip_reason(c).alias("w"), embeddable(c).alias("e")).collect():
        assert (r.n, r.w) == cases[r.content]
        assert r.e == (r.w is None)


def test_batches_count_embeddable_chunks(files):
    df = with_paragraph_chunks(files({"f": "\n\n".join(["p" * 9] * 45), "g": "x" * 40000 + "\n\nabc"}), 9)
    rows = embed_batches(df).collect()
    assert sorted(r.batch for r in rows if r.file == "f") == [0] * 20 + [1] * 20 + [2] * 5
    assert [(r.chunk_idx, r.batch) for r in rows if r.file == "g"] == [(1, 0)]
    assert embed_batches(df, 0).count() == 46


def test_hashed_bag(files):
    import hashlib

    text = "Alpha beta alpha_1 beta, ALPHA"
    row = files({"f": text}).select(bucket_counts(F.col("content")).alias("c"), hashed_bag(F.col("content")).alias("v")).first()
    want = [0] * 64
    for w in ("alpha", "beta", "alpha_1", "beta", "alpha"):
        want[int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 64] += 1
    assert row.c == want
    assert abs(sum(x * x for x in row.v) - 1) < 1e-6


def test_user_embedder_and_skewed_copies(spark, files):
    df = files([("r", f"f{i}", "same text" if i % 3 else f"text {i}") for i in range(600)] + [("r", "s", "skip me")])
    got = index_files(df, length_embedder)
    rows = got.collect()
    assert got.columns == CHUNKS.names
    assert len(rows) == 600 and all(r.embedding == [float(len(r.content))] for r in rows)
    chunks = paragraph_chunks(df)
    cover = {r.file: (r.valid, r.embedded, r.failed) for r in embed_coverage(chunks, got).collect()}
    assert cover["s"] == (1, 0, True) and cover["f1"] == (1, 1, False)
    assert {r.text: r.copies for r in distinct_texts(chunks).collect()}["same text"] == 400


def test_attach_is_a_subset(files):
    chunks = paragraph_chunks(files({"a": "one\n\ntwo", "b": "two", "c": "three"}), 3)
    vectors = embed_texts(distinct_texts(chunks.where("content <> 'three'")))
    got = {(r.file, r.chunk_idx) for r in attach_vectors(chunks, vectors).collect()}
    assert got == {("a", 0), ("a", 1), ("b", 0)}


def test_errors_and_stats(files):
    df = files({"ok": "a", "blank": " \n", "long": "x" * 40000, "mixed": "y" * 40000 + "\n\nz"})
    assert [(r.file, r.error) for r in file_errors(df).collect()] == [("long", "no valid texts to embed")]
    stats = index_stats(df).first()
    assert (stats.files_found, stats.chunks_saved) == (4, 2)
    many = files({f"f{i:02d}": "x" * 40000 for i in range(13)})
    report = error_report(file_errors(many)).collect()
    assert len(report) == 10 and {(r.total, r.not_shown) for r in report} == {(13, 3)}
    assert report[0].file == "f00"


def test_eligibility_counts(files):
    chunks = files([("r", "f", "a"), ("r", "f", " "), ("r", "f", "x" * 40000)]).withColumnRenamed("path", "file")
    r = embed_eligibility(chunks).first()
    assert (r.texts, r.valid, r.skipped_blank, r.skipped_long) == (3, 1, 1, 1)


def test_code_embeddings_keep_metadata(files):
    df = files({"d/a.py": "def f():\n    pass\n", "b.txt": "x\n\ny\n"})
    for embedder in (None, length_embedder):
        rows = code_embeddings(df, embedder).collect()
        meta = sorted((r.file, r.metadata.filename, r.metadata.function, r.metadata.start_line) for r in rows)
        assert meta == [("b.txt", "b.txt", None, 1), ("b.txt", "b.txt", None, 3), ("d/a.py", "a.py", "f", 1)]


def test_default_index_has_no_shuffle(files):
    plan = index_files(files({"f": "a"}))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_hashed_bag_of_many_words_equals_a_plain_one(spark):
    """Words that come often, long ones, others than ASCII, a text without words and NULL, over several batches."""
    import hashlib
    import math
    import random
    import re

    rng = random.Random(2)
    words = ["alpha", "BETA", "x" * 90, "a_1", "\u212aelvin", "\u0130d", "stra\u00dfe", "42", "\u4e2d\u6587"]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 40))) for _ in range(200)] + ["", "--", None]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, text string")
    got = df.select("n", F.lower("text").alias("low"), bucket_counts(F.col("text"), 100).alias("c"), hashed_bag(F.col("text"), 100).alias("v")).collect()
    assert len(got) == len(texts)
    for r in got:
        if r.low is None:
            assert r.c == [None] * 100 and r.v == [None] * 100
            continue
        want = [0] * 100
        for w in re.findall("[a-z0-9_]+", r.low):
            want[int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 100] += 1
        norm = math.sqrt(sum(x * x for x in want))
        assert r.c == want and r.v == [float(np.float32(x / norm)) if norm else 0.0 for x in want]


def test_a_task_remembers_few_words():
    """Digests are not computed again for words that were met, and what is remembered has a bound."""
    known = Buckets(64)
    assert known["alpha"] == known["alpha"] and list(known) == ["alpha"]
    for i in range(MAX_KNOWN + 10):
        known[str(i)]
    known["x" * 1000]
    assert len(known) <= MAX_KNOWN and max(map(len, known)) <= 64


def test_batches_of_long_texts_are_bounded_by_bytes(spark):
    """Not by rows alone: 3,000 texts of 10,000 bytes came as one batch of 60 MB, with what is prepared of them."""

    def sizes(batches):
        for b in batches:
            yield pd.DataFrame({"text": b.text, "embedding": [[float(b.text.str.len().sum() + b.prepared.str.len().sum())]] * len(b)})

    texts = spark.range(0, 3000, 1, 1).select(F.concat(F.repeat(F.lit("0123456789"), 1000), "id").alias("text"))
    got = embed_texts(texts, sizes).select(F.count("*").alias("n"), F.max(F.col("embedding")[0]).alias("most")).first()
    assert got.n == 3000 and got.most <= 1.2 * BATCH_BYTES
