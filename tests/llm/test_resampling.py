import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from srcatlas.llm.resampling import BUCKETS, buckets, importance_ranks, ranked, regular_splitters, resample, sorted_runs


def slow_features(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    grams = [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
    return len(words), Counter(zlib.crc32(g.encode()) % BUCKETS for g in grams)


def slow_ranks(docs, target, percent=5, min_words=20):
    own = [slow_features(t) for _, t in docs]
    s, t = Counter(), Counter()
    for _, c in own:
        s.update(c)
    for x in target:
        t.update(slow_features(x)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + BUCKETS) / ((s[b] + 1) * (T + BUCKETS))))
    rows = []
    for (i, _), (n, c) in zip(docs, own):
        weight = sum(gain(b) * k for b, k in c.items())
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, sum(c.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in rows if r[5] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = k
    return [tuple(r[:5]) for r in rows]


def key(r):
    return tuple((x is None, x or 0) for x in r)


def test_buckets_match_the_features_of_plain_words():
    rng = random.Random(1)
    bits = ["a", "Bc", "é", "漢字", " ", ".", "\n", "0", "9", "Z", "@", "{", "\x7f", "İ", "x" * 70, "y" * 200, "ab cd", "\x85"]
    for _ in range(1500):
        text = "".join(rng.choices(bits, k=rng.randint(0, 16)))
        found = Counter(np.concatenate([np.zeros(0, int), *buckets(text.encode())]).tolist())
        assert found == slow_features(text)[1], text


def test_a_text_longer_than_a_piece_has_the_same_features(monkeypatch):
    from srcatlas.llm import resampling

    monkeypatch.setattr(resampling, "_PIECE", 7)
    rng = random.Random(2)
    for _ in range(300):
        text = " ".join(rng.choice(["a", "bb", "ccc", "dddddddddd", "..", ""]) for _ in range(rng.randint(0, 30)))
        found = Counter(np.concatenate([np.zeros(0, int), *buckets(text.encode())]).tolist())
        assert found == slow_features(text)[1], text


def test_ranks_match_brute_force(spark, make_docs):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)] + ["É", "ZED"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(0, 60)))) for i in range(400)] + [(7, "again " * 30), (7, "again " * 30), (None, "no id " * 20)]
    docs += [(900, None), (901, "")]
    target = [" ".join(rng.choices(words[:10], k=15)) for _ in range(20)] + [None]
    items = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = [tuple(r) for r in importance_ranks(make_docs(docs), items).collect()]
    assert sorted(got, key=key) == sorted(slow_ranks(docs, target), key=key)
    drawn = resample(make_docs(docs), items)
    assert drawn.columns[:-1] == make_docs([]).columns
    wanted = {(r[0], r[4]) for r in slow_ranks(docs, target) if r[4]}
    assert {(r.doc_id, r["rank"]) for r in drawn.collect()} == wanted


def test_regular_sampling_with_ties_many_runs_and_samples_of_samples(spark):
    rng = random.Random(4)
    rows = [(rng.choice([1, 2, 3, rng.randint(-50, 50)]), i if i % 50 else None, i % 7 > 0) for i in range(3000)] + [(9, 5, True)] * 40
    df = spark.createDataFrame(rows, "score long, id long, ok boolean").repartition(11)
    for segments, step, held in ((9, 3, 50), (40, 2, 10), (1, 256, 10), (300, 2, 4000)):
        got = ranked(df, "score", "id", F.col("ok"), 37, segments=segments, step=step, driver_samples=held)
        able = sorted((r for r in rows if r[2]), key=lambda r: (-r[0], r[1] is None, r[1] or 0))
        wanted = [(k, r[0], r[1]) for k, r in enumerate(able[: 37 * len(able) // 100], 1)]
        found = sorted((r["rank"], r.score, r.id) for r in got.collect() if r["rank"])
        assert found == wanted
        assert got.count() == len(rows)


def test_segments_are_of_about_one_size(spark):
    runs = sorted_runs(spark.range(20_000).select((F.xxhash64("id") % 5000).alias("a"), F.col("id").alias("b")).repartition(8), ["a", "b"], "uid")
    cuts = regular_splitters(runs, 10, step=16)
    rows = sorted((r.a, r.b, r.uid) for r in runs.collect())
    edges = [0, *(sum(r < c for r in rows) for c in cuts), len(rows)]
    assert len(cuts) == 9 and max(b - a for a, b in zip(edges, edges[1:])) <= 2000 + 8 * 16


def test_defined_results_for_messy_and_empty_tables(spark, messy, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    got = importance_ranks(messy, none).collect()
    assert len(got) == messy.count() and sum(r["rank"] is not None for r in got) == 0
    assert {r.n_features for r in got if r.doc_id in (2, 3, 4)} == {0}
    assert importance_ranks(empty, none).collect() == [] and resample(empty, messy).collect() == []
    clash = messy.withColumn("rank", F.lit(1)).withColumn("__sa_uid", F.lit(2)).withColumn("__sa_score", F.lit(3))
    assert resample(clash, none, 100, 1).select("__sa_uid", "`rank`").distinct().collect() == [(2, 1)]
