"""The stream with state: late, repeated, deleted and expired versions give what a batch over all of them gives."""

import datetime as dt
import random

from pyspark.sql import functions as F

from srcatlas.plans.indexing import index_files
from srcatlas.registry.queries import _incoming
from srcatlas.session import names_in, new_shared_path
from srcatlas.streaming.reindex import current_index
from srcatlas.streaming.versions import newest_versions, start_stateful_reindex

SCHEMA = "repo string, path string, mtime timestamp, content string"


def at(minute):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)


def rows_of(df):
    return sorted((r.repo, r.file, r.chunk_idx, r.content) for r in df.collect())


def feed(spark, batches, ttl, start):
    """Run ``start`` once for every batch of rows, over one growing folder."""
    source = new_shared_path(spark, "in")
    for batch in batches:
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        start(spark.readStream.schema(SCHEMA).parquet(source)).awaitTermination()


def batch_result(spark, batches, minutes):
    """The newest version of each file that is neither a deletion nor older than the latest version by more than the limit."""
    rows = [r for b in batches for r in b]
    last = max(r[2] for r in rows)
    newest = {}
    for repo, path, mtime, content in rows:
        best = newest.get((repo, path))
        if best is None or (mtime, content is None, content or "") > (best[2], best[3] is None, best[3] or ""):
            newest[repo, path] = (repo, path, mtime, content)
    kept = [(r, p, c) for r, p, m, c in newest.values() if c is not None and (minutes is None or m > last - dt.timedelta(minutes=minutes))]
    return spark.createDataFrame(kept, "repo string, path string, content string")


def test_stream_with_state_equals_batch(spark):
    batches = [
        [("r", "a", at(1), "one\n\ntwo"), ("r", "b", at(1), "b"), ("r", "c", at(30), "c"), ("r", "old", at(0), "old")],
        [("r", "a", at(50), "new"), ("r", "b", at(20), None), ("r", "a", at(3), "between"), ("r", "a", at(50), "new")],
        [("r", "a", at(40), "late"), ("s", "a", at(70), "x"), ("r", "c", at(30), "c")],
        [("s", "b", at(85), "y"), ("r", "b", at(84), "back")],
    ]
    for ttl, minutes in (("60 minutes", 60), (None, None)):
        target, log = new_shared_path(spark, "target"), new_shared_path(spark, "log")
        feed(spark, batches, ttl, lambda s: start_stateful_reindex(s, target, log, ttl, max_bytes=3))
        got = rows_of(current_index(spark, target))
        assert got == rows_of(index_files(batch_result(spark, batches, minutes), max_bytes=3))
        assert ("r", "old", 0, "old") not in got or ttl is None


def test_random_versions_equal_batch(spark):
    rng = random.Random(4)
    batches, clock = [], 0
    for _ in range(5):
        rows = []
        for _ in range(40):
            clock += rng.randint(0, 2)
            rows.append(("r", f"f{rng.randint(0, 25)}", at(max(0, clock - rng.choice([0, 0, 5, 30, 90]))), rng.choice([None, "a", "b", "a\n\nc", "d"])))
        batches.append(rows)
    unique = {}
    for i, b in enumerate(batches):  # versions of one file with one time are told apart by arrival in a stream
        batches[i] = [unique.setdefault((r[1], r[2]), r) for r in b if (r[1], r[2]) not in unique]
    target, log = new_shared_path(spark, "target"), new_shared_path(spark, "log")
    feed(spark, batches, "60 minutes", lambda s: start_stateful_reindex(s, target, log, "60 minutes"))
    assert rows_of(current_index(spark, target)) == rows_of(index_files(batch_result(spark, batches, 60)))


def test_only_changes_leave_the_state(spark):
    batches = [
        [("r", "a", at(1), "x"), ("r", "b", at(1), "x"), ("r", "gone", at(1), None), ("r", "no time", None, "x")],
        [("r", "a", at(1), "x"), ("r", "b", at(0), "older"), ("r", "c", at(3), "x")],
        [("r", "a", at(9), "y"), ("r", "b", at(9), None)],
        [("r", "d", at(300), "z")],
        [("r", "c", at(2), "late")],
    ]
    out, log = new_shared_path(spark, "out"), new_shared_path(spark, "log")

    def keep(df, batch):
        df.withColumn("batch", F.lit(batch)).write.mode("append").parquet(out)

    def start(stream):
        rows = newest_versions(stream, "1 hour").writeStream.outputMode("update").foreachBatch(keep)
        return rows.option("checkpointLocation", log).trigger(availableNow=True).start()

    feed(spark, batches, "1 hour", start)
    got = sorted((r.path, r.cause, r.content) for r in spark.read.parquet(out).collect())
    assert got == [
        ("a", "changed", "y"), ("a", "expired", None), ("a", "new", "x"), ("b", "deleted", None), ("b", "new", "x"), ("c", "expired", None),
        ("c", "new", "x"), ("d", "new", "z"), ("gone", "deleted", None),
    ]


def test_versions_are_written_by_as_many_tasks_as_they_are_read_by(spark):
    """Four tasks wrote them, whatever their size; the number of micro-batches stays."""
    rows = spark.range(0, 4000, 1, 24).select(F.lit("r").alias("repo"), F.col("id").cast("string").alias("path"), F.col("id").alias("version"))
    for batches in (2, 4):
        path, seen = new_shared_path(spark, "in"), []
        stream = _incoming(rows, path, batches)
        assert len([n for n in names_in(spark, path) if n.endswith(".parquet")]) == 24
        query = stream.writeStream.foreachBatch(lambda df, n: seen.append(df.count())).option("checkpointLocation", new_shared_path(spark, "log"))
        query.trigger(availableNow=True).start().awaitTermination()
        assert len(seen) == batches and sum(seen) == 4000
