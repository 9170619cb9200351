"""Snapshots of an index: what a refresh leaves alone, crashed builds, readers and writers beside each other."""

import datetime as dt
import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from srcatlas.plans.indexing import index_files, refresh_table
from srcatlas.sources.index_store import index_exists, load_or_build, write_index
from srcatlas.sources.index_table import ChangedMeanwhile, IndexTable

SCHEMA = "repo string, path string, content string, mtime timestamp"


def at(hour):
    return dt.datetime(2024, 1, 1, hour)


def made(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def rows_of(df):
    return sorted((r.repo, r.file, r.chunk_idx, r.content) for r in df.collect())


def files_of(table):
    """Every data file with its size and time."""
    root = f"{table.path}/data"
    return {os.path.join(d, n): os.stat(os.path.join(d, n)).st_mtime_ns for d, _, names in os.walk(root) for n in names if n.startswith("part-")}


def refresh(table, files, hour):
    return refresh_table(table, files, F.lit(at(hour)), F.expr("interval 20 days"), max_bytes=1)


@pytest.fixture
def first(spark):
    return [("r", f"d/f{i}.py", f"a{i}\n\nb{i}", at(1)) for i in range(60)] + [("s", "f0.py", "x", at(1))]


def test_a_refresh_leaves_other_buckets_alone(spark, tmp_path, first):
    table = IndexTable(spark, str(tmp_path / "index"), buckets=16)
    assert refresh(table, made(spark, first), 2) == 1
    assert rows_of(table.read()) == rows_of(index_files(made(spark, first), max_bytes=1))
    before, old = files_of(table), table.manifest()
    second = [("r", "d/f7.py", "new", at(3)), *[r for r in first if r[1] not in ("d/f7.py", "d/f9.py")], ("t", "added.py", "y", at(3))]
    assert refresh(table, made(spark, second), 4) == 2
    assert rows_of(table.read()) == rows_of(index_files(made(spark, second), max_bytes=1))
    assert rows_of(table.read(1)) == rows_of(index_files(made(spark, first), max_bytes=1))
    changed = {key for key, build in table.manifest().items() if old.get(key) != build}
    assert 2 <= len(changed) <= 6 and {n: t for n, t in files_of(table).items() if n in before} == before
    state = {(r.repo, r.path): (r.mtime, r.indexed_at) for r in table.state().collect()}
    assert len(state) == len(second) and state["r", "d/f7.py"] == (at(3), at(4)) and state["r", "d/f8.py"] == (at(1), at(2))
    assert refresh(table, made(spark, second), 5) == 2  # nothing to do, no snapshot
    assert IndexTable(spark, table.path, buckets=3).buckets == 16


def test_a_reader_keeps_its_snapshot_until_it_is_vacuumed(spark, tmp_path, first):
    table = IndexTable(spark, str(tmp_path / "index"), buckets=4)
    refresh(table, made(spark, first), 2)
    reader, wanted = table.read(), rows_of(table.read())
    refresh(table, made(spark, first[:5]), 3)
    assert rows_of(reader) == wanted and len(rows_of(table.read())) == 10
    table.vacuum(keep=2)
    assert rows_of(reader) == wanted
    refresh(table, made(spark, first[:4]), 4)
    table.vacuum()
    assert table.versions() == [3] and len(rows_of(table.read())) == 8
    live = {f"{build}/{kind}/bucket={b}" for (kind, b), build in table.manifest().items()}
    assert {"/".join(os.path.dirname(n).rsplit("/", 3)[1:]) for n in files_of(table)} == live


def test_all_files_may_go(spark, tmp_path, first):
    table = IndexTable(spark, str(tmp_path / "index"), buckets=4)
    refresh(table, made(spark, first), 2)
    refresh(table, made(spark, []), 3)
    assert table.read().count() == 0 and table.state().count() == 0 and table.buckets == 4
    refresh(table, made(spark, first[:1]), 4)
    assert len(rows_of(table.read())) == 2


def test_a_second_writer_is_refused(spark, tmp_path, first):
    table = IndexTable(spark, str(tmp_path / "index"), buckets=4)
    refresh(table, made(spark, first), 2)
    with pytest.raises(ChangedMeanwhile):
        table._commit(table.manifest(), 0)
    assert table.version() == 1 and [n for n in os.listdir(f"{table.path}/snapshots") if n.startswith(".")] == []


def dying(batches):
    for batch in batches:
        yield batch.assign(embedding=[[1.0]] * len(batch))[["text", "embedding"]]
        raise RuntimeError("lost")


def test_a_build_that_died_is_built_again(spark, tmp_path, first):
    files = made(spark, first)
    table, plain = IndexTable(spark, str(tmp_path / "table")), str(tmp_path / "plain")
    for load in (table.load_or_build, lambda build: load_or_build(spark, plain, build)):
        with pytest.raises(PySparkException):
            load(lambda: index_files(files, dying))
        assert len(rows_of(load(lambda: index_files(files)))) == len(first)
        assert len(rows_of(load(lambda: 1 / 0))) == len(first)  # built only once
    # what a killed job leaves: files that were never committed
    half = tmp_path / "half"
    write_index(index_files(files), str(half))
    os.remove(half / "_SUCCESS")
    assert not index_exists(spark, str(half)) and index_exists(spark, plain)


def test_files_that_cannot_be_read_stay_as_they_are(spark, tmp_path, first):
    table = IndexTable(spark, str(tmp_path / "index"), buckets=4)
    refresh(table, made(spark, first[:3]), 2)
    listing = made(spark, [(r, p, None, at(3)) for r, p, _, _ in first[:3]]).drop("content")

    def read(part):
        bad = F.col("path").endswith("f1.py")
        return part.withColumn("content", F.when(~bad, "fresh")).withColumn("_error", F.when(bad, "failed to read file"))

    refresh_table(table, listing, F.lit(at(4)), F.expr("interval 20 days"), max_bytes=1, read=read)
    assert {(r[1], r[3]) for r in rows_of(table.read())} == {("d/f0.py", "fresh"), ("d/f1.py", "a1"), ("d/f1.py", "b1"), ("d/f2.py", "fresh")}
    assert {r.path: r.mtime for r in table.state().collect()}["d/f1.py"] == at(1)
