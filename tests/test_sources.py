"""Scanning trees, storing an index, incremental and streaming re-indexing."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from srcatlas.operators.incremental import changed_files
from srcatlas.plans.indexing import file_errors, index_files, refresh_index, refresh_state
from srcatlas.operators.chunk import line_chunks
from srcatlas.session import durable, new_shared_path, scratch
from srcatlas.sources import code_tree, fs
from srcatlas.sources.code_tree import list_code_files, read_files, scan_code_files
from srcatlas.sources.index_store import load_or_build, read_index, read_index_json, write_index, write_index_json
from srcatlas.streaming.reindex import compact, current_index, index_batch, start_reindex


@pytest.fixture
def tree(tmp_path):
    files = {
        "one/src/__init__.py": b"",
        "one/src/a.py": "é\n".encode(),
        "one/src/deep/er/b.go": b"package b",
        "one/build/x.py": b"no",
        "one/src/node_modules/y.js": b"no",
        "one/build.py": b"yes",
        "one/UP.PY": b"no",
        "one/.hidden.js": b"yes",
        "one/bad.ts": b"a\xe2\x82b\xff",
        "one/README.md": b"no",
        "dist/z.rs": b"yes",
    }
    for name, data in files.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    return tmp_path


def test_scan(spark, tree):
    want = {
        ("one", "src/__init__.py"): "", ("one", "src/a.py"): "é\n", ("one", "src/deep/er/b.go"): "package b",
        ("one", "build.py"): "yes", ("one", ".hidden.js"): "yes", ("one", "bad.ts"): "a\ufffd\ufffdb\ufffd",
        ("dist", "z.rs"): "yes",
    }
    roots = [f"{tree}/one", f"{tree}/dist/"]
    for task_bytes in (1, 1 << 30):
        rows = read_files(list_code_files(spark, roots), task_bytes=task_bytes).collect()
        assert {(r.repo, r.path): r.content for r in rows} == want
        assert all(r._error is None for r in rows)
    row = next(r for r in rows if r.path == "src/a.py")
    assert (row.ext, row.size) == (".py", 3)
    assert abs(row.mtime.replace(tzinfo=dt.timezone.utc).timestamp() - os.stat(tree / "one/src/a.py").st_mtime) < 90000


def test_unreadable_files(spark, tree):
    os.symlink(tree / "nowhere", tree / "one" / "gone.py")
    os.symlink(tree / "dist", tree / "one" / "linked")
    df = scan_code_files(spark, f"{tree}/one")
    bad = [r for r in df.collect() if r._error]
    assert len(bad) == 1 and "gone.py" in bad[0]._error and bad[0].content is None
    assert [r.file for r in file_errors(df).collect()] == [bad[0].path]
    assert df.where("path like 'linked%'").count() == 0
    assert df.where("_error is null").count() == 6
    with pytest.raises(Exception, match="gone.py"):
        scan_code_files(spark, f"{tree}/one", mode="FAILFAST").collect()


def test_other_file_systems(tmp_path):
    where = f"file://{tmp_path}/d/e/x.py"
    fs.write_bytes(where, b"text")
    assert fs.read_bytes(where) == b"text"
    os.mkdir(tmp_path / "d" / "sub")
    for listed in (fs.remote_entries(f"file://{tmp_path}/d"), fs.entries(f"{tmp_path}/d"), fs.entries(f"file:{tmp_path}/d")):
        assert sorted((name, is_dir) for name, is_dir, _, _ in listed) == [("e", True), ("sub", True)]
    (name, is_dir, mtime, size), = fs.remote_entries(f"file://{tmp_path}/d/e")
    assert (name, is_dir, size) == ("x.py", False, 4) and mtime > 0


def rows(df):
    return sorted((r.repo, r.file, r.chunk_idx, r.content, tuple(r.embedding)) for r in df.collect())


def test_index_round_trips(spark, files, tmp_path):
    index = index_files(files([("r", "a.py", "x\n\ny"), ("r", "b.py", 'q "é" \\ \u2028'), ("s", "a.py", "z")]), max_bytes=1)
    want = rows(index)
    for i, options in enumerate(({}, {"clustered": True}, {"partition_by": ["repo"]})):
        write_index(index, f"{tmp_path}/p{i}", **options)
        assert rows(read_index(spark, f"{tmp_path}/p{i}")) == want
    write_index_json(index, f"{tmp_path}/j")
    assert rows(read_index_json(spark, f"{tmp_path}/j", array=False)) == want


def test_json_array_index(spark, tmp_path):
    chunks = [{"file": f, "content": c, "embedding": [1.5, 0.25]} for f, c in (("a", "1"), ("b", "2"), ("a", "3"))]
    (tmp_path / "index.json").write_text(json.dumps(chunks, indent=2))
    got = read_index_json(spark, f"{tmp_path}/index.json", repo="r").orderBy("file", "chunk_idx").collect()
    assert [(r.repo, r.file, r.chunk_idx, r.content, r.embedding) for r in got] == [
        ("r", "a", 0, "1", [1.5, 0.25]), ("r", "a", 1, "3", [1.5, 0.25]), ("r", "b", 0, "2", [1.5, 0.25]),
    ]


def test_index_on_first_use(spark, files, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return index_files(files({"a.py": "x"}))

    for _ in range(2):
        assert load_or_build(spark, f"{tmp_path}/idx", build).count() == 1
    assert calls == [1]


def test_changed_files(spark):
    at = lambda h: dt.datetime(2024, 1, 1, h)
    current = spark.createDataFrame(
        [("r", "same", at(1)), ("r", "newer", at(5)), ("r", "old stamp", at(1)), ("r", "new", at(1)), ("q", "same", at(1))],
        "repo string, path string, mtime timestamp",
    )
    state = spark.createDataFrame(
        [("r", "same", at(1), at(9)), ("r", "newer", at(2), at(9)), ("r", "old stamp", at(1), at(3)), ("r", "gone", at(1), at(9))],
        "repo string, path string, mtime timestamp, indexed_at timestamp",
    )
    got = changed_files(current, state, F.lit(at(10)), F.expr("interval 2 hours")).collect()
    assert {(r.repo, r.path): r.status for r in got} == {
        ("r", "newer"): "modified", ("r", "old stamp"): "expired", ("r", "new"): "new", ("q", "same"): "new", ("r", "gone"): "deleted",
    }


def test_refresh_equals_rebuild(spark, files):
    at = lambda h: dt.datetime(2024, 1, 1, h)
    old = spark.createDataFrame([("r", "a", "1\n\n2", at(1)), ("r", "b", "b", at(1)), ("r", "c", "c", at(1))],
                                "repo string, path string, content string, mtime timestamp")
    new = spark.createDataFrame([("r", "a", "3", at(2)), ("r", "b", "b", at(1)), ("s", "c", "x", at(2))],
                                "repo string, path string, content string, mtime timestamp")
    state = old.select("repo", "path", "mtime", F.lit(at(3)).alias("indexed_at"))
    now = F.lit(at(4))
    changes = changed_files(new, state, now, F.expr("interval 5 hours"))
    got = refresh_index(index_files(old, max_bytes=1), new, changes, max_bytes=1)
    assert rows(got) == rows(index_files(new, max_bytes=1))
    after = {(r.repo, r.path): (r.mtime, r.indexed_at) for r in refresh_state(state, changes, now).collect()}
    assert after == {("r", "a"): (at(2), at(4)), ("r", "b"): (at(1), at(3)), ("s", "c"): (at(2), at(4))}


def test_stream_equals_batch(spark, tmp_path):
    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    schema = "repo string, path string, mtime timestamp, content string"
    batches = [
        [("r", "a", at(1), "one\n\ntwo"), ("r", "b", at(1), "b"), ("r", "c", at(1), "c")],
        [("r", "a", at(5), "new"), ("r", "b", at(2), None), ("r", "a", at(3), "between")],
        [("r", "a", at(4), "late"), ("r", "c", at(2), " \n"), ("s", "a", at(1), "x")],
    ]
    source, target, log = (new_shared_path(spark, x) for x in ("in", "target", "log"))
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        start_reindex(stream, target, log, max_bytes=3).awaitTermination()
    got = rows(current_index(spark, target))
    newest = spark.createDataFrame([("r", "a", "new"), ("r", "c", " \n"), ("s", "a", "x")], "repo string, path string, content string")
    assert got == rows(index_files(newest, max_bytes=3))
    compact(spark, target, f"{tmp_path}/compact")
    assert rows(read_index(spark, f"{tmp_path}/compact")) == got
    for _ in range(2):
        compact(spark, target)
        assert rows(current_index(spark, target)) == got
    assert [x for x in os.listdir(f"{target.removeprefix('file:')}/chunks") if x.startswith("batch")] == ["batch=-2"]
    more = [("r", "b", at(9), "back"), ("r", "c", at(1), "older"), ("s", "a", at(9), None)]
    spark.createDataFrame(more, schema).coalesce(1).write.mode("append").parquet(source)
    start_reindex(spark.readStream.schema(schema).parquet(source), target, log, max_bytes=3).awaitTermination()
    newest = spark.createDataFrame([("r", "a", "new"), ("r", "b", "back"), ("r", "c", " \n")], "repo string, path string, content string")
    assert rows(current_index(spark, target)) == rows(index_files(newest, max_bytes=3))


def test_names_of_roots_and_extra_files(spark, tree):
    os.makedirs(tree / "other" / "one")
    (tree / "other" / "one" / "go.mod").write_bytes(b"module x")
    with pytest.raises(ValueError, match="both named one"):
        list_code_files(spark, [f"{tree}/one", f"{tree}/other/one"])
    named = {"first": f"{tree}/one", "second, too": f"{tree}/other/one"}
    got = {(r.repo, r.path) for r in scan_code_files(spark, named, names=["go.mod"]).collect()}
    assert ("first", "build.py") in got and ("second, too", "go.mod") in got and len(got) == 7


def test_many_directories_few_tasks(spark, tmp_path):
    for i in range(3000):
        (tmp_path / "root" / f"d{i // 100}" / f"e{i}").mkdir(parents=True)
    (tmp_path / "root" / "d7" / "e700" / "a.py").write_text("x")
    listing = list_code_files(spark, f"{tmp_path}/root", tasks=16)
    assert listing.rdd.getNumPartitions() <= 16 and [r.path for r in listing.collect()] == ["d7/e700/a.py"]


@pytest.mark.parametrize("limit", [1, 7, 50])
def test_line_chunks_of_files_that_are_not_held(spark, files, tmp_path, monkeypatch, limit):
    texts = ["", "\n", "a", "a\n", "a\r\n\r\nb\r", "\n\n", "x" * 40 + "\ny", "é\n" * 30, "one\n\ntwo  \n\n\nthree", "\r"]
    (tmp_path / "r").mkdir()
    for i, text in enumerate(texts):
        (tmp_path / "r" / f"f{i}.py").write_bytes(text.encode())
    monkeypatch.setattr(code_tree, "STREAM_BYTES", 3)
    got = code_tree.stream_line_chunks(list_code_files(spark, f"{tmp_path}/r"), limit).collect()
    want = line_chunks(files([("r", f"f{i}.py", t) for i, t in enumerate(texts)]), limit).collect()
    assert sorted((r.file, r.chunk_idx, r.content) for r in got) == sorted((r.file, r.chunk_idx, r.content) for r in want)


def test_what_could_not_be_listed_is_not_deleted(spark):
    at = dt.datetime(2024, 1, 1)
    state = spark.createDataFrame([(r, p, at, at) for r, p in (("r", "d/a"), ("r", "d/e/b"), ("r", "dd"), ("q", "d/a"), ("s", "x/y"), ("r", "bad.py"))],
                                  "repo string, path string, mtime timestamp, indexed_at timestamp")
    files = spark.createDataFrame([("r", "d", None, "no list"), ("s", "", None, "no root"), ("r", "bad.py", at, "no read"), ("r", "new", at, None)],
                                  "repo string, path string, mtime timestamp, _error string")
    got = changed_files(files, state, F.lit(at), F.expr("interval 2 hours")).collect()
    assert {(r.repo, r.path): r.status for r in got} == {("r", "dd"): "deleted", ("q", "d/a"): "deleted", ("r", "new"): "new"}


def test_stream_readers_see_written_versions_only(spark):
    target = new_shared_path(spark, "target")
    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    batch = lambda rows: spark.createDataFrame(rows, "repo string, path string, mtime timestamp, content string")
    index_batch(batch([("r", "a", at(1), "old"), ("r", "b", at(1), "b"), ("r", "b", at(1), None)]), 0, target, None, 100)
    before = rows(current_index(spark, target))
    assert [r[3] for r in before] == ["old"]
    # a batch that has written its chunks, not yet its versions
    index_batch(batch([("r", "a", at(2), "new")]), 1, target, None, 100)
    hidden = f"{target}/versions/batch=1"
    os.rename(hidden.removeprefix("file:"), f"{target.removeprefix('file:')}/held")
    assert rows(current_index(spark, target)) == before
    os.rename(f"{target.removeprefix('file:')}/held", hidden.removeprefix("file:"))
    assert [r[3] for r in rows(current_index(spark, target))] == ["new"]
    assert current_index(spark, target, since=F.lit(at(3))).count() == 0


def test_scratch_tables_go(spark):
    with scratch(spark):
        kept = durable(spark.range(3), "x")
        assert kept.count() == 3
        place = kept.inputFiles()[0]
    assert not os.path.exists(place.removeprefix("file://"))
