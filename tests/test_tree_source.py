"""Filters that reach the source, listing by levels, and trees as a stream."""

import datetime as dt
import json
import os
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThan, StringContains, StringEndsWith, StringStartsWith

from srcatlas.registry.fixtures import remove_files, write_as_files
from srcatlas.session import new_shared_path
from srcatlas.sources import code_tree, fs
from srcatlas.sources.code_tree import CodeTreeReader, CodeTreeStreamReader, list_by_levels, list_code_files, scan_code_files
from srcatlas.sources.index_table import IndexTable
from srcatlas.streaming.reindex import watch_tree


@pytest.fixture
def trees(tmp_path):
    for repo in ("a", "b"):
        for folder in ("cmd", "cmd/deep/er", "cmdx", "lib", "lib/node_modules", "internal/api"):
            for i in range(3):
                p = tmp_path / repo / folder / f"f{i}.{'py' if i else 'go'}"
                p.parent.mkdir(parents=True, exist_ok=True)
                p.write_text("x" * (10 * i + len(folder)))
    return {"a": f"{tmp_path}/a", "b": f"{tmp_path}/b"}


WHERE = [
    "repo = 'a'", "repo in ('b', 'c')", "path like 'cmd/%'", "path like 'cmd%' and path like '%.go'", "path = 'lib/f1.py'", "path in ('cmd/f1.py', 'cmd/deep/er/f2.py')",
    "size > 20", "size >= 13 and size < 24", "repo = 'a' and path like '%deep%'", "repo = 'none'", "path like 'lib/f1.py%' and size <= 13", "repo = 'a' or size > 20", "path like ''", "size > 5 and _error is null",
]


@pytest.mark.parametrize("where", WHERE)
def test_pushed_filters_give_the_rows_of_the_filter(spark, trees, where):
    every = list_code_files(spark, trees).collect()
    rows = spark.createDataFrame(every, list_code_files(spark, trees).schema)
    key = lambda df: sorted((r.repo, r.path, r.size) for r in df.collect())
    assert key(list_code_files(spark, trees).where(where)) == key(rows.where(where))


def opened(monkeypatch, trees, filters):
    seen = []
    entries = code_tree.entries
    monkeypatch.setattr(code_tree, "entries", lambda folder: (seen.append(folder), entries(folder))[1])
    reader = CodeTreeReader({"roots": f'[["a", "{trees["a"]}"], ["b", "{trees["b"]}"]]', "numpartitions": "1"})
    left = list(reader.pushFilters(filters))
    parts = reader.partitions()
    rows = [r for p in parts for r in reader.read(p)]
    monkeypatch.undo()
    return {f.split("/a/")[-1].split("/b/")[-1].rsplit(os.sep, 1)[-1] if f.endswith(("/a", "/b")) else f.split("/a/")[-1].split("/b/")[-1] for f in seen}, rows, left


def test_a_pruned_directory_is_not_opened(monkeypatch, trees):
    folders, rows, left = opened(monkeypatch, trees, [EqualTo(("repo",), "a"), StringStartsWith(("path",), "cmd/de")])
    assert folders == {"a", "cmd", "cmd/deep", "cmd/deep/er"} and len(rows) == 3 and not left
    folders, rows, left = opened(monkeypatch, trees, [In(("path",), ("lib/f0.go", "cmdx/f1.py")), GreaterThan(("size",), 3)])
    assert folders == {"a", "b", "lib", "cmdx"} and {r[1] for r in rows} == {"cmdx/f1.py"}
    other = StringContains(("path",), "x")
    _, rows, left = opened(monkeypatch, trees, [StringEndsWith(("path",), ".go"), LessThan(("size",), 4), other])
    assert {r[1] for r in rows} == {"cmd/f0.go", "lib/f0.go"} and left == [other]


def test_the_plan_shows_the_pushed_filters(spark, trees, capsys):
    list_code_files(spark, trees).where("repo = 'a' and path like 'cmd/%' and size > 3").explain("formatted")
    plan = capsys.readouterr().out
    assert "PushedFilters: [EqualTo(repo,a), StringStartsWith(path,cmd/), GreaterThan(size,3)]" in plan
    assert "StartsWith" not in plan.split("Condition :")[1]


def test_a_scan_of_a_part(spark, trees):
    rows = scan_code_files(spark, trees, where="path like 'internal/%' and repo = 'b'").collect()
    assert sorted((r.repo, r.path, r.content) for r in rows) == [("b", f"internal/api/f{i}.{'py' if i else 'go'}", "x" * (10 * i + 12)) for i in range(3)]


def test_listing_by_levels(spark, tmp_path, trees):
    deep = tmp_path / "c" / "/".join("d" * 12)
    deep.mkdir(parents=True)
    for i in range(200):
        (deep / f"e{i}").mkdir()
        (deep / f"e{i}" / "x.py").write_text("x")
    roots = {**trees, "c": f"{tmp_path}/c", "gone": f"{tmp_path}/gone"}
    key = lambda df: sorted((r.repo, r.path, r.location, r.mtime, r.size, r._error) for r in df.collect())
    listing = list_by_levels(spark, roots, tasks=4)
    assert key(listing.fillna("", ["_error"]).fillna(0)) == key(list_code_files(spark, roots).fillna("", ["_error"]).fillna(0))
    # the 200 directories below one place are dealt to all tasks
    level = listing.where("path like '%/x.py'").select(F.input_file_name().alias("f")).groupBy("f").count().collect()
    assert len(level) == 4 and max(r["count"] for r in level) <= 75
    with pytest.raises(Exception, match="gone"):
        list_by_levels(spark, roots, mode="FAILFAST").count()


def rows_of(table):
    return sorted((r.repo, r.file, r.content) for r in table.read().collect())


def test_files_added_changed_and_removed_between_triggers_reach_the_index(spark, tmp_path):
    root = tmp_path / "r"
    (root / "d").mkdir(parents=True)
    for name in ("a.py", "d/b.py", "d/c.py"):
        (root / name).write_text(f"first {name}")
    table, log = IndexTable(spark, new_shared_path(spark, "table"), buckets=4), new_shared_path(spark, "log")

    def trigger():
        watch_tree(spark, {"r": str(root)}, table, log, F.expr("interval 20 days")).awaitTermination()
        return rows_of(table)

    assert trigger() == [("r", n, f"first {n}") for n in ("a.py", "d/b.py", "d/c.py")]
    version = table.version()
    assert trigger() == rows_of(table) and table.version() == version
    (root / "a.py").write_text("second")
    os.utime(root / "a.py", (time.time() + 5, time.time() + 5))
    os.remove(root / "d" / "b.py")
    (root / "e").mkdir()
    (root / "e" / "new.go").write_text("new")
    assert trigger() == [("r", "a.py", "second"), ("r", "d/c.py", "first d/c.py"), ("r", "e/new.go", "new")]
    assert table.version() == version + 1 and isinstance(table.state().first().mtime, dt.datetime)


def test_a_file_of_one_long_line_is_read_in_linear_time(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "one.py").write_bytes(b"x" * (64 << 20))
    start = time.perf_counter()
    assert sum(map(len, code_tree._lines(str(tmp_path / "r" / "one.py")))) == 64 << 20
    assert time.perf_counter() - start < 2


def test_roots_as_a_table(spark, tmp_path):
    """As many repositories as a table holds, none of them named by the driver; the same rows as from a dictionary, errors included."""
    roots = {}
    for i in range(60):
        roots[f"p{i}"] = f"{tmp_path}/p{i}"
        if i % 7:
            (tmp_path / f"p{i}" / "sub").mkdir(parents=True)
            (tmp_path / f"p{i}" / "go.mod").write_text(f"module {i}")
            (tmp_path / f"p{i}" / "sub" / "a.py").write_text("x = 1")
    table = spark.createDataFrame([(n, r + "/" * (len(n) % 2)) for n, r in roots.items()], "repo string, root string")
    wanted = sorted(map(tuple, list_code_files(spark, roots, names=["go.mod"]).collect()), key=repr)
    assert len(wanted) == 51 * 2 + 9
    for lists in (list_code_files, list_by_levels):
        assert sorted(map(tuple, lists(spark, table, names=["go.mod"]).collect()), key=repr) == wanted
    files = scan_code_files(spark, table, names=["go.mod"], where="path = 'go.mod'")
    assert sorted(r.content for r in files.collect()) == sorted(f"module {i}" for i in range(60) if i % 7)
    with pytest.raises(Exception, match="No such file"):
        list_code_files(spark, table, mode="FAILFAST").collect()


def test_a_stream_deals_directories_by_name_and_lists_in_columns(monkeypatch, trees, tmp_path):
    """Whoever deals the subtrees asks for no file's size or time; the rows are those of a scan, errors included."""
    os.symlink(tmp_path / "a" / "lib", tmp_path / "b" / "linked")
    options = {"roots": json.dumps([*trees.items(), ("gone", f"{tmp_path}/gone")]), "numpartitions": "8"}
    stream, scan = CodeTreeStreamReader(options), CodeTreeReader(options)
    with monkeypatch.context() as m:
        m.setattr(code_tree, "entries", lambda folder: pytest.fail(f"{folder}: files are asked for"))
        parts = stream.partitions({"asked": 0}, {"asked": 1})
    assert len(parts) == 8 and sum(len(p.items) for p in parts) == 2 * 8 + 1  # with lib's node_modules left out
    monkeypatch.setattr(code_tree, "LISTED_AT_ONCE", 2)
    batches = [b for p in parts for b in stream.read(p)]
    assert {type(b) for b in batches} == {pa.RecordBatch} and max(b.num_rows for b in batches) == 2
    found = [tuple(row.values()) for b in batches for row in b.to_pylist()]
    utc = lambda row: (*row[:3], row[3] and row[3].astimezone(dt.timezone.utc), *row[4:])
    assert sorted(found, key=repr) == sorted((utc(r) for p in scan.partitions() for r in scan.read(p)), key=repr)
    assert len(found) == 2 * 5 * 3 + 1 and [r[5][:14] for r in found if r[3] is None] == ["failed to list"]
    assert list(stream.read(None)) == []


def test_a_file_that_is_written_again_is_written_over(spark, files, tmp_path, monkeypatch):
    """It is not emptied first, so that nothing waits for the disk; what is left of a longer one is cut off."""
    write_as_files(files({"d/a.py": "first", "d/e/b.py": "b"}), str(tmp_path))
    write_as_files(files({"d/a.py": "second"}), str(tmp_path))
    assert [(tmp_path / "r" / p).read_text() for p in ("d/a.py", "d/e/b.py")] == ["second", "b"]
    place, opened, raw = tmp_path / "over", [], os.open
    monkeypatch.setattr(os, "open", lambda path, flags, *a, **k: (opened.append((str(path), flags & os.O_TRUNC)), raw(path, flags, *a, **k))[1])
    for data in (b"first", b"longer", b"less", b"", b"", b"x" * 100_000, b"y"):
        if place.exists():
            os.utime(place, (1, 1))
        fs.write_bytes(str(place), data)
        assert place.read_bytes() == data and place.stat().st_mtime > 1
    assert [o for o in opened if o[0] == str(place)] == [(str(place), 0)] * 7
    remove_files(files({"d/a.py": "", "none.py": ""}), str(tmp_path))
    assert not (tmp_path / "r" / "d" / "a.py").exists()
    made, makedirs = [], os.makedirs
    monkeypatch.setattr(os, "makedirs", lambda *a, **k: (made.append(a[0]), makedirs(*a, **k)))
    for i in range(3):
        fs.write_bytes(f"file:{tmp_path}/new/f{i}", b"x")
    assert made == [f"{tmp_path}/new"] and sorted(os.listdir(tmp_path / "new")) == ["f0", "f1", "f2"]


def test_files_are_read_in_parts_of_a_batch(tmp_path, monkeypatch):
    """Rows keep their columns wherever a batch is cut, next to files that cannot be read."""
    rows = []
    for i in range(7):
        (tmp_path / f"f{i}").write_bytes(b"\xff" + b"x" * i)
        error = "failed to list: told" if i == 2 else None
        rows.append({"repo": None if i == 1 else "r", "path": f"f{i}", "location": f"{tmp_path}/f{i}", "mtime": dt.datetime(2024, 1, 1 + i, tzinfo=dt.timezone.utc), "size": i + 1, "_error": error})
    os.remove(tmp_path / "f4")
    listed = pa.RecordBatch.from_pylist(rows, schema=pa.schema(code_tree._LISTED))
    monkeypatch.setattr(code_tree, "READ_BATCH_CHARS", 4)
    batches = list(code_tree._read_batches(False)(iter([listed, listed.slice(0, 0), listed.slice(5)])))
    assert [b.num_rows for b in batches] == [4, 2, 1, 1, 1]
    read = [r for b in batches for r in b.to_pylist()]
    for row, was in zip(read, rows + rows[5:], strict=True):
        i = int(was["path"][1:])
        assert [row[c] for c in ("repo", "path", "mtime", "size")] == [was[c] for c in ("repo", "path", "mtime", "size")]
        assert row["content"] == (None if i in (2, 4) else "\ufffd" + "x" * i)
        assert (row["_error"] or "")[:22] == {2: "failed to list: told", 4: "failed to read file: ["}.get(i, "")
    with pytest.raises(FileNotFoundError):
        list(code_tree._read_batches(True)(iter([listed])))
