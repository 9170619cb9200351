"""Source of code files: directory trees in, one row per file out.

Spark's own file sources skip names that start with ``_`` or ``.`` (``__init__.py``), so listing and
reading are done by executors here.  The driver opens only as many upper directories as
are needed to deal subtrees to all tasks.  The listing itself is a table of paths without contents, which is
spread evenly before any file is opened; so a large repository or directory does not hold up one task.
"""

from __future__ import annotations

import codecs
import datetime as dt
import json
import time
from collections import deque
from collections.abc import Iterator, Sequence
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    StringEndsWith,
    StringStartsWith,
)
from pyspark.sql.types import StructType

from srcatlas.functions.tables import CODE_EXTENSIONS, SKIPPED_DIRS
from srcatlas.functions.text import extension
from srcatlas.schemas import FILES, SCANNED_FILES
from srcatlas.session import durable
from srcatlas.sources.fs import entries, folders, read_blocks, read_bytes

#: Files are handed over in batches of about this many characters; a larger file is its own batch.
READ_BATCH_CHARS = 4 << 20
#: Bytes a reading task gets on average.
READ_TASK_BYTES = 128 << 20
#: Bytes of a file that are held at a time where it is cut into chunks while it is read.
STREAM_BYTES = 1 << 20
#: Rows of a listing that are handed over at a time.
LISTED_AT_ONCE = 4096
#: Roots of a table that a listing task gets on average.
ROOTS_PER_TASK = 4096
LISTING = "repo string, path string, location string, mtime timestamp, size bigint, _error string"


class Subtrees(InputPartition):
    """Directories of one task, each with its repository, the repository's root, and whether to go below it."""

    def __init__(self, items: list[tuple[str, str, str, bool]]):
        self.items = items


class Wanted:
    """What a query asks of a listing: tests on ``repo``, ``path`` and ``size`` that rows must pass, and directories that can hold none."""

    def __init__(self):
        self.repos: frozenset | None = None
        self.paths: frozenset | None = None
        self.prefixes: list[str] = []
        self.suffixes: list[str] = []
        self.least, self.most = None, None

    def take(self, test: Filter) -> bool:
        """Remember a filter; False if it is of a kind that Spark has to test."""
        column, value = test.__dict__.get("attribute"), test.__dict__.get("value")
        if column in (("repo",), ("path",)) and isinstance(test, (EqualTo, In)):
            name = f"{column[0]}s"
            values = frozenset([value] if isinstance(test, EqualTo) else value)
            held = getattr(self, name)
            setattr(self, name, values if held is None else held & values)
        elif column == ("path",) and isinstance(test, StringStartsWith):
            self.prefixes.append(value)
        elif column == ("path",) and isinstance(test, StringEndsWith):
            self.suffixes.append(value)
        elif column == ("size",) and isinstance(test, (GreaterThan, GreaterThanOrEqual)):
            least = value + isinstance(test, GreaterThan)
            self.least = least if self.least is None else max(self.least, least)
        elif column == ("size",) and isinstance(test, (LessThan, LessThanOrEqual)):
            most = value - isinstance(test, LessThan)
            self.most = most if self.most is None else min(self.most, most)
        else:
            return False
        return True

    def repo(self, name: str) -> bool:
        return self.repos is None or name in self.repos

    def file(self, path: str, size: int | None) -> bool:
        """Whether a row with this path and size passes; a row without size (an error) fails any test of sizes, as in SQL."""
        if self.least is not None or self.most is not None:
            if size is None or (self.least is not None and size < self.least) or (self.most is not None and size > self.most):
                return False
        return (self.paths is None or path in self.paths) and all(map(path.startswith, self.prefixes)) and all(map(path.endswith, self.suffixes))

    def folder(self, path: str) -> bool:
        """Whether a directory (``""``: the root) is, holds or lies below something that passes."""
        below = f"{path}/" if path else ""
        near = all(below.startswith(p) or p.startswith(below) or path.startswith(p) for p in self.prefixes)
        return near and (self.paths is None or any(p.startswith(below) or p == path for p in self.paths))


class Listing:
    """How a tree is walked: which names are files of interest, which directories are opened, what is done about errors."""

    def __init__(self, options: dict):
        roots = json.loads(options.get("roots", "[]"))
        if not roots:
            raise ValueError("option 'roots' holds a JSON list of [repository, directory]")
        self.roots = [(name, root.rstrip("/")) for name, root in roots]
        self.names = frozenset(json.loads(options.get("names", "[]")))
        self.wanted = int(options.get("numpartitions", "64"))
        self.fail_fast = options.get("mode", "PERMISSIVE").upper() == "FAILFAST"
        self.asked = Wanted()

    def _is_code(self, name: str) -> bool:
        return name in self.names or ("." in name and "." + name.rsplit(".", 1)[1] in CODE_EXTENSIONS)

    def _opens(self, root: str, folder: str, name: str) -> bool:
        return name not in SKIPPED_DIRS and self.asked.folder(f"{folder}/{name}"[len(root) + 1 :])

    def subtrees(self) -> list[Subtrees]:
        """Open directories, upper ones first, until there are some subtrees for every task; then deal them out.

        Only names of directories are asked for: files are left to the tasks, and a directory may hold millions.
        """
        opened, waiting = [], deque((name, root, root) for name, root in self.roots if self.asked.repo(name))
        while waiting and len(opened) + len(waiting) < 4 * self.wanted:
            name, root, folder = waiting.popleft()
            opened.append((name, root, folder, False))
            try:
                below = [n for n in folders(folder) if self._opens(root, folder, n)]
            except OSError:
                below = []  # reported by the task that lists the directory
            waiting += [(name, root, f"{folder}/{n}") for n in below]
        items = opened + [(*w, True) for w in waiting]
        return [Subtrees(items[i :: self.wanted]) for i in range(min(self.wanted, len(items)))]

    def folder(self, repo: str, root: str, folder: str) -> Iterator[tuple[bool, tuple]]:
        """One directory: (True, row) of its files of interest, (False, place) of the directories to open in it."""
        try:
            for name, is_dir, mtime, size in entries(folder):
                if is_dir:
                    if self._opens(root, folder, name):
                        yield False, (repo, root, f"{folder}/{name}")
                elif self._is_code(name) and self.asked.file(f"{folder}/{name}"[len(root) + 1 :], size):
                    yield True, self._row(repo, root, f"{folder}/{name}", dt.datetime.fromtimestamp(mtime), size, None)
        except OSError as e:
            if self.fail_fast:
                raise
            if self.asked.file(folder[len(root) + 1 :], None):
                yield True, self._row(repo, root, folder, None, None, f"failed to list: {e}")

    def rows(self, part: Subtrees | None) -> Iterator[tuple]:
        """Rows of a task's directories; where there is nothing to list, Spark asks once without any."""
        for repo, root, start, recurse in part.items if part else ():
            pending = [start]
            while pending:
                for is_row, found in self.folder(repo, root, pending.pop()):
                    if is_row:
                        yield found
                    elif recurse:
                        pending.append(found[2])

    @staticmethod
    def _row(repo, root, where, mtime, size, error):
        return repo, where[len(root) + 1:], where, mtime, size, error


_LISTED = list(zip((c.split()[0] for c in LISTING.split(", ")), [pa.string()] * 3 + [pa.timestamp("us", tz="UTC"), pa.int64(), pa.string()]))


def _listed(row: tuple) -> dict:
    repo, path, location, mtime, size, error = row
    return dict(zip((n for n, _ in _LISTED), (repo, path, location, mtime.astimezone(dt.timezone.utc) if mtime else None, size, error)))


def _listed_batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Rows of a listing as Arrow batches, column by column."""
    schema = pa.schema(_LISTED)
    while held := list(islice(rows, LISTED_AT_ONCE)):
        columns = dict(zip(schema.names, zip(*held)))
        columns["mtime"] = [m.astimezone(dt.timezone.utc) if m else None for m in columns["mtime"]]
        yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


class CodeTreeReader(Listing, DataSourceReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Filters on repository, path (equal, prefix, suffix) and size are tested here; directories outside them are not opened."""
        return (f for f in filters if not self.asked.take(f))

    def partitions(self):
        return self.subtrees()

    def read(self, part: Subtrees):
        return self.rows(part)


class CodeTreeStreamReader(Listing, DataSourceStreamReader):
    """A listing of the whole tree per micro-batch; the offset is the time at which it was asked for."""

    def initialOffset(self) -> dict:
        return {"asked": 0}

    def latestOffset(self) -> dict:
        return {"asked": time.time_ns() // 1_000_000}

    def partitions(self, start: dict, end: dict):
        return self.subtrees() if start != end else []

    def read(self, part: Subtrees):
        return _listed_batches(self.rows(part))

    def commit(self, end: dict) -> None:
        pass


class CodeTreeSource(DataSource):
    """``spark.read.format("codetree").option("roots", '[["a", "/repos/a"], ["b", "/repos/b"]]')``: the listing, no contents.

    As a stream (``readStream``) every micro-batch is the whole listing at its time.
    """

    @classmethod
    def name(cls) -> str:
        return "codetree"

    def schema(self) -> str:
        return LISTING

    def reader(self, schema: StructType) -> CodeTreeReader:
        return CodeTreeReader(self.options)

    def streamReader(self, schema: StructType) -> CodeTreeStreamReader:
        return CodeTreeStreamReader(self.options)


def replace_byte(err: UnicodeError):
    """One replacement character per undecodable byte."""
    return "�", err.start + 1


def _read_batches(fail_fast: bool):
    fields = [("repo", pa.string()), ("path", pa.string()), ("mtime", pa.timestamp("us", tz="UTC")),
              ("size", pa.int64()), ("content", pa.string()), ("_error", pa.string())]
    schema = pa.schema(fields)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codecs.register_error("srcatlas_byte", replace_byte)
        for batch in batches:
            given = [batch[f.name].cast(f.type) for f in schema if f.name not in ("content", "_error")]
            errors, texts, held = batch["_error"].to_pylist(), [], 0
            for at, location in enumerate(batch["location"].to_pylist(), 1):
                text = None
                if errors[at - 1] is None:
                    try:
                        text = read_bytes(location).decode("utf-8", "srcatlas_byte")
                    except OSError as e:
                        if fail_fast:
                            raise
                        errors[at - 1] = f"failed to read file: {e}"
                texts.append(text)
                held += len(text or "")
                if held > READ_BATCH_CHARS or at == batch.num_rows:
                    first = at - len(texts)
                    read = [pa.array(x, pa.string()) for x in (texts, errors[first:at])]
                    yield pa.RecordBatch.from_arrays([c.slice(first, len(texts)) for c in given] + read, schema=schema)
                    texts, held = [], 0

    return rows


def named_roots(roots: str | list[str] | dict[str, str]) -> dict[str, str]:
    """Repository -> root.  A plain list names each root by its last part; two roots of one name are refused."""
    if isinstance(roots, dict):
        return roots
    roots = [roots] if isinstance(roots, str) else list(roots)
    named: dict[str, str] = {}
    for root in roots:
        name = root.rstrip("/").rsplit("/", 1)[-1]
        if name in named:
            raise ValueError(f"{named[name]} and {root} are both named {name}: give a dictionary of repository and root")
        named[name] = root
    return named


Roots = str | list[str] | dict[str, str] | DataFrame


def _options(roots: Roots, mode: str, names: Sequence[str], tasks: int) -> dict[str, str]:
    return {"roots": json.dumps(list(named_roots(roots).items())), "names": json.dumps(list(names)), "mode": mode, "numpartitions": str(tasks)}


def list_code_files(
    spark: SparkSession, roots: Roots, mode: str = "PERMISSIVE", names: Sequence[str] = (), tasks: int | None = None
) -> DataFrame:
    """``repo, path, location, mtime, size, _error`` of the code files below ``roots``, without contents.

    ``names``: file names taken besides those with an extension of code, such as manifests.  At most ``tasks`` tasks
    list (twice the cores if not given).  Filters on ``repo``, ``path`` (equal, prefix, suffix) and ``size`` reach the
    source: directories that they rule out are not opened.  ``roots`` may be a table ``repo, root``, for more repositories than
    a driver should name: it is dealt to tasks, and filters are then tested by Spark.
    """
    if isinstance(roots, DataFrame):
        return _list_table(roots, mode, names, tasks)
    spark.dataSource.register(CodeTreeSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    options = _options(roots, mode, names, tasks or spark.sparkContext.defaultParallelism * 2)
    return spark.read.format("codetree").options(**options).load()


def _list_table(roots: DataFrame, mode: str, names: Sequence[str], tasks: int | None) -> DataFrame:
    """The listing of a table of roots: every task walks the roots that it is dealt."""
    walk = Listing(_options({"": "/"}, mode, names, 1))  # its own root is not walked

    def open_roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named = (pair for batch in batches for pair in zip(batch["repo"].to_pylist(), batch["root"].to_pylist()))
        places = ((repo, root.rstrip("/")) for repo, root in named)
        yield from _listed_batches(row for repo, at in places for row in walk.rows(Subtrees([(repo, at, at, True)])))

    spark = roots.sparkSession
    roots = durable(roots.select("repo", "root"), "roots")
    tasks = tasks or max(spark.sparkContext.defaultParallelism * 2, roots.count() // ROOTS_PER_TASK)
    return roots.repartition(tasks, "root").mapInArrow(open_roots, LISTING)


def stream_code_files(spark: SparkSession, roots: Roots, names: Sequence[str] = (), tasks: int | None = None) -> DataFrame:
    """A stream of listings: every micro-batch has a row for each code file there is at that time."""
    spark.dataSource.register(CodeTreeSource)
    options = _options(roots, "PERMISSIVE", names, tasks or spark.sparkContext.defaultParallelism * 2)
    return spark.readStream.format("codetree").options(**options).load()


def list_by_levels(spark: SparkSession, roots: Roots, mode: str = "PERMISSIVE", names: Sequence[str] = (), tasks: int | None = None) -> DataFrame:
    """The listing of ``list_code_files``, walked level by level: the directories of a level are a table, dealt evenly to all tasks.

    For trees where one subtree holds most directories.  A round per level of depth; the directories still to be opened are
    never on the driver.
    """
    tasks = tasks or spark.sparkContext.defaultParallelism * 2
    walk = Listing(_options({"": "/"} if isinstance(roots, DataFrame) else roots, mode, names, tasks))
    out = LISTING + ", folder string, root string"

    def open_folders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, held = pa.schema([*_LISTED, ("folder", pa.string()), ("root", pa.string())]), []
        for batch in batches:
            for place in batch.to_pylist():
                for is_row, found in walk.folder(place["repo"], place["root"], place["folder"]):
                    if is_row:
                        held.append(_listed(found))
                    else:
                        held.append({"repo": found[0], "folder": found[2], "root": found[1]})
                    if len(held) >= LISTED_AT_ONCE:
                        yield pa.RecordBatch.from_pylist(held, schema=schema)
                        held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=schema)

    if isinstance(roots, DataFrame):
        frontier, files = roots.select("repo", F.rtrim("root", F.lit("/")).alias("root"), F.rtrim("root", F.lit("/")).alias("folder")), None
    else:
        frontier, files = spark.createDataFrame([(n, r, r) for n, r in walk.roots], "repo string, root string, folder string"), None
    while frontier.limit(1).count():
        level = durable(frontier.repartition(tasks).mapInArrow(open_folders, out), "level")
        frontier = level.where(F.col("folder").isNotNull()).select("repo", "root", "folder")
        found = level.where(F.col("folder").isNull()).drop("folder", "root")
        files = found if files is None else files.union(found)
    return files


def read_files(listing: DataFrame, mode: str = "PERMISSIVE", task_bytes: int = READ_TASK_BYTES) -> DataFrame:
    """``repo, path, ext, mtime, size, content[, _error]`` for a listing (any table with its columns).

    The listing is written to the shared folder, so that directories are walked once, and its total size
    decides how many tasks read.
    """
    spark = listing.sparkSession
    listing = durable(listing, "listing")
    total = listing.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    tasks = max(total // task_bytes + 1, spark.sparkContext.defaultParallelism)
    fail_fast = mode.upper() == "FAILFAST"
    out = "repo string, path string, mtime timestamp, size bigint, content string, _error string"
    read = listing.repartition(tasks, "location").mapInArrow(_read_batches(fail_fast), out)
    names = FILES.names if fail_fast else SCANNED_FILES.names
    return read.withColumn("ext", extension(F.col("path"))).select(*names)


def _lines(location: str) -> Iterator[str]:
    """Lines of a file of any size, a block at a time; one carriage return before a line's end goes.  One line is held."""
    decoder = codecs.getincrementaldecoder("utf-8")("srcatlas_byte")
    held: list[str] = []  # parts of the line that is being read
    for block in read_blocks(location, STREAM_BYTES):
        part, *more = decoder.decode(block).split("\n")
        held.append(part)
        if more:
            yield "".join(held).removesuffix("\r")
            yield from (x.removesuffix("\r") for x in more[:-1])
            held = more[-1:]
    held.append(decoder.decode(b"", True))
    rest = "".join(held)
    if rest:
        yield rest.removesuffix("\r")


def _packed(lines: Iterator[str], max_bytes: int) -> Iterator[str]:
    held: list[str] = []
    used = 0
    for line in lines:
        size = len(line.encode())
        if used and used + size + 1 > max_bytes:
            yield "\n".join(held)
            used = 0
        if used:
            held.append(line)
            used += 1 + size
        else:
            held, used = [line], size
    if used:
        yield "\n".join(held)


def stream_line_chunks(listing: DataFrame, max_bytes: int, mode: str = "PERMISSIVE") -> DataFrame:
    """``repo, file, chunk_idx, content, _error``: line chunks of the files of a listing, cut while they are read.

    The same chunks as ``line_chunks`` gives, but what is held of a file is a block, a chunk and the line that is read.  A file that cannot be read to its end
    has the chunks so far and a row with the error; FAILFAST ends the job.
    """
    fail_fast = mode.upper() == "FAILFAST"
    fields = [("repo", pa.string()), ("file", pa.string()), ("chunk_idx", pa.int32()), ("content", pa.string()), ("_error", pa.string())]
    schema = pa.schema(fields)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codecs.register_error("srcatlas_byte", replace_byte)
        out, held = [], 0
        for batch in batches:
            for row in batch.to_pylist():
                number, error = -1, row["_error"]
                chunks = _packed(_lines(row["location"]), max_bytes) if error is None else iter(())
                while True:
                    try:
                        content = next(chunks, None)
                    except OSError as e:
                        if fail_fast:
                            raise
                        content, error = None, f"failed to read file: {e}"
                    if content is None and error is None:
                        break
                    number += 1
                    out.append({"repo": row["repo"], "file": row["path"], "chunk_idx": None if error else number, "content": content, "_error": error})
                    held += len(content or "")
                    if held > READ_BATCH_CHARS:
                        yield pa.RecordBatch.from_pylist(out, schema=schema)
                        out, held = [], 0
                    if error is not None:
                        break
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return listing.mapInArrow(cut, "repo string, file string, chunk_idx int, content string, _error string")


def scan_code_files(
    spark: SparkSession, roots: Roots, mode: str = "PERMISSIVE", names: Sequence[str] = (), where: str | None = None, by_levels: bool = False
) -> DataFrame:
    """List and read the code files below ``roots``.

    ``repo`` is a root's own name, its key in a dictionary or its ``repo`` in a table, and ``path`` is relative to it.  ``mode``: PERMISSIVE
    keeps a file that cannot be read with its error; FAILFAST ends the job.  ``names``: files taken besides code
    (``["go.mod", "package.json", "requirements.txt"]`` brings dependencies into a report).  ``where``: SQL over the listing,
    such as ``path like 'cmd/%'``, which the source tests before it opens directories.  ``by_levels``: see ``list_by_levels``.
    Roots are plain paths that every executor can open, or addresses such as ``hdfs://`` and ``s3://`` that Arrow's file
    systems know.
    """
    listing = (list_by_levels if by_levels else list_code_files)(spark, roots, mode, names)
    return read_files(listing if where is None else listing.where(where), mode)
