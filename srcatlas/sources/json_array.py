"""Objects of large JSON arrays, read by many tasks.

A file is cut into byte ranges.  Whether a range begins inside a string, and how many brackets are open there, depends on all
that comes before; so every range is read once for each way it may begin (outside a string, inside one, after a backslash in
one) and gives a small table: how it ends and how many more brackets are open then.  These tables are composed in order,
file by file, and each range is read again from its known beginning: it takes the objects that start in it, reading on behind
its end for the last one.  What a task holds is a range and an object.  Ranges share tasks where there are many.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srcatlas.session import durable
from srcatlas.sources.fs import read_range

RANGE_BYTES = 32 << 20
#: So many ranges get a task each; of more, a task gets several, up to about TASK_BYTES.
OWN_TASKS = 512
TASK_BYTES = 32 << 20
#: Bytes read behind a range's end for its last object: at first, and twice as many each time it goes on.
FIRST_BYTES = 16 << 10
#: Bytes of objects that are handed over at a time.
MORE_BYTES = 1 << 20

OUTSIDE, INSIDE, ESCAPED = range(3)
_BODY = rb'[^"\\]*+(?:\\.[^"\\]*+)*+'
_REST = re.compile(_BODY, re.S)
_TOKEN = re.compile(rb'"' + _BODY + rb'(?:"|\\?\Z)|[{}\[\]]', re.S)


def outcome(data: bytes, state: int) -> tuple[int, int]:
    """How a range ends that begins in ``state``, and by how many the open brackets grow in it."""
    at = 0
    if state != OUTSIDE:
        at = 1 if state == ESCAPED else 0
        if not data:
            return state, 0
        at = _REST.match(data, at).end()
        if at == len(data):
            return INSIDE, 0
        if data[at : at + 1] == b"\\":  # the last byte
            return ESCAPED, 0
        at += 1
    grown = 0
    for m in _TOKEN.finditer(data, at):
        first = m[0][:1]
        if first == b'"':
            if m.end() == len(data):
                body = m[0][1:]
                kept = _REST.match(body).end()
                if kept == len(body):
                    return INSIDE, grown
                if body[kept:] == b"\\":
                    return ESCAPED, grown
        else:
            grown += 1 if first in b"[{" else -1
    return OUTSIDE, grown


def outcomes(data: bytes) -> list[tuple[int, int]]:
    """``outcome`` for every state; after a backslash a range goes on as inside a string unless its first byte matters there."""
    outside, inside = outcome(data, OUTSIDE), outcome(data, INSIDE)
    return [outside, inside, inside if data[:1] not in (b"", b'"', b"\\") else outcome(data, ESCAPED)]


def blocks_behind(path: str, at: int, length: int) -> Iterator[bytes]:
    """What follows a place in a file, in growing blocks, so that an object of any size is read a few times at most."""
    size = FIRST_BYTES
    while at < length:
        yield read_range(path, at, size)
        at, size = at + size, min(2 * size, RANGE_BYTES)


def range_tasks(ranges: int, total_bytes: int, least: int) -> int:
    """Tasks for so many ranges: one each while they are few, else as many as their bytes take."""
    return max(least, min(ranges, max(OWN_TASKS, total_bytes // TASK_BYTES + 1)))


def objects(data: bytes, state: int, depth: int, more: Iterator[bytes]) -> Iterator[tuple[int, bytes]]:
    """(place, text) of the objects that start in ``data`` right inside the array; ``more`` gives what follows, for the last one."""
    limit, at, start = len(data), 0, None
    if state != OUTSIDE:
        at = 1 if state == ESCAPED else 0
        at = _REST.match(data, at).end()
        if at >= len(data) or data[at : at + 1] == b"\\":
            return  # all of it lies in a string, so nothing starts here
        at += 1
    while True:
        stop = at
        for m in _TOKEN.finditer(data, at):
            token = m[0]
            if token[:1] == b'"':
                if m.end() == len(data) and not (len(token) > 1 and token.endswith(b'"') and _REST.match(token, 1).end() == len(token) - 1):
                    stop = m.start()  # a string that goes on behind what is read so far
                    break
            elif token in b"[{":
                if depth == 1 and token == b"{" and start is None:
                    if m.start() >= limit:
                        return
                    start = m.start()
                depth += 1
            else:
                depth -= 1
                if depth == 1 and start is not None:
                    yield start, data[start : m.end()]
                    start = None
            stop = m.end()
        if start is None and stop >= limit:
            return
        block = next(more, b"")
        if not block or (start is None and len(data) > limit):
            return
        if start is None:
            # only a string that begins in the range and ends behind it is left; no object starts in it
            return
        data, at = data + block, stop


def _ranges(spark: SparkSession, path: str, range_bytes: int) -> DataFrame:
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(range_bytes).cast("long"))
    return files.select("path", "length", F.explode(starts).alias("start"))


_STATES = "path string, start long, state int, depth int"


def _composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges in order of (path, start) with their tables -> how each begins."""
    now, state, depth = None, OUTSIDE, 0
    for batch in batches:
        out = []
        for path, start, ends, grown in zip(*(batch[c].to_pylist() for c in ("path", "start", "ends", "grown"))):
            if path != now:
                now, state, depth = path, OUTSIDE, 0
            out.append({"path": path, "start": start, "state": state, "depth": depth})
            state, depth = ends[state], depth + grown[state]
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("path", pa.string()), ("start", pa.int64()), ("state", pa.int32()), ("depth", pa.int32())]))


def array_objects(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``path``, ``at`` (byte), ``json`` of every object right inside the arrays of the files at ``path``, by ranges.

    Files are opened by the tasks: plain paths, or addresses that Arrow's file systems know.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("start", pa.int64()), ("ends", pa.list_(pa.int32())), ("grown", pa.list_(pa.int32()))])
        for batch in batches:
            for row in batch.to_pylist():
                data = read_range(row["path"], row["start"], range_bytes)
                found = outcomes(data)
                yield pa.RecordBatch.from_pylist([{"path": row["path"], "start": row["start"], "ends": [e for e, _ in found], "grown": [g for _, g in found]}], schema=schema)

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("at", pa.int64()), ("json", pa.string())])
        for batch in batches:
            for row in batch.to_pylist():
                data = read_range(row["path"], row["start"], range_bytes)
                more = blocks_behind(row["path"], row["start"] + len(data), row["length"])
                held, size = [], 0
                for at, text in objects(data, row["state"], row["depth"], more):
                    held.append({"path": row["path"], "at": row["start"] + at, "json": text.decode("utf-8", "replace")})
                    size += len(text)
                    if size > MORE_BYTES:
                        yield pa.RecordBatch.from_pylist(held, schema=schema)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=schema)

    ranges = durable(_ranges(spark, path, range_bytes), "ranges")
    n, total = ranges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.least(F.lit(range_bytes), F.col("length") - F.col("start"))), F.lit(0))).first()
    tasks = range_tasks(n, total, spark.sparkContext.defaultParallelism)
    spread = lambda df: df.repartition(tasks, "path", "start")
    tables = durable(spread(ranges).select("path", "start").mapInArrow(scan, "path string, start long, ends array<int>, grown array<int>"), "range-tables")
    begun = tables.repartition("path").sortWithinPartitions("path", "start").mapInArrow(_composed, _STATES)
    begun = durable(ranges.join(begun, ["path", "start"]), "range-states")
    return spread(begun).select("path", "length", "start", "state", "depth").mapInArrow(take, "path string, at long, json string")
