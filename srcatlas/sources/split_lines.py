"""Line chunks of large files, each cut by many tasks.

A file is cut into byte ranges.  A line belongs to the range it starts in.  Where chunks begin in a range depends on how full the
open chunk is when the range begins, but only up to the first line that does not fit: from there on the range packs alike
whatever came before.  So one reading gives each range a short table: the sizes of its first lines up to the limit, and for each
of them, if a chunk begins there, how full the last chunk is at the range's end and how many chunks begin.  The tables of a file
are composed in order; then every range is read again from its known state and gives the chunks that begin in it, reading on
behind its end for the last one.  A task holds a range, a chunk and a line.
"""

from __future__ import annotations

import codecs
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcatlas.session import durable
from srcatlas.sources.code_tree import READ_BATCH_CHARS, replace_byte
from srcatlas.sources.fs import read_range

RANGE_BYTES = 16 << 20
MORE_BYTES = 1 << 20


def _text(line: bytes) -> str:
    return line.decode("utf-8", "srcatlas_byte").removesuffix("\r")


def lines_from(location: str, start: int, end: int, length: int) -> Iterator[tuple[int, str]]:
    """(place, text) of the lines that start in a range, and of all after it, as far as they are asked for."""
    at, held, more = start, [], start
    data = read_range(location, start - 1, end - start + 1) if start else read_range(location, 0, end)
    if start:
        first = data.find(b"\n")
        more = start - 1 + len(data)
        if first < 0 or first == len(data) - 1 and start + first >= end:
            return  # no line starts here
        at, data = start + first, data[first + 1 :]
    else:
        more = len(data)
    while True:
        *whole, rest = data.split(b"\n")
        for line in whole:
            held.append(line)
            full = b"".join(held)
            yield at, _text(full)
            at, held = at + len(full) + 1, []
        held.append(rest)
        if more >= length:
            break
        data = read_range(location, more, MORE_BYTES)
        more += len(data)
        if not data:
            break
    full = b"".join(held)
    if full:
        yield at, _text(full)


def table_of(sizes: list[int], limit: int) -> dict:
    """How a range with lines of these sizes takes any state: see ``entered``.

    ``before``: bytes with separators up to each of the first lines, as far as they can matter; ``full`` and ``begun`` for a chunk
    that begins at that line: how full the last one is at the end, and how many begin; the last entry stands behind all lines.
    """
    n = len(sizes)
    size = np.array(sizes, np.int64)
    upto = np.concatenate([[0], np.cumsum(size + 1)])  # before line k
    # the first line that a chunk begun at line k has no room for
    nxt = np.maximum(np.searchsorted(upto[1:], upto[:-1] + 1 + limit, "right"), np.arange(1, n + 1)) if n else np.zeros(0, np.int64)
    full, begun = [0] * (n + 1), [0] * (n + 1)
    for k in range(n - 1, -1, -1):
        if sizes[k] == 0:  # a blank line begins no chunk
            full[k], begun[k] = full[k + 1], begun[k + 1]
        elif nxt[k] < n:
            full[k], begun[k] = full[nxt[k]], begun[nxt[k]] + 1
        else:
            full[k], begun[k] = int(upto[n] - upto[k] - 1), 1
    # an open chunk holds a byte at least, so its first line without room is among these
    kept = int(np.searchsorted(upto[1:], limit, "left")) + 1
    return {"before": upto[1 : kept + 1].tolist(), "full": full[:kept], "begun": begun[:kept], "total": int(upto[n])}


def entered(table: dict, used: int, limit: int) -> tuple[int, int, int]:
    """State ``used`` at a range's beginning -> (line the first chunk begins at or is refused from, state at the end, chunks begun)."""
    k = 0
    if used:
        k = int(np.searchsorted(table["before"], limit - used, "right")) if used <= limit else 0
        if k >= len(table["before"]) or not table["before"]:
            return k, used + table["total"], 0
    if k >= len(table["full"]):
        return k, used, 0
    return k, table["full"][k], table["begun"][k]


def split_line_chunks(listing: DataFrame, max_bytes: int, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``repo, file, chunk_idx, content`` of the files of a listing: the chunks of ``line_chunks``, ranges of a file dealt to many tasks.

    Listing rows with an error are left out; a file that cannot be read ends the job.  Files should not change meanwhile.
    """
    spark = listing.sparkSession
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(range_bytes).cast("long"))
    files = listing.where("_error is null and size > 0")
    ranges = durable(files.select("repo", "path", "location", "size", F.explode(starts).alias("start")), "ranges")
    total = ranges.agg(F.coalesce(F.sum(F.least(F.col("size") - F.col("start"), F.lit(range_bytes))), F.lit(0))).first()[0]
    tasks = max(spark.sparkContext.defaultParallelism, total // RANGE_BYTES + 1)
    key = pa.schema([("location", pa.string()), ("start", pa.int64())])
    table_type = [("before", pa.list_(pa.int64())), ("full", pa.list_(pa.int64())), ("begun", pa.list_(pa.int64())), ("total", pa.int64())]

    def own(row: dict) -> Iterator[tuple[int, str]]:
        end = min(row["start"] + range_bytes, row["size"])
        for at, line in lines_from(row["location"], row["start"], end, row["size"]):
            if at >= end:
                return
            yield at, line

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codecs.register_error("srcatlas_byte", replace_byte)
        schema = pa.schema([*key, *(pa.field(n, t) for n, t in table_type)])
        for batch in batches:
            for row in batch.to_pylist():
                made = table_of([len(line.encode()) for _, line in own(row)], max_bytes)
                yield pa.RecordBatch.from_pylist([{"location": row["location"], "start": row["start"], **made}], schema=schema)

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, now, used, number = pa.schema([*key, pa.field("used", pa.int64()), pa.field("number", pa.int64())]), None, 0, 0
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["location"] != now:
                    now, used, number = row["location"], 0, 0
                out.append({"location": now, "start": row["start"], "used": used, "number": number})
                _, used, begun = entered(row, used, max_bytes)
                number += begun
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codecs.register_error("srcatlas_byte", replace_byte)
        schema = pa.schema([("repo", pa.string()), ("file", pa.string()), ("chunk_idx", pa.int32()), ("content", pa.string())])
        for batch in batches:
            for row in batch.to_pylist():
                out, kept = [], 0
                for number, content in _begun(row):
                    out.append({"repo": row["repo"], "file": row["path"], "chunk_idx": number, "content": content})
                    kept += len(content)
                    if kept > READ_BATCH_CHARS:
                        yield pa.RecordBatch.from_pylist(out, schema=schema)
                        out, kept = [], 0
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)

    def _begun(row: dict) -> Iterator[tuple[int, str]]:
        """Chunks that begin in a range.  An open chunk of an earlier range takes lines until one has no room, without being given."""
        end = min(row["start"] + range_bytes, row["size"])
        used, mine, held, number = row["used"], False, [], row["number"]
        for at, line in lines_from(row["location"], row["start"], end, row["size"]):
            size = len(line.encode())
            if used and used + size + 1 > max_bytes:
                if mine:
                    yield number, "\n".join(held)
                    number += 1
                used, mine, held = 0, False, []
            if used:
                used += 1 + size
                if mine:
                    held.append(line)
            elif at >= end:
                return  # what begins from here on belongs to later ranges
            elif size:
                used, mine, held = size, True, [line]
            if at >= end and not mine:
                return
        if mine:
            yield number, "\n".join(held)

    spread = lambda df: df.repartition(tasks, "location", "start")
    tables = durable(
        spread(ranges).mapInArrow(scan, "location string, start long, before array<long>, full array<long>, begun array<long>, total long"), "range-tables"
    )
    states = tables.repartition("location").sortWithinPartitions("location", "start").mapInArrow(compose, "location string, start long, used long, number long")
    ready = durable(ranges.join(states, ["location", "start"]), "range-states")
    return spread(ready).mapInArrow(cut, "repo string, file string, chunk_idx int, content string")
