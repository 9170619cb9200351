"""Chunkers: cut a file's text into pieces of bounded size or into blocks with line spans.

A file is one row, and every chunker works inside that row: no shuffle, no sort, no Python.  The folds
carry sizes and positions only; the text is cut once at the end.  Folds are SQL text, which Spark parses in
one go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcatlas.functions.arrays import items
from srcatlas.functions.tables import CHUNK_BYTES, CHUNK_BYTES_IF_UNSET
from srcatlas.functions.text import WHITESPACE_SQL, lines_of, trim_space

_SPANS = "array<struct<s:int,e:int>>"


#: A step of a fold copies what it has put out so far; blocks of this many pieces keep that short.
_BLOCK = 512


def pack_sql(sizes: str, limit: int | str, separator: int, slack: int, flush_full: bool) -> str:
    """SQL of greedy packing of consecutive pieces: spans of piece numbers (1-based, inclusive).

    State: ``s`` first piece of the open span, ``cur`` its bytes so far (0: none open), ``i`` pieces seen.
    ``z`` is the next piece's size.  Pieces are taken block by block, and a block's spans are joined to the
    others at its end, so a file of a million lines takes seconds.
    """
    over = f"(a.cur > 0 and a.cur + z + {slack} > {limit})"
    fresh = f"(a.cur = 0 or {over})"
    start = f"case when {fresh} then a.i + 1 else a.s end"
    cur = f"case when {fresh} then z else a.cur + {separator} + z end"
    out = f"case when {over} then array_append(a.out, named_struct('s', a.s, 'e', a.i)) else a.out end"
    if flush_full:
        full = f"({cur} >= {limit})"
        out = f"case when {full} then array_append({out}, named_struct('s', {start}, 'e', a.i + 1)) else {out} end"
        cur = f"case when {full} then 0 else {cur} end"
    none = f"cast(array() as {_SPANS})"
    inner = f"""
      aggregate(slice(all_sizes, block * {_BLOCK} + 1, {_BLOCK}), named_struct('s', o.s, 'cur', o.cur, 'i', o.i, 'out', {none}),
        (a, z) -> named_struct('s', {start}, 'cur', {cur}, 'i', a.i + 1, 'out', cast({out} as {_SPANS})))"""
    joined = f"""
      transform(array({inner}), n -> named_struct('s', n.s, 'cur', n.cur, 'i', n.i,
        'out', cast(case when size(n.out) = 0 then o.out else concat(o.out, n.out) end as {_SPANS})))[0]"""
    return f"""
      transform(array({sizes}), all_sizes ->
        aggregate(sequence(0, cast(floor(size(all_sizes) / {_BLOCK}) as int)), named_struct('s', 0, 'cur', 0, 'i', 0, 'out', {none}),
          (o, block) -> {joined},
          o -> case when o.cur > 0 then array_append(o.out, named_struct('s', o.s, 'e', o.i)) else o.out end))[0]"""


def _pack(sizes: str, limit: int, separator: int, slack: int, flush_full: bool) -> Column:
    return F.expr(pack_sql(sizes, limit, separator, slack, flush_full))


def _cut(pieces: str, spans: str, glue: str) -> Column:
    return F.transform(
        spans, lambda b: F.array_join(F.slice(F.col(pieces), b["s"], b["e"] - b["s"] + 1), glue)
    )


def with_paragraph_chunks(files: DataFrame, max_bytes: int = CHUNK_BYTES, content: str = "content") -> DataFrame:
    """Add ``chunks array<string>``: paragraphs trimmed and packed up to ``max_bytes``.

    Separator bytes are not counted when testing for overflow, and a paragraph larger than the limit
    stays whole, so a chunk may exceed the limit.
    """
    limit = max_bytes if max_bytes > 0 else CHUNK_BYTES_IF_UNSET
    trimmed = F.transform(F.split(F.col(content), "\n\n", -1), trim_space)
    return (
        files.withColumn("_pieces", F.filter(trimmed, lambda x: x != ""))
        .withColumn("_spans", _pack("transform(_pieces, x -> octet_length(x))", limit, 2, 0, flush_full=True))
        .withColumn("chunks", _cut("_pieces", "_spans", "\n\n"))
        .drop("_pieces", "_spans")
    )


def with_line_chunks(files: DataFrame, max_bytes: int, content: str = "content") -> DataFrame:
    """Add ``chunks array<string>``: whole lines packed up to ``max_bytes``, blank lines at a start dropped.

    A line ends at a line feed; one carriage return before it goes too.  Lines may have any length.
    """
    text = F.replace(F.col(content), F.lit("\r\n"), F.lit("\n"))
    ended = F.endswith(text, F.lit("\n")) | F.endswith(text, F.lit("\r"))
    text = F.when(ended, F.left(text, F.char_length(text) - 1)).otherwise(text)
    return (
        files.withColumn("_pieces", lines_of(text))
        .withColumn("_spans", _pack("transform(_pieces, x -> octet_length(x))", max_bytes, 1, 1, flush_full=False))
        .withColumn("chunks", _cut("_pieces", "_spans", "\n"))
        .drop("_pieces", "_spans")
    )


def explode_chunks(chunked: DataFrame) -> DataFrame:
    """One row per chunk: ``repo, file, chunk_idx, content``."""
    return chunked.select(
        "repo", F.col("path").alias("file"), F.posexplode(items("chunks")).alias("chunk_idx", "content")
    )


def paragraph_chunks(files: DataFrame, max_bytes: int = CHUNK_BYTES) -> DataFrame:
    return explode_chunks(with_paragraph_chunks(files, max_bytes))


def line_chunks(files: DataFrame, max_bytes: int) -> DataFrame:
    return explode_chunks(with_line_chunks(files, max_bytes))


def block_spans_sql(lines: str) -> str:
    """SQL of the spans (1-based line numbers) of maximal runs of non-blank lines in an array column."""
    blank = f"transform({lines}, x -> trim(leading {WHITESPACE_SQL} from x) = '')"
    inside = "not get(b, i - 1)"
    starts = f"filter(sequence(1, size(b)), i -> {inside} and (i = 1 or get(b, i - 2)))"
    ends = f"filter(sequence(1, size(b)), i -> {inside} and (i = size(b) or get(b, i)))"
    edges = f"zip_with({starts}, {ends}, (s, e) -> named_struct('s', s, 'e', e))"
    return f"transform(array({blank}), b -> {edges})[0]"


def block_spans(lines: str) -> Column:
    return F.expr(block_spans_sql(lines))


def paragraph_blocks(files: DataFrame) -> DataFrame:
    """Runs of non-blank lines with their line numbers; lines keep their indentation."""
    spans = files.withColumn("_lines", lines_of(F.col("content"))).withColumn("_span", F.explode(block_spans("_lines")))
    s, e = F.col("_span.s"), F.col("_span.e")
    return spans.select(
        "repo",
        F.col("path").alias("file"),
        s.alias("start_line"),
        e.alias("end_line"),
        F.array_join(F.slice("_lines", s, e - s + 1), "\n").alias("content"),
    )
