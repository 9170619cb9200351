"""Chunkers as table functions of SQL, for a lateral join: built from the same expressions, without Python.

    SELECT f.path, c.chunk_idx, c.content FROM files f, LATERAL line_chunks(f.content, 500) c
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from srcatlas.functions.text import WHITESPACE_SQL
from srcatlas.operators.chunk import block_spans_sql, pack_sql

_LINES = "split(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '[\\\\r\\\\n]\\\\z', ''), chr(10), -1)"
_PIECES = f"filter(transform(split(text, chr(10) || chr(10), -1), x -> trim(both {WHITESPACE_SQL} from x)), x -> x <> '')"


def _cut(pieces: str, spans: str, glue: str) -> str:
    """Pieces joined by spans; arrays are named by one-element transforms, since a body of one expression needs no subquery."""
    joined = f"transform(pack(pieces), b -> array_join(slice(pieces, b.s, b.e - b.s + 1), {glue}))"
    return f"transform(array({pieces}), pieces -> {joined.replace('pack(pieces)', spans)})[0]"


def chunker_sql() -> dict[str, str]:
    """Name -> statement that makes the function for the session."""
    sizes = "transform(pieces, x -> octet_length(x))"
    limit = "max_bytes"
    paragraphs = _cut(_PIECES, pack_sql(sizes, f"if({limit} > 0, {limit}, 1000)", 2, 0, True), "chr(10) || chr(10)")
    lines = _cut(_LINES, pack_sql(sizes, limit, 1, 1, False), "chr(10)")
    blocks = f"transform(array(split(text, chr(10), -1)), ls -> transform({block_spans_sql('ls')}, b -> named_struct('s', b.s, 'e', b.e, 'c', array_join(slice(ls, b.s, b.e - b.s + 1), chr(10)))))[0]"
    make = "CREATE OR REPLACE TEMPORARY FUNCTION"
    return {
        "paragraph_chunks": f"{make} paragraph_chunks(text STRING, max_bytes INT) RETURNS TABLE (chunk_idx INT, content STRING) RETURN SELECT posexplode({paragraphs})",
        "line_chunks": f"{make} line_chunks(text STRING, max_bytes INT) RETURNS TABLE (chunk_idx INT, content STRING) RETURN SELECT posexplode({lines})",
        "paragraph_blocks": f"{make} paragraph_blocks(text STRING) RETURNS TABLE (start_line INT, end_line INT, content STRING) RETURN SELECT inline({blocks})",
    }


def register_chunkers(spark: SparkSession) -> None:
    """Make ``paragraph_chunks``, ``line_chunks`` and ``paragraph_blocks`` table functions of the session."""
    for statement in chunker_sql().values():
        spark.sql(statement)
