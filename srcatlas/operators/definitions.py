"""Definitions in source files: functions, methods, classes and structs with their line spans.

This is a lexical reading, not a syntax tree, but one that knows literals and comments over several lines and pairs
brackets (``functions.source_spans``).  Python spans end by indentation, those of Go, JavaScript and TypeScript by
their closing brace.  An unnamed function expression is found by ``=>`` or ``function``; one row per kind and line.
A template string that holds another one inside ``${}`` is read as two.

A file is one row and is read once, in time linear in its size, over Arrow batches: no shuffle.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from srcatlas.functions.arrays import items
from srcatlas.functions.source_spans import EXTENSIONS, definition_spans
from srcatlas.functions.text import base_name, extension, lines_of
from srcatlas.operators.chunk import block_spans

_FIELDS = [("kind", T.StringType()), ("name", T.StringType()), ("s", T.IntegerType()), ("e", T.IntegerType())]
_DEFS = T.ArrayType(T.StructType([T.StructField(name, kind) for name, kind in _FIELDS]))


@F.pandas_udf(_DEFS)
def _spans(extensions: pd.Series, texts: pd.Series) -> pd.Series:
    return pd.Series([definition_spans(e, t or "") for e, t in zip(extensions, texts)], dtype=object)


def with_definitions(files: DataFrame) -> DataFrame:
    """Add ``_lines`` and ``_defs array<struct<kind,name,s,e>>``; no definitions for other languages."""
    ext = F.lower(extension(F.col("path")))
    # only texts that can have definitions go to the Python workers; the others as an empty text
    text = F.when(ext.isin(*EXTENSIONS), F.col("content")).otherwise("")
    return files.withColumn("_lines", lines_of(F.col("content"))).withColumn("_defs", _spans(ext, text))


def _emit(spans: DataFrame) -> DataFrame:
    """Whole source lines of each span.  A span starts at a line that is not blank, so none is blank."""
    s, e = F.col("_d.s"), F.col("_d.e")
    return spans.select(
        "repo",
        F.col("path").alias("file"),
        base_name(F.col("path")).alias("filename"),
        F.when(F.col("_d.kind") == "function", F.col("_d.name")).alias("function"),
        F.when(F.col("_d.kind") == "class", F.col("_d.name")).alias("class"),
        s.alias("start_line"),
        e.alias("end_line"),
        F.array_join(F.slice("_lines", s, e - s + 1), "\n").alias("content"),
    )


def definitions(files: DataFrame) -> DataFrame:
    """``repo, file, filename, function, class, start_line, end_line, content``.

    A class and its methods overlap; a named arrow function comes twice, named and unnamed.
    """
    return _emit(with_definitions(files).withColumn("_d", F.explode(items("_defs"))))


def semantic_chunks(files: DataFrame) -> DataFrame:
    """Definitions where a file has any, else its blocks of non-blank lines."""
    both = with_definitions(files).withColumn("_blocks", block_spans("_lines"))
    chosen = F.expr(f"""case when size(_defs) > 0 then _defs else transform(_blocks, b ->
      named_struct('kind', cast(null as string), 'name', cast(null as string), 's', b.s, 'e', b.e)) end""")
    return _emit(both.withColumn("_d", F.explode(chosen)))
