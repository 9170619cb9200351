"""Repository structure: texts per file, lines of code, languages, directories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcatlas.functions.tables import CHUNK_BYTES, TOP_LANGUAGES, UNKNOWN_LANGUAGE
from srcatlas.functions.text import base_name, directory, is_blank, language, line_count
from srcatlas.operators.chunk import with_paragraph_chunks

ANALYSIS_GLUE = "\n"
DISPLAY_GLUE = "\n...\n"


def chunks_by_file(index: DataFrame) -> DataFrame:
    """``repo, path, chunks`` from an index, chunks in order.

    The group is one file: its chunks were cut from a single text cell and are no larger than it.
    """
    ordered = F.sort_array(F.collect_list(F.struct("chunk_idx", "content")))
    return (
        index.groupBy("repo", F.col("file").alias("path"))
        .agg(ordered.alias("_c"))
        .select("repo", "path", F.transform("_c", lambda c: c["content"]).alias("chunks"))
    )


def chunks_of_files(files: DataFrame, max_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The same table straight from files, without a shuffle.  Files without chunks are not in an index."""
    # A text has chunks exactly if it is not blank; testing the text keeps the fold out of the filter.
    with_text = files.where(~is_blank(F.col("content")))
    return with_paragraph_chunks(with_text, max_bytes).select("repo", "path", "chunks")


def file_text(by_file: DataFrame, glue: str = ANALYSIS_GLUE) -> DataFrame:
    return by_file.select("repo", "path", F.array_join("chunks", glue).alias("text"))


def with_structure(by_file: DataFrame) -> DataFrame:
    """Add ``language`` and ``loc``.  Lines are those of the stored chunks."""
    loc = line_count(F.array_join("chunks", ANALYSIS_GLUE))
    return by_file.withColumns({"language": language(F.col("path")), "loc": loc})


def file_structure(by_file: DataFrame) -> DataFrame:
    """``repo, path, language, loc``."""
    return with_structure(by_file).select("repo", "path", "language", "loc")


def index_structure(index: DataFrame) -> DataFrame:
    """``file_structure`` of a stored index by partial sums, with no text in the shuffle."""
    path = F.col("file").alias("path")
    loc = F.sum(line_count(F.col("content"))).alias("loc")
    return index.groupBy("repo", path).agg(loc).select("repo", "path", language(F.col("path")).alias("language"), "loc")


def language_loc(structure: DataFrame) -> DataFrame:
    known = structure.where(F.col("language") != UNKNOWN_LANGUAGE)
    return known.groupBy("repo", "language").agg(F.sum("loc").alias("loc"))


def _top_languages(by_language: str, top: int) -> Column:
    """First names of an array of ``(-loc, language)``.  There are no more entries than known languages."""
    ordered = F.slice(F.sort_array(by_language), 1, top)
    return F.array_join(F.transform(ordered, lambda x: x["language"]), ", ")


def main_languages(structure: DataFrame, top: int = TOP_LANGUAGES) -> DataFrame:
    """Per repository the ``top`` languages by lines, name ascending on ties, as one string."""
    sizes = language_loc(structure).select("repo", F.struct((-F.col("loc")).alias("size"), "language").alias("_l"))
    return sizes.groupBy("repo").agg(F.collect_list("_l").alias("_l")).select(
        "repo", _top_languages("_l", top).alias("languages")
    )


def repo_totals(structure: DataFrame) -> DataFrame:
    return structure.groupBy("repo").agg(F.count(F.lit(1)).alias("files"), F.sum("loc").alias("loc"))


def repo_overview(structure: DataFrame, top: int = TOP_LANGUAGES) -> DataFrame:
    """Totals with the main languages (empty where every language is unknown)."""
    parts = structure.groupBy("repo", "language").agg(F.count(F.lit(1)).alias("files"), F.sum("loc").alias("loc"))
    known = F.when(F.col("language") != UNKNOWN_LANGUAGE, F.struct((-F.col("loc")).alias("size"), "language"))
    return (
        parts.withColumn("_l", known)
        .groupBy("repo")
        .agg(F.collect_list("_l").alias("_l"), F.sum("files").alias("files"), F.sum("loc").alias("loc"))
        .select("repo", _top_languages("_l", top).alias("languages"), "files", "loc")
    )


def dir_listing(structure: DataFrame) -> DataFrame:
    """The directory section as rows, to be read in the order ``repo, dir, path``.

    A directory's heading is the row with an empty path.  A listing is never gathered into one value,
    so a directory may hold any number of files.
    """
    rows = structure.withColumn("dir", directory(F.col("path")))
    heading = F.when(F.col("dir") == ".", "Root directory:").otherwise(F.format_string("Directory %s:", F.col("dir")))
    entry = F.format_string("  - %s (%s, %d lines)", base_name(F.col("path")), "language", "loc")
    heads = rows.select("repo", "dir").distinct().select("repo", "dir", F.lit("").alias("path"), heading.alias("line"))
    return heads.unionByName(rows.select("repo", "dir", "path", entry.alias("line")))
