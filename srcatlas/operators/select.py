"""Row selection over a table of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcatlas.functions.tables import CODE_EXTENSIONS, SKIPPED_DIRS
from srcatlas.functions.text import extension


def is_code_path(path: Column) -> Column:
    """Extension is on the list and no directory of the path is skipped.  A file may bear a skipped name."""
    parts = F.split(path, "/", -1)
    dirs = F.slice(parts, 1, F.size(parts) - 1)
    return extension(path).isin(*CODE_EXTENSIONS) & ~F.arrays_overlap(dirs, F.array(*map(F.lit, SKIPPED_DIRS)))


def code_files(files: DataFrame) -> DataFrame:
    return files.where(is_code_path(F.col("path")))
