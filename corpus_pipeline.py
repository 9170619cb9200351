"""A corpus from ``documents`` to packed windows: quality rules, exact and near duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of their input.  A stage
is written as Parquet in the shared folder and read again as the next one's ``docs``.  Null texts, repeated rows, empty
tables and extra columns are treated as each operator's docstring says.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from srcatlas.llm.common import table
from srcatlas.llm.exact import drop_exact_duplicates
from srcatlas.llm.mixing import mixed
from srcatlas.llm.packing import packed
from srcatlas.llm.quality import keep_good
from srcatlas.llm.queries import TOKENIZER
from srcatlas.llm.simhash import drop_near_duplicates
from srcatlas.session import new_shared_path, remove, scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality rules keep, with all columns.

    Null and empty texts have too few words and go; repeated rows get one verdict; null languages and sources are groups of their
    own; an empty table stays empty; columns of any name are carried.
    """
    return keep_good(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: the largest ``doc_id``, of repeated rows one.  A null text equals an empty one."""
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group that links of at most two differing fingerprint bits join: the smallest ``doc_id``.

    Texts without words are one group.
    """
    return drop_near_duplicates(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, at most three times; a null source is a source, sources without words give nothing."""
    return mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the sequences with their token ids (little-endian unsigned 32-bit numbers): sequence, offset, ids.

    Every row is packed, a null text as an empty one; ``packing.sequences`` joins the pieces of a sequence.
    """
    return packed(docs, public_tokenizers.path(TOKENIZER), with_ids=True)


STAGES = [("quality", quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of the whole corpus.  What a stage has written besides its result goes when it is done, and its input with it."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = new_shared_path(spark, name)
        with scratch(spark):
            stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs


#: Fingerprints (XXH64 of shingles) and token ids are not expressible in SQL; tests compare with a brute-force version.
ORACLE_SQL = None
