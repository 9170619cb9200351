"""The built-in embedder: a hashed bag of words as a function of the row.

It stands in for a remote model so that an index can be built and checked offline.  A word falls into
bucket ``first 8 hex digits of md5(word) mod dim``; the counts are divided by their Euclidean norm.

Texts go to Python in Arrow batches, where a task remembers the buckets of the words it has met; a digest of every word and a
pass per bucket, as column expressions, take ten times the time.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_DIM = 64
_WORDS = re.compile("[a-z0-9_]+").findall
_MAX_DIM = 200
#: Words whose buckets a task remembers, and the longest of them; it begins anew when they are full.
MAX_KNOWN = 1 << 17
MAX_KNOWN_CHARS = 64


class Buckets(dict):
    """Word -> bucket."""

    def __init__(self, dim: int):
        super().__init__()
        self.dim = dim

    def __missing__(self, word: str) -> int:
        bucket = int.from_bytes(hashlib.md5(word.encode(), usedforsecurity=False).digest()[:4], "big") % self.dim
        if len(word) <= MAX_KNOWN_CHARS:
            if len(self) >= MAX_KNOWN:
                self.clear()
            self[word] = bucket
        return bucket


_known: dict[int, Buckets] = {}


def _counted(texts: pa.Array, dim: int) -> np.ndarray:
    """A row of counts per text."""
    bucket = _known.setdefault(dim, Buckets(dim)).__getitem__
    counts = np.zeros((len(texts), dim), np.int64)
    for row, text in enumerate(texts):
        words = _WORDS(text.as_py() or "")
        if words:
            counts[row] = np.bincount(np.fromiter(map(bucket, words), np.intp, len(words)), minlength=dim)
    return counts


def _rows(values: np.ndarray, texts: pa.Array, kind: pa.DataType) -> pa.Array:
    """Arrays of ``dim`` values; a text that is NULL has NULL in each place."""
    missing = np.repeat(texts.is_null().to_numpy(zero_copy_only=False), values.shape[1]) if texts.null_count else None
    offsets = np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.reshape(-1), kind, mask=missing))


def _checked(dim: int) -> None:
    if not 1 <= dim <= _MAX_DIM:
        raise ValueError(f"dim must be between 1 and {_MAX_DIM}")


def bucket_counts(text: Column, dim: int = DEFAULT_DIM) -> Column:
    """``array<int>`` of word counts per bucket."""
    _checked(dim)

    def count(texts: pa.Array) -> pa.Array:
        return _rows(_counted(texts, dim).astype(np.int32), texts, pa.int32())

    return F.arrow_udf(count, T.ArrayType(T.IntegerType()))(F.lower(text))


def hashed_bag(text: Column, dim: int = DEFAULT_DIM) -> Column:
    """``array<float>`` of length ``dim`` with norm 1, or all zero for a text without words."""
    _checked(dim)

    def embed(texts: pa.Array) -> pa.Array:
        counts = _counted(texts, dim)
        norms = np.sqrt((counts * counts).sum(axis=1, keepdims=True).astype(np.float64))
        return _rows((counts / np.where(norms == 0, 1, norms)).astype(np.float32), texts, pa.float32())

    return F.arrow_udf(embed, T.ArrayType(T.FloatType()))(F.lower(text))
