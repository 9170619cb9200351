"""Schemas of the tables the operators exchange."""

from pyspark.sql import types as T

FILES = T.StructType([
    T.StructField("repo", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("ext", T.StringType()),
    T.StructField("mtime", T.TimestampType()),
    T.StructField("size", T.LongType()),
    T.StructField("content", T.StringType()),
])

#: ``FILES`` plus the reason a file could not be read (``mode=PERMISSIVE``).
SCANNED_FILES = T.StructType(FILES.fields + [T.StructField("_error", T.StringType())])

CHUNKS = T.StructType([
    T.StructField("repo", T.StringType()),
    T.StructField("file", T.StringType()),
    T.StructField("chunk_idx", T.IntegerType()),
    T.StructField("content", T.StringType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
])

#: What is known of an indexed file.
INDEX_STATE = T.StructType([
    T.StructField("repo", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("mtime", T.TimestampType()),
    T.StructField("indexed_at", T.TimestampType()),
])

#: The exchange form of an index: one JSON array, no repository and no chunk number.
INDEX_JSON = T.StructType([
    T.StructField("file", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
])

VECTORS = T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
])
