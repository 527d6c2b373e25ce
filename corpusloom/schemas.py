"""Row types shared by the operators."""

from __future__ import annotations

from pyspark.sql import types as T

CHUNKS = T.StructType(
    [
        T.StructField("doc_id", T.StringType()),
        T.StructField("namespace", T.StringType()),
        T.StructField("file_path", T.StringType()),
        T.StructField("commit_sha", T.StringType()),
        T.StructField("indexed_at", T.TimestampType()),
        T.StructField("chunk_type", T.StringType()),
        T.StructField("symbol", T.StringType()),
        T.StructField("heading_path", T.StringType()),
        T.StructField("level", T.IntegerType()),
        T.StructField("language", T.StringType()),
        T.StructField("start_line", T.IntegerType()),
        T.StructField("end_line", T.IntegerType()),
        T.StructField("text", T.StringType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
    ]
)

_RELEVANT = T.StructType(
    [
        T.StructField("namespace", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("symbol", T.StringType()),
    ]
)

GOLDEN = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("query", T.StringType()),
        T.StructField("namespaces", T.ArrayType(T.StringType())),
        T.StructField("relevant_chunks", T.ArrayType(_RELEVANT)),
        T.StructField("answer_keywords", T.ArrayType(T.StringType())),
    ]
)
