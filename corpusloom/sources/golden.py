"""Golden sets and other JSON-lines files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.schemas import GOLDEN
from corpusloom.sources.files import source_exists


def load_golden(spark: SparkSession, path: str) -> DataFrame:
    """Items of a golden set. A missing file is an empty set; a malformed row fails the read."""
    if not source_exists(path):
        return spark.createDataFrame([], GOLDEN)
    items = spark.read.schema(GOLDEN).option("mode", "FAILFAST").json(path)
    keywords = F.coalesce("answer_keywords", F.array().cast("array<string>"))
    required = F.col("id").isNotNull() & F.col("query").isNotNull() & F.col("namespaces").isNotNull()
    checked = F.when(required & F.col("relevant_chunks").isNotNull(), F.col("id")).otherwise(
        F.raise_error(F.lit("golden item lacks a required field"))
    )
    return items.withColumns({"id": checked, "answer_keywords": keywords})


def golden_queries(items: DataFrame) -> DataFrame:
    return items.select(F.col("id").alias("query_id"), F.col("query").alias("question"), "namespaces")


def golden_relevant(items: DataFrame) -> DataFrame:
    """(query_id, namespace, path, symbol)."""
    return items.select(F.col("id").alias("query_id"), F.inline("relevant_chunks"))


def golden_namespaces(items: DataFrame) -> DataFrame:
    return items.select(F.explode("namespaces").alias("namespace")).distinct()


def write_jsonl(df: DataFrame, path: str, single_file: bool = False) -> None:
    """JSON lines; ``single_file`` is for small exports, larger ones stay partitioned."""
    (df.coalesce(1) if single_file else df).write.mode("overwrite").json(path)
