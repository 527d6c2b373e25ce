"""Content-addressed embedding cache: a table bucketed by key, one per model."""

from __future__ import annotations

import hashlib
import logging
import time
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.ids import cache_key, model_tag

BUCKETS = 64


def fill_misses(texts: DataFrame, cached: DataFrame, embed: Callable[[Column], Column]) -> DataFrame:
    """(cache_key, vector) of the texts (cache_key, text) that the cache does not hold.

    Equal texts are encoded once: they meet under one key before the encoder runs. A null text has no key and is
    never encoded.
    """
    wanted = texts.where(F.col("cache_key").isNotNull()).groupBy("cache_key").agg(F.first("text").alias("text"))
    missing = wanted.join(cached, "cache_key", "left_anti")
    return missing.select("cache_key", embed(F.col("text")).alias("vector"))


def embed_with_cache(chunks: DataFrame, embed: Callable[[Column], Column], cache: EmbeddingCache | None) -> DataFrame:
    """Chunks with ``embedding``, from the cache where there is one that can be reached, else straight from the encoder.

    Either way a null text has no embedding. A cache that is down costs time, never the run.
    """
    if cache is not None and cache.reachable():
        return cache.embed(chunks, embed)
    return chunks.withColumn("embedding", F.when(F.col("text").isNotNull(), embed(F.coalesce("text", F.lit("")))))


class EmbeddingCache:
    """One table per model, so a changed model never returns stale vectors.

    Rows are dealt to ``buckets`` files by their key and only added to; of rows with one key the last stored counts. As
    the buckets are the partitions of a join by key, neither the join nor the choice of the last row moves the
    table. The number of buckets is part of the folder's name: another number is another, empty cache.
    """

    def __init__(self, spark: SparkSession, path: str, model_name: str, buckets: int = BUCKETS) -> None:
        self.spark, self.model_name, self.buckets = spark, model_name, buckets
        self.path = f"{path.rstrip('/')}/{model_tag(model_name)}/{buckets}-buckets"
        self._name = f"embedding_cache_{hashlib.sha256(self.path.encode()).hexdigest()[:20]}"

    def reachable(self) -> bool:
        """Whether the cache's folder is there or can be made; if not, a warning says why."""
        try:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
            system = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
            if system.exists(path) or system.mkdirs(path):
                return True
            reason = "the folder cannot be made"
        except Py4JJavaError as problem:
            reason = str(problem.java_exception)
        logging.getLogger(__name__).warning("no embedding cache at %s (%s): embedding without", self.path, reason)
        return False

    def _table(self) -> str:
        """The table's name in this session's catalog; its rows live in the folder."""
        location = self.path.replace("'", "\\'")
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self._name} (cache_key STRING, vector ARRAY<FLOAT>, stored_at BIGINT) USING parquet "
            f"CLUSTERED BY (cache_key) INTO {self.buckets} BUCKETS LOCATION '{location}'"
        )
        return self._name

    def read(self) -> DataFrame:
        """(cache_key, vector), one row for each key."""
        rows = self.spark.table(self._table())
        return rows.groupBy("cache_key").agg(F.max_by("vector", "stored_at").alias("vector"))

    def store(self, rows: DataFrame) -> None:
        """Add (cache_key, vector); a key that is there already has the new vector from now on. Rows without key go."""
        keyed = rows.where(F.col("cache_key").isNotNull()).select("cache_key", F.col("vector").cast("array<float>").alias("vector"))
        stamped = keyed.repartition(self.buckets, "cache_key").withColumn("stored_at", F.lit(time.time_ns()))
        stamped.write.insertInto(self._table())

    def lookup(self, chunks: DataFrame) -> DataFrame:
        """Chunks with ``embedding``, null where the cache has none; each chunk once."""
        keyed = chunks.withColumn("cache_key", cache_key(F.col("text"), self.model_name))
        return keyed.join(self.read().withColumnRenamed("vector", "embedding"), "cache_key", "left").drop("cache_key")

    def embed(self, chunks: DataFrame, embed: Callable[[Column], Column]) -> DataFrame:
        """Add ``embedding`` to chunks with text: store the misses, then join all from the table."""
        texts = chunks.select(cache_key(F.col("text"), self.model_name).alias("cache_key"), "text")
        self.store(fill_misses(texts, self.read(), embed))
        return self.lookup(chunks)
