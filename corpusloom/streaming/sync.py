"""Continuous ingest: new and replaced files of a folder flow into the store in micro-batches.

Two streams fill a store. ``start_sync`` follows Spark's file source, which sees no deletions and skips names starting
with ``_`` or ``.``. ``start_mirror`` lists the tree at every trigger, in tasks, and takes the batch diff of
``plans.ingest``: deleted files leave the store, and all names are seen.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom.config import Settings
from corpusloom.functions.globs import matches_any_glob
from corpusloom.functions.text import decode_utf8, has_suffix
from corpusloom.functions.vectors import get_embedder
from corpusloom.operators.chunking import chunk_files
from corpusloom.plans.ingest import SUFFIXES, IngestReport, ingest, payload_rows
from corpusloom.sources.chunk_store import ChunkStore

_BINARY = "path string, modificationTime timestamp, length long, content binary"


def file_stream(spark: SparkSession, source: str, ignore_globs=()) -> DataFrame:
    """(path, text, commit_sha) of the tree's files; the content hash is the change key."""
    stream = (
        spark.readStream.format("binaryFile")
        .schema(_BINARY)
        .option("recursiveFileLookup", "true")
        .load(source)
    )
    root = source.removeprefix("file:").rstrip("/")
    path = F.regexp_replace("path", F.lit(r"^file:/*"), F.lit("/"))
    named = stream.select(
        F.replace(path, F.lit(f"{root}/"), F.lit("")).alias("path"),
        decode_utf8(F.col("content")).alias("text"),
        F.sha2("content", 256).alias("commit_sha"),
    )
    return named.where(
        has_suffix(F.col("path"), SUFFIXES) & ~matches_any_glob(F.col("path"), ignore_globs)
    )


def sync_batch(
    store: ChunkStore, namespace: str, embed: Callable[[Column], Column]
) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: each file of the batch replaces its older chunks.

    A batch that is run again after a failure replaces its own rows, so the result is the same.
    """

    def apply(batch: DataFrame, _batch_id: int) -> None:
        if batch.isEmpty():
            return
        newest = batch.dropDuplicates(["path"])
        cut = chunk_files(newest, ["commit_sha"])
        rows = payload_rows(cut, namespace, embed)

        def removals(written: DataFrame) -> DataFrame:
            loaded = written.where(F.col("error").isNull())
            return loaded.select("namespace", "file_path").distinct()

        store.apply(rows, after_write=removals)

    return apply


def start_sync(
    spark: SparkSession,
    namespace: str,
    source: str,
    store: ChunkStore,
    checkpoint: str,
    embed: Callable[[Column], Column] | None = None,
    ignore_globs=(),
    available_now: bool = False,
) -> StreamingQuery:
    writer = (
        file_stream(spark, source, ignore_globs)
        .writeStream.foreachBatch(sync_batch(store, namespace, embed or get_embedder()))
        .option("checkpointLocation", checkpoint)
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def start_mirror(
    spark: SparkSession,
    namespace: str,
    source: str,
    store: ChunkStore,
    checkpoint: str,
    embed: Callable[[Column], Column] | None = None,
    settings: Settings | None = None,
    every: str = "30 seconds",
    once: bool = False,
    on_report: Callable[[IngestReport], None] | None = None,
    allow_empty: bool = False,
) -> StreamingQuery:
    """Keep a namespace equal to a source tree: at every trigger the files that were added, changed or deleted since the
    last one are found by their content and committed together.

    The stream's rows are ticks of a clock; the state is the store. So a batch that is run again after a failure
    finds the tree as it is then, and a lost batch is made up for by the next.
    """

    def apply(_tick: DataFrame, _batch_id: int) -> None:
        report = ingest(
            spark, namespace, source, store, change_key="content", allow_empty=allow_empty, settings=settings, embed=embed or get_embedder(settings)
        )
        if on_report is not None:
            on_report(report)

    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    writer = ticks.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(once=True) if once else writer.trigger(processingTime=every)).start()
