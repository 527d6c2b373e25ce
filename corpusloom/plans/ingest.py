"""Incremental ingest: diff a source tree against the store, chunk and embed what changed."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.config import CODE_SUFFIXES, DOC_SUFFIXES, Settings, get_settings
from corpusloom.functions.ids import point_id
from corpusloom.functions.vectors import get_embedder
from corpusloom.operators.chunking import chunk_files
from corpusloom.operators.sync import ADD, DELETE, ERROR, UPDATE, sync_counts, sync_diff
from corpusloom.sources.chunk_store import ChunkStore
from corpusloom.sources.embedding_cache import EmbeddingCache, embed_with_cache
from corpusloom.sources.files import git_shas, list_files, read_files, relative_files, source_exists

SUFFIXES = DOC_SUFFIXES + CODE_SUFFIXES
_SHOWN_ERRORS = 100


@dataclass
class IngestReport:
    """Counters of one run. ``errors`` shows the first failures; the store keeps all of them, and ``unloadable_files`` lists
    those of a dry run."""

    namespace: str
    files_seen: int = 0
    files_indexed: int = 0
    files_skipped_unchanged: int = 0
    files_deleted: int = 0
    chunks_written: int = 0
    duration_s: float = 0.0
    error_count: int = 0
    errors: list[str] = field(default_factory=list)

    def as_dict(self) -> dict:
        return asdict(self)


def payload_rows(
    cut: DataFrame, namespace: str, embed: Callable[[Column], Column] | None
) -> DataFrame:
    """Store rows from chunked files (path, commit_sha and the chunk fields)."""
    rows = cut.select(
        point_id(
            F.lit(namespace), F.col("path"), F.col("symbol"), F.col("start_line"), F.col("end_line")
        ).alias("doc_id"),
        F.lit(namespace).alias("namespace"),
        F.col("path").alias("file_path"),
        "commit_sha",
        F.current_timestamp().alias("indexed_at"),
        "chunk_type",
        "symbol",
        "heading_path",
        "level",
        "language",
        "start_line",
        "end_line",
        "text",
        "error",
    )
    return rows if embed is None else rows.withColumn("embedding", embed(F.coalesce("text", F.lit(""))))


def _cut(files: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Chunks and error rows of files (path, absolute, ``carry`` columns)."""
    loaded = read_files(files.select("path", "absolute", *carry)).drop("digest")
    unread = loaded.where(F.col("text").isNull()).select("path", *carry, "error")
    return chunk_files(loaded.where(F.col("text").isNotNull()), carry).unionByName(
        unread, allowMissingColumns=True
    )


def _summarise(report: IngestReport, rows: DataFrame, path: str) -> None:
    """Fill the chunk, file and error counters from written (or dry-run) rows."""
    failed = F.col("error").isNotNull()
    chunks, files, errors = rows.agg(
        F.count_if(~failed),
        F.count_distinct(F.when(~failed, F.col(path))),
        F.count_if(failed),
    ).first()
    report.chunks_written, report.files_indexed, report.error_count = chunks, files, errors
    if errors:
        shown = rows.where(failed).select(path, "error").orderBy(path).limit(_SHOWN_ERRORS)
        report.errors = [row["error"] for row in shown.collect()]


def unloadable_files(spark: SparkSession, source: str) -> DataFrame:
    """(path, error) of every file with a known suffix that cannot be read or cut: all that a dry run only counts beyond
    the first ``_SHOWN_ERRORS``."""
    listed = list_files(spark, source, SUFFIXES)
    files = listed.select(F.col("listed").alias("path"), "absolute").repartition("path")
    return _cut(files).where(F.col("error").isNotNull()).select("path", "error")


def ingest(
    spark: SparkSession,
    namespace: str,
    source: str,
    store: ChunkStore | None = None,
    repo_root: str | None = None,
    smoke_file: str | None = None,
    dry_run: bool = False,
    force_reindex: bool = False,
    change_key: str = "git",
    allow_empty: bool = False,
    settings: Settings | None = None,
    embed: Callable[[Column], Column] | None = None,
    cache: EmbeddingCache | None = None,
) -> IngestReport:
    """Bring one namespace of the store in line with a source tree.

    Only added and changed files are read. ``change_key`` is ``git`` (newest commit of each file,
    untracked files are skipped) or ``content`` (hash of the bytes, for trees without history).
    Files of the namespace that the source no longer has are removed, and a changed file that
    cannot be loaded keeps its old chunks. A source in which no file is left, while the store has some, is
    refused unless ``allow_empty``: a wrong path or an unmounted folder looks the same. A dry run reads and chunks every file with a known
    suffix, ignoring globs and history, and writes nothing.
    """
    settings = settings or get_settings()
    started = time.monotonic()
    report = IngestReport(namespace)
    if not source_exists(source):
        return report
    repo_root = repo_root or source

    if dry_run:
        listed = list_files(spark, source, SUFFIXES)
        files = listed.select(F.col("listed").alias("path"), "absolute")
        rows = _cut(files.repartition("path")).select("path", "error").persist()
        report.files_seen = rows.select("path").distinct().count()
        _summarise(report, rows, "path")
        rows.unpersist()
        report.duration_s = time.monotonic() - started
        return report

    if store is None:
        raise ValueError("a real run needs a store")
    globs = settings.ignore_globs.get(namespace, ())
    files = relative_files(spark, source, repo_root, SUFFIXES, globs)
    if change_key == "git":
        current = files.join(git_shas(spark, repo_root), "path")
    else:
        current = read_files(files).select("path", "absolute", F.col("digest").alias("commit_sha"), "error")
    current = current.persist()
    state = current.select(F.col("path").alias("file_path"), "commit_sha")
    diff = sync_diff(state, store.file_shas(namespace), force_reindex)
    if smoke_file is not None:
        diff = diff.where(F.col("file_path") == smoke_file)
    diff = diff.persist()

    counts = sync_counts(diff).first()
    if counts["files_deleted"] and not counts["files_seen"] and smoke_file is None and not allow_empty:
        diff.unpersist()
        current.unpersist()
        raise ValueError(f"{source} has no files left, but the store has {counts['files_deleted']} of them")
    report.files_seen = counts["files_seen"]
    report.files_skipped_unchanged = counts["files_skipped_unchanged"]
    report.files_deleted = counts["files_deleted"]

    if counts["to_index"] or counts["files_deleted"]:
        changed = diff.where(F.col("action").isin(ADD, UPDATE)).select(
            F.col("file_path").alias("path")
        )
        work = current.join(changed, "path", "left_semi").repartition("path")
        cut = _cut(work, ["commit_sha"])
        if embed is None:
            embed = get_embedder(settings)
        if cache is not None:
            rows = embed_with_cache(payload_rows(cut, namespace, None), embed, cache)
        else:
            rows = payload_rows(cut, namespace, embed)

        def removals(written: DataFrame) -> DataFrame:
            failed = written.where(F.col("error").isNotNull()).select("file_path")
            gone = diff.where(F.col("action").isin(DELETE, UPDATE)).select("file_path")
            stale = gone.join(failed, "file_path", "left_anti")
            return stale.select(F.lit(namespace).alias("namespace"), "file_path")

        commit = store.apply(rows, after_write=removals)
        _summarise(report, store.rows_of([commit]), "file_path")

    unread = diff.where(F.col("action") == ERROR)
    if not unread.isEmpty():
        told = F.col("error") if "error" in current.columns else F.lit("no change key")
        told = current.select(F.col("path").alias("file_path"), told.alias("error"))
        told = unread.join(told, "file_path", "left").orderBy("file_path")
        report.error_count += unread.count()
        report.errors += [row["error"] for row in told.limit(_SHOWN_ERRORS).collect()]
    diff.unpersist()
    current.unpersist()
    report.duration_s = time.monotonic() - started
    return report

