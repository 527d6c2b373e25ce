"""File trees as DataFrames.

Spark's own file listing hides names that start with ``_`` or ``.``, which would lose every
``__init__.py``. So the tree is walked and read by tasks through Arrow's file systems (local,
HDFS, object stores); only counts pass through the driver.
"""

from __future__ import annotations

import hashlib
import subprocess
import tempfile
from collections.abc import Iterable, Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.globs import matches_any_glob
from corpusloom.functions.text import has_suffix
from corpusloom.session import scratch_path

_READ_ROWS = 64
#: Tasks for each core that list the directories of a level.
_LISTING_TASKS = 4


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    if "://" in uri:
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri.removeprefix("file:")


def source_exists(uri: str) -> bool:
    system, path = _open(uri)
    return system.get_file_info(path).type != fs.FileType.NotFound


def _real_path(system: fs.FileSystem, path: str) -> str:
    if isinstance(system, fs.LocalFileSystem):
        import os

        return os.path.realpath(path)
    return path


def _list(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The entries of each directory, not of those below it; links to directories are neither."""
    for frame in frames:
        for uri in frame["uri"]:
            system, path = _open(uri)
            prefix = uri[: -len(path)] if "://" in uri else ""
            found = []
            for info in system.get_file_info(fs.FileSelector(path)):
                real = _real_path(system, info.path)
                if info.type == fs.FileType.File:
                    found.append((info.path, real, None))
                elif info.type == fs.FileType.Directory and real == info.path:
                    found.append((None, None, prefix + info.path))
            yield pd.DataFrame(found, columns=["listed", "absolute", "uri"])


def list_files(spark: SparkSession, source: str, suffixes: Iterable[str]) -> DataFrame:
    """(listed, absolute) of every file below ``source`` with one of the suffixes.

    The tree is listed level by level. The directories found on a level are dealt anew to all tasks, so one deep
    directory is shared by all of them; each level is written to the shared folder, and only the number of
    its directories reaches the driver. Links to directories are not followed, links to files are resolved.
    """
    system, path = _open(source)
    prefix = source[: -len(path)] if "://" in source else ""
    folder = scratch_path(spark, "listing")
    level, count = 0, 1
    frontier = spark.createDataFrame([(prefix + _real_path(system, path),)], "uri string")
    while count:
        dealt = frontier.repartition(min(count, _LISTING_TASKS * spark.sparkContext.defaultParallelism))
        entries = dealt.mapInPandas(_list, "listed string, absolute string, uri string")
        entries.write.parquet(f"{folder}/level={level}")
        found = spark.read.schema("listed string, absolute string, uri string").parquet(f"{folder}/level={level}")
        frontier = found.where(F.col("uri").isNotNull()).select("uri")
        level, count = level + 1, frontier.count()
    levels = [f"{folder}/level={n}" for n in range(level)]
    files = spark.read.schema("listed string, absolute string").parquet(*levels).where(F.col("listed").isNotNull())
    return files.where(has_suffix(F.col("listed"), tuple(suffixes)))


def relative_files(
    spark: SparkSession,
    source: str,
    repo_root: str,
    suffixes: Iterable[str],
    ignore_globs: Iterable[str] = (),
) -> DataFrame:
    """(path, absolute) relative to the repository; files outside it or ignored are left out."""
    system, root = _open(repo_root)
    root = _real_path(system, root).rstrip("/") + "/"
    inside = list_files(spark, source, suffixes).where(F.startswith("absolute", F.lit(root)))
    named = inside.select(
        F.expr(f"substring(absolute, {len(root) + 1})").alias("path"), "absolute"
    )
    return named.where(~matches_any_glob(F.col("path"), ignore_globs)).dropDuplicates(["path"])


def _git_log(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    command = ["git", "log", "-c", "--no-renames", "--name-only", "-z", "--format=%x01%H"]
    for frame in frames:
        for root in frame["repo_root"]:
            said = tempfile.TemporaryFile()
            log = subprocess.Popen(command, cwd=root, stdout=subprocess.PIPE, stderr=said)
            sha, order, rest, rows = "", 0, b"", []
            while block := log.stdout.read(1 << 16):
                *entries, rest = (rest + block).split(b"\0")
                for entry in entries:
                    entry = entry.strip(b"\n")
                    if entry.startswith(b"\x01"):
                        head, _, name = entry[1:].partition(b"\n")
                        sha, order = head.decode(), order + 1
                        entry = name.strip(b"\n")
                    if entry:
                        rows.append((entry.decode("utf-8", "replace"), sha, order))
                if rows:
                    yield pd.DataFrame(rows, columns=["path", "commit_sha", "order"])
                    rows = []
            if log.wait():
                said.seek(0)
                reason = said.read().decode("utf-8", "replace").strip()
                raise RuntimeError(f"git log in {root} ended with {log.returncode}: {reason[-500:]}")


def git_shas(spark: SparkSession, repo_root: str) -> DataFrame:
    """(path, commit_sha): the newest commit that touched each tracked path.

    One streamed ``git log`` instead of one process per file; picking the newest row is an
    ordinary aggregation. A log that fails, such as that of a folder without history, fails the job: an
    empty history would look like a tree whose files are all gone.
    """
    roots = spark.createDataFrame([(_open(repo_root)[1],)], "repo_root string")
    touched = roots.mapInPandas(_git_log, "path string, commit_sha string, order long")
    return touched.groupBy("path").agg(F.min_by("commit_sha", "order").alias("commit_sha"))


def _read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for start in range(0, len(frame), _READ_ROWS):
            part = frame.iloc[start : start + _READ_ROWS].copy()
            texts, errors, digests = [], [], []
            for path, uri in zip(part["path"], part["absolute"], strict=True):
                try:
                    system, location = _open(uri)
                    with system.open_input_stream(location) as stream:
                        content = stream.readall()
                    text = content.decode("utf-8", "replace")
                    digests.append(hashlib.sha256(content).hexdigest())
                    texts.append(text.replace("\r\n", "\n").replace("\r", "\n"))
                    errors.append(None)
                except OSError as problem:
                    texts.append(None)
                    digests.append(None)
                    errors.append(f"{path}: {problem}")
            yield part.assign(text=texts, error=errors, digest=digests)


def read_files(files: DataFrame) -> DataFrame:
    """Add ``text`` (UTF-8, bad bytes replaced, ``\\n`` line ends) or ``error`` to each file row, and the
    ``digest`` of its bytes."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in files.schema)
    return files.mapInPandas(_read, f"{schema}, text string, error string, digest string")
