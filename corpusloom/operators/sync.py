"""The sync diff: what a source tree and the indexed state have in common, and what not."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ADD, UPDATE, DELETE, SKIP, ERROR = "add", "update", "delete", "skip", "error"


def sync_diff(current: DataFrame, existing: DataFrame, force: bool = False) -> DataFrame:
    """(file_path, commit_sha, action) from two (file_path, commit_sha) tables.

    One full outer join on the unique path. Whether a side has a file is told by its row, not by its key: a
    current file with a null key could not be read and is an error, which leaves what is indexed alone; an
    indexed file with a null key is indexed anew. ``force`` turns every unchanged file into an update.
    """
    old = existing.select("file_path", F.col("commit_sha").alias("_old"), F.lit(True).alias("_had"))
    new = current.select("file_path", F.col("commit_sha").alias("_new"), F.lit(True).alias("_has"))
    changed = F.lit(True) if force else ~F.col("_new").eqNullSafe(F.col("_old"))
    action = (
        F.when(F.col("_has").isNull(), DELETE)
        .when(F.col("_new").isNull(), ERROR)
        .when(F.col("_had").isNull(), ADD)
        .when(changed, UPDATE)
        .otherwise(SKIP)
    )
    return old.join(new, "file_path", "full_outer").select(
        "file_path", F.coalesce("_new", "_old").alias("commit_sha"), action.alias("action")
    )


def restrict_to(diff: DataFrame, paths: DataFrame) -> DataFrame:
    """Keep the given files (file_path) only; filtering the diff equals filtering both its sides."""
    return diff.join(paths, "file_path", "left_semi")


def sync_counts(diff: DataFrame) -> DataFrame:
    """One row: files_seen, to_index, files_skipped_unchanged, files_deleted."""
    action = F.col("action")
    return diff.agg(
        F.count_if(action != DELETE).alias("files_seen"),
        F.count_if(action.isin(ADD, UPDATE)).alias("to_index"),
        F.count_if(action == SKIP).alias("files_skipped_unchanged"),
        F.count_if(action == DELETE).alias("files_deleted"),
    )
