"""The chunk table on shared storage: parquet written in generations, merged on read.

    chunks/gen=N/namespace=…    rows added by commit N (rows with ``error`` mark failed files)
    removed/gen=N               keys whose older rows are gone since commit N
    commits/N                   JSON marker; without it generation N does not exist

A commit costs what it changes, not the size of the table. Readers see committed generations only,
so a job lost half-way leaves nothing behind, and repeating it is safe. One writer at a time.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.operators.bounds import MAX_BROADCAST_ROWS, hint_small
from corpusloom.schemas import CHUNKS

_REMOVED = "namespace string, file_path string, doc_id string"
_STORED = T.StructType(
    [
        *(f for f in CHUNKS.fields if f.name != "namespace"),
        T.StructField("error", T.StringType()),
        T.StructField("gen", T.LongType()),
        T.StructField("namespace", T.StringType()),
    ]
)


def as_stored(chunks: DataFrame) -> DataFrame:
    """All stored columns; those a chunk table lacks are null."""
    return chunks.select(
        *[
            F.col(f.name) if f.name in chunks.columns else F.lit(None).cast(f.dataType).alias(f.name)
            for f in _STORED
            if f.name != "gen"
        ]
    )


def first_shas(chunks: DataFrame) -> DataFrame:
    """(file_path, commit_sha): the chunk with the smallest id speaks for its file."""
    return chunks.groupBy("file_path").agg(F.min_by("commit_sha", "doc_id").alias("commit_sha"))


@dataclass(frozen=True)
class Commit:
    gen: int
    base: int
    removed_files: int
    removed_ids: int
    has_chunks: bool


class ChunkStore:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark._jvm
        hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
        return hadoop_path.getFileSystem(self.spark._jsc.hadoopConfiguration()), hadoop_path

    def commits(self) -> list[Commit]:
        """Committed generations since the last compaction, oldest first."""
        system, folder = self._fs(f"{self.path}/commits")
        if not system.exists(folder):
            return []
        lines = self.spark.read.text(f"{self.path}/commits").collect()
        found = sorted((Commit(**json.loads(row[0])) for row in lines), key=lambda c: c.gen)
        return [commit for commit in found if commit.gen >= found[-1].base]

    def _commit(self, commit: Commit) -> None:
        system, target = self._fs(f"{self.path}/commits/{commit.gen:08d}.json")
        staged = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_staged-{commit.gen:08d}")
        out = system.create(staged, True)
        out.write(bytearray(json.dumps(vars(commit)).encode()))
        out.close()
        system.mkdirs(target.getParent())
        if system.exists(target) or not system.rename(staged, target):
            raise RuntimeError(f"generation {commit.gen} was committed by another writer")

    def rows_of(self, commits: list[Commit]) -> DataFrame:
        """Rows as written by the given commits, failed files included."""
        folders = [f"{self.path}/chunks/gen={c.gen}" for c in commits if c.has_chunks]
        if not folders:
            return self.spark.createDataFrame([], _STORED)
        reader = self.spark.read.schema(_STORED).option("basePath", f"{self.path}/chunks")
        return reader.parquet(*folders)

    def _removed(self, commits: list[Commit]) -> DataFrame:
        folders = [
            f"{self.path}/removed/gen={c.gen}" for c in commits if c.removed_files + c.removed_ids
        ]
        reader = self.spark.read.schema(f"{_REMOVED}, gen long")
        return reader.option("basePath", f"{self.path}/removed").parquet(*folders)

    def read(self, *namespaces: str) -> DataFrame:
        """Live chunks, of the given namespaces or of all; other partitions are not opened."""
        commits = self.commits()
        rows = self.rows_of(commits)
        if namespaces:
            rows = rows.where(F.col("namespace").isin(*namespaces))
        for key, n in (
            ("file_path", sum(c.removed_files for c in commits)),
            ("doc_id", sum(c.removed_ids for c in commits)),
        ):
            if not n:
                continue
            gone = self._removed(commits).where(F.col(key).isNotNull())
            last = gone.groupBy("namespace", key).agg(F.max("gen").alias("_gone_since"))
            if namespaces:
                last = last.where(F.col("namespace").isin(*namespaces))
            last = hint_small(last, n <= MAX_BROADCAST_ROWS).alias("g")
            same = (F.col("r.namespace") == F.col("g.namespace")) & (
                F.col(f"r.{key}") == F.col(f"g.{key}")
            )
            older = F.col("r.gen") < F.col("g._gone_since")
            rows = rows.alias("r").join(last, same & older, "left_anti")
        return rows.where(F.col("error").isNull()).select(*CHUNKS.names)

    def apply(
        self,
        chunks: DataFrame | None = None,
        removed_files: DataFrame | None = None,
        removed_ids: DataFrame | None = None,
        after_write=None,
    ) -> Commit:
        """Commit new rows and removals (namespace, file_path / doc_id) in one step.

        ``after_write`` gets the rows just written and may return the file removals that depend on
        how they came out.
        """
        history = self.commits()
        gen = history[-1].gen + 1 if history else 1
        base = history[-1].base if history else 1
        has_chunks = chunks is not None
        written = None
        if has_chunks:
            (
                as_stored(chunks)
                .sortWithinPartitions("namespace", "file_path")
                .write.mode("overwrite")
                .partitionBy("namespace")
                .parquet(f"{self.path}/chunks/gen={gen}")
            )
            written = self.rows_of([Commit(gen, base, 0, 0, True)])
        if after_write is not None:
            removed_files = after_write(written)
        counts = []
        gone = None
        for part in (removed_files, removed_ids):
            if part is not None:
                part = part.select(
                    *[
                        F.col(c) if c in part.columns else F.lit(None).cast("string").alias(c)
                        for c in ("namespace", "file_path", "doc_id")
                    ]
                )
                gone = part if gone is None else gone.unionByName(part)
        if gone is not None:
            target = f"{self.path}/removed/gen={gen}"
            gone.write.mode("overwrite").parquet(target)
            kept = self.spark.read.schema(_REMOVED).parquet(target)
            counts = kept.agg(F.count("file_path"), F.count("doc_id")).first()
        files, ids = (int(n) for n in counts) if counts else (0, 0)
        commit = Commit(gen, base, files, ids, has_chunks)
        self._commit(commit)
        return commit

    def upsert(self, points: DataFrame) -> Commit | None:
        """Insert chunks or replace those with the same id; an empty input commits nothing."""
        if points.isEmpty():
            return None
        return self.apply(as_stored(points), removed_ids=points.select("namespace", "doc_id"))

    def delete_files(self, files: DataFrame) -> Commit:
        return self.apply(removed_files=files)

    def compact(self) -> Commit:
        """Rewrite the live rows as one generation that later reads start from."""
        gen = self.commits()[-1].gen + 1
        live = as_stored(self.read()).write.mode("overwrite").partitionBy("namespace")
        live.parquet(f"{self.path}/chunks/gen={gen}")
        commit = Commit(gen, gen, 0, 0, True)
        self._commit(commit)
        return commit

    def file_shas(self, namespace: str) -> DataFrame:
        """(file_path, commit_sha) already indexed."""
        rows = self.read(namespace).where(
            F.col("file_path").isNotNull() & F.col("commit_sha").isNotNull()
        )
        return first_shas(rows)

    def texts(self, *namespaces: str) -> DataFrame:
        """(doc_id, namespace, text) for indexing; chunks without text are skipped."""
        return self.read(*namespaces).where(F.col("text") != "").select("doc_id", "namespace", "text")

    def count(self, *namespaces: str) -> int:
        return self.read(*namespaces).count()

    def exists(self) -> bool:
        return bool(self.commits())
