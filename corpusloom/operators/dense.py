"""Exact cosine retrieval for a batch of queries.

Vectors meet queries as matrices, and each product keeps the best ``k`` per query and namespace, so no (query, document)
pair table ever exists. A batch of a checked size is shipped to the corpus, which stays where it lies. Any other batch is
cut into blocks, and so is the corpus; each cell of this grid is one group of a cogroup.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.batches import MAX_BATCH_QUERIES, QueryBatch, as_batch
from corpusloom.operators.blocks import MAX_CELLS, PartialTopK, by_namespace, id_array
from corpusloom.operators.ranking import by_score, top_k

#: Vectors of a cell of the grid, 64 MB of doubles at 1,024 dimensions; it has the queries of a bounded batch.
DOCS_PER_CELL = 8192


def _unit(matrix: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(norms == 0, 1.0, norms)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors as rows; one of another length than the first is named."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.asarray(column.value_lengths())
    odd = np.flatnonzero(lengths != lengths[0]) if len(lengths) else lengths
    if len(odd):
        raise ValueError(f"a vector of {lengths[odd[0]]} entries among vectors of {lengths[0]}")
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def _scorer(query_ids: pa.Array, unit_queries: np.ndarray, wanted: dict[str, np.ndarray], k: int):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = PartialTopK(query_ids, k)
        for batch in batches:
            for namespace, part in by_namespace(batch, wanted, len(query_ids)):
                corpus = _unit(_matrix(part.column("embedding")))
                slots = wanted[namespace]
                doc_ids = part.column("doc_id").combine_chunks()
                yield best.rows(namespace, slots, doc_ids, corpus @ unit_queries[slots].T)

    return score


def _one_pass(vectors: DataFrame, batch: QueryBatch, k: int) -> DataFrame | None:
    """Partial top-k rows for a bounded batch of queries."""
    rows = [
        (query_id, set(namespaces), vector)
        for query_id, namespaces, vector in zip(
            *(batch.rows.column(c).to_pylist() for c in ("query_id", "namespaces", "vector")),
            strict=True,
        )
        if namespaces and vector
    ]
    if not rows:
        return None
    query_ids = id_array([row[0] for row in rows], batch.df.schema["query_id"].dataType)
    unit_queries = _unit(np.array([row[2] for row in rows], dtype=np.float64))
    asked: dict[str, list[int]] = {}
    for slot, row in enumerate(rows):
        for namespace in row[1]:
            asked.setdefault(namespace, []).append(slot)
    wanted = {namespace: np.array(slots) for namespace, slots in asked.items()}
    if len(wanted) <= 1000:
        vectors = vectors.where(F.col("namespace").isin(*wanted))
    return vectors.mapInArrow(
        _scorer(query_ids, unit_queries, wanted, k), _hit_schema(vectors, batch.df)
    )


def _hit_schema(chunks: DataFrame, queries: DataFrame) -> str:
    query_type = queries.schema["query_id"].dataType.simpleString()
    doc_type = chunks.schema["doc_id"].dataType.simpleString()
    return f"query_id {query_type}, namespace string, doc_id {doc_type}, score double"


def dense_grid(vectors: DataFrame, queries: DataFrame, k: int, docs_per_cell: int | None = None, queries_per_cell: int | None = None) -> DataFrame:
    """Partial top-k rows for any number of queries, in one plan.

    The corpus of each namespace is dealt by document into parts and its queries into blocks, so that a cell holds about
    ``docs_per_cell`` vectors and ``queries_per_cell`` queries. A vector moves once for each block of its namespace's
    queries, a query once for each part of the corpus; a cell sends on at most ``k`` rows a query. The numbers of parts
    and blocks follow the counts of each namespace, a table of one row for each, which is joined, not collected.
    """
    docs_per_cell, queries_per_cell = docs_per_cell or DOCS_PER_CELL, queries_per_cell or MAX_BATCH_QUERIES
    asked = queries.where(F.col("vector").isNotNull() & (F.size("vector") > 0))
    asked = asked.select("query_id", F.explode(F.array_distinct("namespaces")).alias("namespace"), "vector").where("namespace IS NOT NULL")
    docs = vectors.groupBy("namespace").agg(F.ceil(F.count("*") / F.lit(docs_per_cell)).cast("int").alias("parts"))
    blocks = asked.groupBy("namespace").agg(F.ceil(F.count("*") / F.lit(queries_per_cell)).cast("int").alias("blocks"))
    grid = docs.join(blocks, "namespace")

    def every(count: str, name: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1)).alias(name)

    def one(count: str, key: str) -> Column:
        return F.pmod(F.xxhash64(key), F.col(count)).cast("int")

    left = vectors.join(grid, "namespace").withColumn("part", one("parts", "doc_id"))
    left = left.select("namespace", "part", every("blocks", "block"), "doc_id", "embedding")
    right = asked.join(grid, "namespace").withColumn("block", one("blocks", "query_id"))
    right = right.select("namespace", every("parts", "part"), "block", "query_id", "vector")
    schema = _hit_schema(vectors, queries)

    def cell(key: tuple[pa.Scalar, ...], docs: pa.Table, asked: pa.Table) -> pa.Table:
        namespace = key[0].as_py()
        found: list[pa.RecordBatch] = []
        if docs.num_rows and asked.num_rows:
            docs = docs.sort_by("doc_id")
            ids = asked.column("query_id").combine_chunks()
            unit_queries = _unit(_matrix(asked.column("vector")))
            best = PartialTopK(ids, k)
            step = max(1, MAX_CELLS // asked.num_rows)
            for at in range(0, docs.num_rows, step):
                part = docs.slice(at, step)
                scores = _unit(_matrix(part.column("embedding"))) @ unit_queries.T
                found.append(best.rows(namespace, np.arange(asked.num_rows), part.column("doc_id").combine_chunks(), scores))
        empty = pa.schema([("query_id", asked.schema.field("query_id").type), ("namespace", pa.string()), ("doc_id", docs.schema.field("doc_id").type), ("score", pa.float64())])
        return pa.Table.from_batches(found, None if found else empty)

    keys = ("namespace", "part", "block")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(cell, schema)


def dense_search(chunks: DataFrame, queries: DataFrame | QueryBatch, k: int = 50) -> DataFrame:
    """(query_id, namespace, doc_id, score, rank): the ``k`` nearest chunks per namespace.

    ``queries`` holds query_id, namespaces and vector; ``chunks`` doc_id, namespace and embedding.
    Ties go to the smaller id. Every vector has the same length.
    """
    vectors = chunks.where(F.col("embedding").isNotNull()).select("doc_id", "namespace", "embedding")
    batch = as_batch(queries)
    partial = _one_pass(vectors, batch, k) if batch.bounded else dense_grid(vectors, batch.df, k)
    if partial is None:
        partial = chunks.sparkSession.createDataFrame([], _hit_schema(chunks, batch.df))
    return top_k(partial, ["query_id", "namespace"], [by_score("score"), F.col("doc_id")], k)


def dense_search_grid(chunks: DataFrame, queries: DataFrame, k: int = 50, **cells: int) -> DataFrame:
    """``dense_search`` through the grid, whatever the size of the batch."""
    vectors = chunks.where(F.col("embedding").isNotNull()).select("doc_id", "namespace", "embedding")
    partial = dense_grid(vectors, queries, k, **cells)
    return top_k(partial, ["query_id", "namespace"], [by_score("score"), F.col("doc_id")], k)
