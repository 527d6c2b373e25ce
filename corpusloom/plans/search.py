"""Hybrid search for a batch of requests as one plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.config import Settings, get_settings
from corpusloom.operators.batches import as_batch
from corpusloom.operators.bm25 import Bm25Index, bm25_search
from corpusloom.operators.bounds import MAX_BROADCAST_ROWS
from corpusloom.operators.dense import dense_search
from corpusloom.operators.fusion import cross_namespace_fuse, hybrid_fuse
from corpusloom.operators.hydrate import hydrate
from corpusloom.operators.requests import answerable


@dataclass(frozen=True)
class SearchResult:
    """The stages of a search, all lazy: ids are ranked first, texts join last. A batch without bound keeps its ranked
    ids with the executors until they are unpersisted."""

    bm25: DataFrame
    dense: DataFrame
    fused: DataFrame
    ranked: DataFrame
    hydrated: DataFrame


def hybrid_search(
    chunks: DataFrame,
    index: Bm25Index,
    queries: DataFrame,
    top_k: int = 10,
    settings: Settings | None = None,
    vectors: DataFrame | None = None,
) -> SearchResult:
    """BM25 and cosine pools per namespace, fused, fused again across namespaces, hydrated.

    ``queries`` holds query_id, question, namespaces and vector. ``vectors`` (doc_id, namespace,
    embedding) may replace the embedding column of ``chunks``.
    """
    settings = settings or get_settings()
    pool = settings.retriever_top_k
    batch = as_batch(answerable(queries))
    bm25 = bm25_search(index, batch, pool, settings)
    dense = dense_search(chunks if vectors is None else vectors, batch, pool)
    fused = hybrid_fuse(bm25, dense)
    ranked = cross_namespace_fuse(fused, batch.df, top_k)
    small = batch.bounded and batch.rows.num_rows * top_k <= MAX_BROADCAST_ROWS
    if not small:  # read twice: to filter the chunks, and to join them
        ranked = ranked.persist(StorageLevel.MEMORY_AND_DISK)
    return SearchResult(bm25, dense, fused, ranked, hydrate(ranked, chunks, small))


def search_debug(result: SearchResult, queries: DataFrame) -> DataFrame:
    """(query_id, bm25_top, dense_top, rrf_top) for every query; empty arrays where nothing hit.

    A query has at most pool x namespaces hits, which bounds the arrays. Retriever hits come in
    the order the request names the namespaces, final hits in rank order.
    """
    places = queries.select(
        "query_id", F.posexplode(F.array_distinct("namespaces")).alias("_place", "namespace")
    )
    empty = F.array().cast("array<struct<namespace:string,doc_id:string,score:double>>")
    out = queries.select("query_id")
    for name, hits in (
        ("bm25_top", result.bm25.join(places, ["query_id", "namespace"])),
        ("dense_top", result.dense.join(places, ["query_id", "namespace"])),
        ("rrf_top", result.ranked.withColumn("_place", F.lit(0))),
    ):
        ordered = F.array_sort(
            F.collect_list(F.struct("_place", "rank", "namespace", "doc_id", "score"))
        )
        triples = F.transform(
            ordered,
            lambda hit: F.struct(
                hit["namespace"].alias("namespace"),
                hit["doc_id"].alias("doc_id"),
                hit["score"].alias("score"),
            ),
        )
        out = out.join(hits.groupBy("query_id").agg(triples.alias(name)), "query_id", "left")
        out = out.withColumn(name, F.coalesce(F.col(name), empty))
    return out
