"""Reciprocal rank fusion. A hit at 0-based rank r contributes 1 / (k + r + 1)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.config import RRF_K
from corpusloom.operators.ranking import top_k as first


def _term(k: int) -> Column:
    return F.lit(1.0) / (F.lit(float(k)) + F.col("rank") + F.lit(1.0))


def _ordered_sum(list_no: str, k: int) -> Column:
    """Terms added in list order, so that more than two of them give one reproducible double.

    A document has one entry per input list, which bounds the collected array.
    """
    terms = F.array_sort(F.collect_list(F.struct(F.col(list_no), _term(k).alias("term"))))
    return F.aggregate(terms, F.lit(0.0), lambda total, entry: total + entry["term"])


def _ranked(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    window = W.partitionBy(*by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(window) - 1)


def rrf(ranked: DataFrame, by: Sequence[str] = ("query_id",), k: int = RRF_K) -> DataFrame:
    """Fuse any number of lists: input (*by, list_no, doc_id, rank), output (…, score, rank).

    Ties keep the order of first appearance, reading the lists one after the other.
    """
    fused = ranked.groupBy(*by, "doc_id").agg(
        _ordered_sum("list_no", k).alias("score"),
        F.min(F.struct("list_no", "rank")).alias("_first"),
    )
    return _ranked(fused, by, [F.col("score").desc(), F.col("_first")]).drop("_first")


def hybrid_fuse(bm25_hits: DataFrame, dense_hits: DataFrame, k: int = RRF_K) -> DataFrame:
    """Fuse the two retrievers per (query, namespace); ties by best rank, then id.

    The full outer merge on doc_id is a union and one aggregation: a sum of two doubles does not
    depend on their order.
    """
    columns = ["query_id", "namespace", "doc_id", "rank"]
    both = bm25_hits.select(*columns).unionByName(dense_hits.select(*columns))
    fused = both.groupBy("query_id", "namespace", "doc_id").agg(
        F.sum(_term(k)).alias("score"), F.min("rank").alias("min_rank")
    )
    order = [F.col("score").desc(), F.col("min_rank"), F.col("doc_id")]
    return _ranked(fused, ["query_id", "namespace"], order)


def cross_namespace_fuse(
    fused: DataFrame, queries: DataFrame, top_k: int = 50, k: int = RRF_K
) -> DataFrame:
    """Fuse the namespaces of each query: (query_id, namespace, doc_id, score, rank).

    A query over one namespace keeps its first-level scores; with several, the first-level ranks
    are fused again. Ties: best rank in any namespace, then id. An id found in several namespaces
    belongs to the one the request names first.
    """
    places = queries.select("query_id", F.array_distinct("namespaces").alias("_asked")).select(
        "query_id",
        F.size("_asked").alias("_n_asked"),
        F.posexplode("_asked").alias("_position", "namespace"),
    )
    placed = fused.join(places, ["query_id", "namespace"])
    merged = placed.groupBy("query_id", "doc_id").agg(
        F.min_by("namespace", "_position").alias("namespace"),
        F.when(F.max("_n_asked") == 1, F.max("score"))
        .otherwise(_ordered_sum("_position", k))
        .alias("score"),
        F.min("rank").alias("min_rank"),
    )
    order = [F.col("score").desc(), F.col("min_rank"), F.col("doc_id")]
    ranked = first(merged, ["query_id"], order, top_k)
    return ranked.select("query_id", "namespace", "doc_id", "score", "rank")
