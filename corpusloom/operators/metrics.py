"""Ranking quality per query and averaged: recall, precision and reciprocal rank."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRIPLE = ["namespace", "path", "symbol"]


def judged(retrieved: DataFrame, relevant: DataFrame) -> DataFrame:
    """Mark retrieved chunks (query_id, rank, triple) with ``hit``."""
    wanted = relevant.select("query_id", *TRIPLE).distinct().withColumn("_wanted", F.lit(True))
    joined = retrieved.select("query_id", "rank", *TRIPLE).join(
        wanted, ["query_id", *TRIPLE], "left"
    )
    return joined.withColumn("hit", F.col("_wanted").isNotNull()).drop("_wanted")


def query_metrics(
    queries: DataFrame,
    retrieved: DataFrame,
    relevant: DataFrame,
    recall_at: Sequence[int] = (5, 10),
    precision_at: Sequence[int] = (5,),
    mrr_at: Sequence[int] = (10,),
) -> DataFrame:
    """One row per query of ``queries``: retrieved_count and the metrics.

    Recall counts every retrieved row whose triple is relevant over the number of distinct relevant
    triples, so repeated triples may lift it above 1. Nothing relevant: recall and reciprocal rank
    are 1. Nothing retrieved: precision is 0. All counters come from one aggregation.
    """
    hit, rank = F.col("hit"), F.col("rank")

    counters = [F.count("*").alias("retrieved_count")]
    for k in {*recall_at, *precision_at}:
        counters.append(F.count_if(hit & (rank < k)).alias(f"_hits_{k}"))
    for k in precision_at:
        counters.append(F.count_if(rank < k).alias(f"_seen_{k}"))
    for k in mrr_at:
        counters.append(F.min(F.when(hit & (rank < k), rank + 1)).alias(f"_first_{k}"))
    seen = judged(retrieved, relevant).groupBy("query_id").agg(*counters)
    totals = relevant.select("query_id", *TRIPLE).distinct().groupBy("query_id").agg(
        F.count("*").alias("_relevant")
    )
    joined = queries.select("query_id").join(seen, "query_id", "left").join(totals, "query_id", "left")
    nothing = F.col("_relevant").isNull()

    def zero(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0))

    metrics = {"retrieved_count": zero("retrieved_count")}
    for k in recall_at:
        share = zero(f"_hits_{k}") / F.col("_relevant")
        metrics[f"recall_at_{k}"] = F.when(nothing, 1.0).otherwise(share)
    for k in mrr_at:
        inverse = F.coalesce(1.0 / F.col(f"_first_{k}"), F.lit(0.0))
        metrics[f"mrr_at_{k}"] = F.when(nothing, 1.0).otherwise(inverse)
    for k in precision_at:
        share = F.when(zero(f"_seen_{k}") > 0, zero(f"_hits_{k}") / F.col(f"_seen_{k}"))
        metrics[f"precision_at_{k}"] = F.coalesce(share, F.lit(0.0))
    return joined.select("query_id", *[value.alias(name) for name, value in metrics.items()])


def aggregate_metrics(per_query: DataFrame) -> DataFrame:
    """One row: items, evaluated, skipped and the means over queries not skipped."""
    skipped = F.col("skipped") if "skipped" in per_query.columns else F.lit(False)
    names = [c for c in per_query.columns if "_at_" in c]
    return per_query.agg(
        F.count("*").alias("items"),
        F.count_if(~skipped).alias("evaluated"),
        F.count_if(skipped).alias("skipped"),
        *[F.coalesce(F.avg(F.when(~skipped, F.col(c))), F.lit(0.0)).alias(c) for c in names],
    )


def mean_recall(
    queries: DataFrame, retrieved: DataFrame, relevant: DataFrame, k: int = 10
) -> DataFrame:
    """One row: recall@k averaged over queries with a retrieved chunk; none → 0."""
    scored = query_metrics(queries, retrieved, relevant, [k], [], [])
    value = F.when(F.col("retrieved_count") > 0, F.col(f"recall_at_{k}"))
    return scored.agg(
        F.count(value).alias("evaluated"), F.coalesce(F.avg(value), F.lit(0.0)).alias("recall")
    )
