"""Evaluation splits and contrastive triples from a golden set."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import NON_SPACE, strip
from corpusloom.operators.metrics import TRIPLE
from corpusloom.operators.ranking import spread_row_number, top_k

CROSS = "_cross"


def with_stratum(items: DataFrame) -> DataFrame:
    """An item over one namespace belongs to it, all others to ``_cross``."""
    return items.withColumn(
        "stratum", F.when(F.size("namespaces") == 1, F.col("namespaces")[0]).otherwise(CROSS)
    )


def holdout_ids(items: DataFrame, quotas: Mapping[str, int], key: str = "id") -> DataFrame:
    """Ids of evenly spaced items per stratum, in id order: floor(i·step + step/2), step = n/quota.

    The positions a quota picks are computed from the stratum's size, so every row knows by itself
    whether it is picked.
    """
    quota_of = F.create_map(*[x for s, q in quotas.items() for x in (F.lit(s), F.lit(q))])
    listed = items.where(F.col("stratum").isin(*quotas)).select(key, "stratum")
    numbered = spread_row_number(listed, "stratum", key)
    step = F.col("group_size") / F.col("_quota")
    picks = F.transform(
        F.sequence(F.lit(0), F.col("_quota") - 1), lambda i: F.floor(i * step + step / 2)
    )
    picked = numbered.withColumn("_quota", quota_of[F.col("stratum")]).where(
        (F.col("_quota") > 0) & F.array_contains(picks, F.col("position"))
    )
    return picked.select(key, "stratum")


def holdout_split(
    items: DataFrame, quotas: Mapping[str, int], key: str = "id"
) -> tuple[DataFrame, DataFrame]:
    """(train, holdout)."""
    chosen = holdout_ids(with_stratum(items), quotas, key).select(key)
    return items.join(chosen, key, "left_anti"), items.join(chosen, key, "left_semi")


def positives(relevant: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, triple, text): the stripped text of each relevant chunk that has one.

    Several chunks may share a triple; the one with the smallest id speaks. Judgments that fit are
    pinned, so the chunk table is filtered where it lies before anything moves.
    """
    relevant = relevant.select("query_id", *TRIPLE)
    texts = (
        chunks.withColumnRenamed("file_path", "path")
        .join(relevant.select(*TRIPLE).distinct(), TRIPLE, "left_semi")
        .groupBy(*TRIPLE)
        .agg(strip(F.min_by("text", "doc_id")).alias("text"))
    )
    return relevant.join(texts.where(F.col("text") != ""), TRIPLE).select("query_id", *TRIPLE, "text")


def hard_negatives(hydrated: DataFrame, relevant: DataFrame, n: int = 3) -> DataFrame:
    """(query_id, text, rank): the first ``n`` retrieved chunks that are not relevant."""
    wanted = relevant.select("query_id", *TRIPLE)
    others = hydrated.where(F.col("text").rlike(NON_SPACE)).join(
        wanted, ["query_id", *TRIPLE], "left_anti"
    )
    return top_k(
        others.withColumnRenamed("rank", "_hit_rank"), ["query_id"], [F.col("_hit_rank")], n
    ).select("query_id", "text", "rank")


def training_triples(queries: DataFrame, found: DataFrame, negatives: DataFrame) -> DataFrame:
    """(query_id, query, positive, hard_negative).

    The at most ``n`` negatives of a query travel as one array, so a query with very many positives
    multiplies no group. Queries without positives or without negatives give nothing.
    """
    lists = negatives.groupBy("query_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda row: row["text"]
        ).alias("_negatives")
    )
    asked = queries.select("query_id", F.col("question").alias("query")).join(lists, "query_id")
    return found.select("query_id", F.col("text").alias("positive")).join(asked, "query_id").select(
        "query_id", "query", "positive", F.explode("_negatives").alias("hard_negative")
    )
