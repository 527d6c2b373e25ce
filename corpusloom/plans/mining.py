"""Contrastive triples from a golden set and the retriever's own near misses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from corpusloom.operators.training import hard_negatives, positives, training_triples
from corpusloom.sources.golden import golden_queries, golden_relevant


def mine_triples(
    chunks: DataFrame,
    items: DataFrame,
    search: Callable[[DataFrame], DataFrame],
    negatives_per_item: int = 3,
) -> DataFrame:
    """(query, positive, hard_negative). ``search`` maps queries to hydrated chunks (pool of 20)."""
    queries, relevant = golden_queries(items), golden_relevant(items)
    negatives = hard_negatives(search(queries), relevant, negatives_per_item)
    triples = training_triples(queries, positives(relevant, chunks), negatives)
    return triples.drop("query_id")
