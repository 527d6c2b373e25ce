"""Retrieval evaluation over a golden set, all queries in one plan."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.config import Settings
from corpusloom.operators.batches import as_batch
from corpusloom.operators.bm25 import Bm25Index
from corpusloom.operators.bounds import MAX_BROADCAST_ROWS, hint_small
from corpusloom.operators.dense import dense_search
from corpusloom.operators.metrics import aggregate_metrics, mean_recall, query_metrics
from corpusloom.operators.ranking import by_score
from corpusloom.operators.ranking import top_k as first
from corpusloom.plans.search import hybrid_search
from corpusloom.sources.golden import golden_queries, golden_relevant


@dataclass
class EvalReport:
    items: int
    evaluated: int = 0
    skipped: int = 0
    aggregate: dict[str, float] = field(default_factory=dict)
    error: str | None = None
    reasons: dict[str, str] = field(default_factory=dict)

    def passes(self, min_recall: float | None) -> bool:
        """The gate looks at recall@10 of what was evaluated. Items skipped by their own failure do not fail it,
        unless nothing else is left."""
        if min_recall is None:
            return True
        if self.evaluated == 0:
            return not self.reasons and not self.skipped and self.error is None
        return self.aggregate["recall_at_10"] >= min_recall


@dataclass(frozen=True)
class Searched:
    """Hits of the questions that could be answered, and (query_id, error) of the others."""

    hits: DataFrame
    failures: DataFrame


def score_apart(queries: DataFrame, searched: Searched, relevant: DataFrame) -> DataFrame:
    """Metrics of every query, in one plan; those that failed are ``skipped`` and bear their ``error``."""
    failed = searched.failures.groupBy("query_id").agg(F.min("error").alias("error"))
    scored = query_metrics(queries, searched.hits, relevant).join(failed, "query_id", "left")
    return scored.withColumn("skipped", F.col("error").isNotNull())


def evaluate_apart(search: Callable[[DataFrame], Searched], items: DataFrame) -> tuple[EvalReport, DataFrame | None]:
    """(report, per-query rows) of a search that tells by row which questions it could not answer.

    One job, however many fail, and no list of questions on the driver; the rows hold each error. What is not the
    fault of a question, such as a lost store, is raised.
    """
    total = items.count()
    if total == 0:
        return EvalReport(0, error="dataset empty or not found"), None
    queries = golden_queries(items)
    per_query = score_apart(queries, search(queries), golden_relevant(items)).persist()
    row = aggregate_metrics(per_query).first().asDict()
    means = {name: value for name, value in row.items() if "_at_" in name}
    report = EvalReport(total, row["evaluated"], row["skipped"], means)
    if not report.evaluated:
        report.error = per_query.agg(F.min("error")).first()[0]
    return report, per_query


def _search_apart(search: Callable[[DataFrame], DataFrame], queries: DataFrame) -> tuple[list[DataFrame], dict[str, str]]:
    """Persisted hits of the queries that can be answered, and why others cannot.

    All are tried as one job; where that fails, each half by itself, down to single queries.
    """
    found: list[DataFrame] = []
    reasons: dict[str, str] = {}

    def attempt(ids: list) -> None:
        try:
            hits = search(queries.where(F.col("query_id").isin(ids))).persist()
            hits.count()
            found.append(hits)
        except Exception as problem:
            if len(ids) == 1:
                reasons[str(ids[0])] = str(problem)
            else:
                attempt(ids[: len(ids) // 2])
                attempt(ids[len(ids) // 2 :])

    wanted = [row[0] for row in queries.select("query_id").distinct().orderBy("query_id").collect()]
    attempt(wanted)
    return found, reasons


def evaluate(
    search: Callable[[DataFrame], DataFrame], items: DataFrame
) -> tuple[EvalReport, DataFrame | None]:
    """(report, per-query rows). ``search`` maps queries to hydrated chunks.

    Retrieval runs as one job. If that fails, the items that cause it are found and skipped, each with its reason.
    """
    total = items.count()
    if total == 0:
        return EvalReport(0, error="dataset empty or not found"), None
    queries = golden_queries(items)
    found, reasons = _search_apart(search, queries)
    if not found:
        return EvalReport(total, skipped=total, error=next(iter(reasons.values())), reasons=reasons), None
    answered = queries.where(~F.col("query_id").cast("string").isin(*reasons)) if reasons else queries
    hits = reduce(DataFrame.unionByName, found)
    per_query = query_metrics(answered, hits, golden_relevant(items)).persist()
    row = aggregate_metrics(per_query).first().asDict()
    for part in found:
        part.unpersist()
    means = {name: value for name, value in row.items() if "_at_" in name}
    report = EvalReport(total, row["evaluated"], row["skipped"] + len(reasons), means, reasons=reasons)
    return report, per_query


def hybrid_searcher(
    chunks: DataFrame,
    index: Bm25Index,
    embed: Callable[[Column], Column],
    top_k: int = 10,
    settings: Settings | None = None,
) -> Callable[[DataFrame], DataFrame]:
    """Hybrid search without reranking, as the evaluation uses it."""

    def search(queries: DataFrame) -> DataFrame:
        asked = queries.withColumn("vector", embed(F.col("question")))
        return hybrid_search(chunks, index, asked, top_k, settings).hydrated

    return search


def guarded_searcher(
    chunks: DataFrame,
    index: Bm25Index,
    embed_or_error: Callable[[Column], Column],
    top_k: int = 10,
    settings: Settings | None = None,
    vectors: DataFrame | None = None,
) -> Callable[[DataFrame], Searched]:
    """Hybrid search of the questions that can be embedded; ``embed_or_error`` gives (vector, error) of a text."""

    def search(queries: DataFrame) -> Searched:
        made = queries.withColumn("_made", embed_or_error(F.col("question"))).persist()
        asked = made.where(F.col("_made.error").isNull()).withColumn("vector", F.col("_made.vector")).drop("_made")
        failures = made.where(F.col("_made.error").isNotNull()).select("query_id", F.col("_made.error").alias("error"))
        return Searched(hybrid_search(chunks, index, asked, top_k, settings, vectors).hydrated, failures)

    return search


def dense_ranking(
    chunks: DataFrame,
    queries: DataFrame,
    embed: Callable[[Column], Column] | None = None,
    top_k: int = 10,
) -> DataFrame:
    """(query_id, namespace, path, symbol, rank) by cosine alone, over all asked namespaces.

    Each namespace yields its ``top_k``; their merge holds the overall ``top_k``.
    """
    if embed is not None:
        chunks = chunks.withColumn("embedding", embed(F.col("text")))
        queries = queries.withColumn("vector", embed(F.col("question")))
    batch = as_batch(queries)
    hits = dense_search(chunks, batch, top_k).drop("rank")
    best = first(hits, ["query_id"], [by_score("score"), F.col("doc_id")], top_k)
    named = chunks.select("namespace", "doc_id", F.col("file_path").alias("path"), "symbol")
    small = batch.bounded and batch.rows.num_rows * top_k <= MAX_BROADCAST_ROWS
    return named.join(hint_small(best, small), ["namespace", "doc_id"]).select(
        "query_id", "namespace", "path", "symbol", "rank"
    )


def compare_models(
    chunks: DataFrame,
    items: DataFrame,
    models: Mapping[str, Callable[[Column], Column] | None],
    top_k: int = 10,
    errors: dict[str, str] | None = None,
) -> dict[str, float | None]:
    """Mean dense recall@k per model. A missing model is None; so is one that fails, with the reason in ``errors``."""
    queries, relevant = golden_queries(items), golden_relevant(items)
    results: dict[str, float | None] = {}
    for label, embed in models.items():
        if embed is None:
            results[label] = None
            continue
        try:
            ranking = dense_ranking(chunks, queries, embed, top_k)
            results[label] = mean_recall(queries, ranking, relevant, top_k).first()["recall"]
        except Exception as problem:
            results[label] = None
            if errors is not None:
                errors[label] = str(problem)
    return results
