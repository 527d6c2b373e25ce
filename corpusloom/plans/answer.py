"""A batch of requests answered end to end: retrieve, rerank, prompt, stream events."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.config import Settings, get_settings
from corpusloom.functions.vectors import get_embedder
from corpusloom.operators.answers import event_stream, get_answerer
from corpusloom.operators.batches import as_batch
from corpusloom.operators.bm25 import Bm25Index
from corpusloom.operators.hydrate import chunk_summary
from corpusloom.operators.requests import split_valid, with_defaults
from corpusloom.operators.rerank import get_reranker
from corpusloom.plans.search import hybrid_search, search_debug


@dataclass(frozen=True)
class AnswerResult:
    events: DataFrame
    reranked: DataFrame
    rejected: DataFrame


def _reranked_debug(reranked: DataFrame) -> DataFrame:
    hits = F.array_sort(F.collect_list(F.struct("rank", "namespace", "path", "score")))
    listed = F.transform(
        hits,
        lambda hit: F.struct(
            hit["namespace"].alias("namespace"),
            hit["path"].alias("file_path"),
            hit["score"].alias("score"),
        ),
    )
    return reranked.groupBy("query_id").agg(listed.alias("reranked_top"))


def answer(
    chunks: DataFrame,
    index: Bm25Index,
    requests: DataFrame,
    settings: Settings | None = None,
    default_namespaces: Sequence[str] | None = None,
    embed: Callable[[Column], Column] | None = None,
    rerank: Callable[[DataFrame, str | int], DataFrame] | None = None,
    answerer: Callable[[DataFrame, DataFrame], DataFrame] | None = None,
    vectors: DataFrame | None = None,
) -> AnswerResult:
    """(query_id, seq, event, data) for every valid request.

    Retrieval always draws the full pool, the reranker cuts it to the request's ``top_k``. Requests
    with retrieval_only never reach the answerer. ``requests`` may bring a ``vector``; otherwise
    the question is embedded.
    """
    settings = settings or get_settings()
    defaults = settings.default_namespaces if default_namespaces is None else default_namespaces
    valid, rejected = split_valid(with_defaults(requests, defaults))
    if "vector" not in valid.columns:
        valid = valid.withColumn("vector", (embed or get_embedder(settings))(F.col("question")))
    valid = as_batch(valid).df

    pool = settings.retriever_top_k
    found = hybrid_search(chunks, index, valid, pool, settings, vectors)
    candidates = found.hydrated.join(valid.select("query_id", "question", "top_k"), "query_id")
    reranked = (rerank or get_reranker(settings))(candidates, "top_k")

    debug = None
    if settings.expose_retrieval_debug:
        debug = search_debug(found, valid).join(_reranked_debug(reranked), "query_id", "left")
    speaking = valid.where(~F.col("retrieval_only"))
    answers = (answerer or get_answerer(settings))(
        speaking, reranked.join(speaking.select("query_id"), "query_id", "left_semi")
    )
    events = event_stream(
        valid, chunk_summary(reranked), answers.select("query_id", "fragments"), debug
    )
    return AnswerResult(events, reranked, rejected)
