"""A look at retrieval: how long each stage takes and what it leaves of every question."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from corpusloom.config import Settings, get_settings
from corpusloom.operators.bm25 import Bm25Index
from corpusloom.operators.rerank import get_reranker
from corpusloom.plans.search import hybrid_search

STAGES = ("bm25", "dense", "ranked", "hydrated", "final")


@dataclass(frozen=True)
class Probe:
    """``questions``: (query_id, question, bm25, dense, ranked, hydrated, final, hits), the stages as numbers of rows. ``seconds`` and
    ``rows`` are those of each stage for the whole batch."""

    questions: DataFrame
    seconds: dict[str, float]
    rows: dict[str, int]


def probe(
    chunks: DataFrame,
    index: Bm25Index,
    queries: DataFrame,
    top_k: int = 5,
    settings: Settings | None = None,
    rerank: bool = True,
    reranker: Callable[[DataFrame, int], DataFrame] | None = None,
    vectors: DataFrame | None = None,
) -> Probe:
    """The stages of a search of (query_id, question, namespaces, vector), run and timed one after the other.

    With ``rerank`` the full pool goes to the reranker, without it ``top_k`` fused hits are final. Each stage is kept with the
    executors for the next one, so its time is its own; its rows are counted by the job that makes them.
    """
    settings = settings or get_settings()
    found = hybrid_search(chunks, index, queries, settings.retriever_top_k if rerank else top_k, settings, vectors)
    final = found.hydrated
    if rerank:
        candidates = found.hydrated.join(queries.select("query_id", "question"), "query_id")
        final = (reranker or get_reranker(settings))(candidates, top_k)
    parts = dict(zip(STAGES, (found.bm25, found.dense, found.ranked, found.hydrated, final), strict=True))
    seconds, rows = {}, {}
    for name, part in parts.items():
        part.persist(StorageLevel.MEMORY_AND_DISK)
        counted = Observation(name)
        started = time.perf_counter()
        part.observe(counted, F.count(F.lit(1)).alias("rows")).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
        rows[name] = counted.get["rows"]

    hit = F.struct("rank", "score", "path", F.col("metadata")["heading_path"].alias("heading_path"), "symbol")
    out = queries.select("query_id", "question")
    for name, part in parts.items():
        out = out.join(part.groupBy("query_id").agg(F.count("*").alias(name)), "query_id", "left")
    hits = final.groupBy("query_id").agg(F.array_sort(F.collect_list(hit)).alias("hits"))  # at most top_k
    out = out.join(hits, "query_id", "left").fillna(0, list(STAGES))
    return Probe(out.withColumn("hits", F.coalesce("hits", F.array())), seconds, rows)
