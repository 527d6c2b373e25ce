"""Second-stage ordering of a query's candidates (query_id, question, text, rank, …)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.config import MAX_TOP_K, Settings, get_settings
from corpusloom.functions.text import tokenize
from corpusloom.operators.ranking import top_k as best_first

Reranker = Callable[[DataFrame], DataFrame]


class PairModel(Protocol):
    """What an injected cross-encoder has to offer."""

    def predict(self, sentences: list[tuple[str, str]], **options) -> np.ndarray: ...


def _cut(ranked: DataFrame, top_k: str | int) -> DataFrame:
    """``top_k`` is a number or the name of a per-query column."""
    limit = F.col(top_k) if isinstance(top_k, str) else F.lit(top_k)
    return ranked.where(F.col("rank") < limit)


def rerank_identity(candidates: DataFrame, top_k: str | int) -> DataFrame:
    """Keep order and fusion score, cut to ``top_k``."""
    return _cut(candidates.withColumn("score_kind", F.lit("fusion")), top_k)


def rerank_by(candidates: DataFrame, score: Column, top_k: str | int) -> DataFrame:
    """Order by a new score, which replaces the old one; equal scores keep their order.

    The window compares with a constant, the largest ``top_k`` a request may have, so that every input
    partition sends at most that many candidates of a query; a smaller limit is applied behind it.
    """
    most = top_k if isinstance(top_k, int) else MAX_TOP_K
    scored = candidates.withColumnRenamed("rank", "_before").withColumn("score", score.cast("double"))
    ranked = best_first(scored, ["query_id"], [F.col("score").desc(), F.col("_before")], most)
    return _cut(ranked.withColumn("score_kind", F.lit("relevance")).drop("_before"), top_k)


def pair_score(
    question: Column, text: Column, load_model: Callable[[], PairModel], batch_size: int = 32
) -> Column:
    """Relevance of (question, text) pairs from a model each Python worker loads on first use."""

    @F.pandas_udf("double")
    def predict(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = None
        for questions, texts in batches:
            if len(texts) == 0:
                yield pd.Series([], dtype="float64")
                continue
            model = model or load_model()
            pairs = list(zip(questions, texts, strict=True))
            scores = model.predict(pairs, batch_size=batch_size, show_progress_bar=False)
            yield pd.Series(np.asarray(scores, dtype=np.float64), index=texts.index)

    return predict(question, text)


def overlap_score(question: Column, text: Column) -> Column:
    """Share of the question's distinct words found in the text; a model-free stand-in."""
    words = F.array_distinct(tokenize(question))
    found = F.size(F.array_intersect(words, tokenize(text)))
    return F.when(F.size(words) > 0, found / F.size(words)).otherwise(0.0)


def get_reranker(
    settings: Settings | None = None, load_model: Callable[[], PairModel] | None = None
) -> Callable[[DataFrame, str | int], DataFrame]:
    """The reranking strategy the settings ask for."""
    settings = settings or get_settings()
    if settings.reranker_type == "identity":
        return rerank_identity
    if settings.reranker_type == "overlap":
        return lambda df, k: rerank_by(df, overlap_score(F.col("question"), F.col("text")), k)
    if settings.reranker_type == "cross_encoder":

        def load_by_name() -> PairModel:
            from sentence_transformers import CrossEncoder

            return CrossEncoder(settings.cross_encoder_model)

        model = load_model or load_by_name
        return lambda df, k: rerank_by(df, pair_score(F.col("question"), F.col("text"), model), k)
    raise ValueError(f"unknown reranker_type={settings.reranker_type!r}")
