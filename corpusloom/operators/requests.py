"""Query requests (query_id, question, namespaces, top_k, retrieval_only): defaults and checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.config import MAX_QUESTION_CHARS, MAX_TOP_K
from corpusloom.functions.text import is_blank


def with_defaults(requests: DataFrame, default_namespaces: Sequence[str] = ()) -> DataFrame:
    """Fill namespaces (empty → defaults), top_k (10) and retrieval_only (false)."""
    defaults = F.array(*[F.lit(n) for n in default_namespaces]).cast("array<string>")
    given = {
        "namespaces": defaults,
        "top_k": F.lit(10),
        "retrieval_only": F.lit(False),
    }
    for name, value in given.items():
        known = F.coalesce(F.col(name), value) if name in requests.columns else value
        requests = requests.withColumn(name, known)
    asked = F.when(F.size("namespaces") == 0, defaults).otherwise(F.col("namespaces"))
    return requests.withColumn("namespaces", F.array_distinct(asked))


def violation() -> Column:
    """Why a request is rejected, or null."""
    length = F.length("question")
    return (
        F.when(F.col("question").isNull() | (length < 1), "question is empty")
        .when(length > MAX_QUESTION_CHARS, f"question is longer than {MAX_QUESTION_CHARS}")
        .when(~F.col("top_k").between(1, MAX_TOP_K), f"top_k is not in 1..{MAX_TOP_K}")
    )


def split_valid(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected); rejected rows carry ``violation``."""
    checked = requests.withColumn("violation", violation())
    accepted = checked.where(F.col("violation").isNull()).drop("violation")
    return accepted, checked.where(F.col("violation").isNotNull())


def answerable(requests: DataFrame) -> DataFrame:
    """Requests that retrieval has an answer for: a non-blank question and some namespace."""
    return requests.where(~is_blank(F.col("question")) & (F.size("namespaces") > 0))
