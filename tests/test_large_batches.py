import pytest
from pyspark.sql import functions as F
from test_quality import chunks  # noqa: F401

from corpusloom.functions.vectors import mock_embedding
from corpusloom.operators import batches
from corpusloom.operators.bm25 import Bm25Index
from corpusloom.plans.search import hybrid_search

ASKED = [(i, f"{word} {other}", ["n", "m"] if i % 2 else ["n"]) for i, (word, other) in enumerate(
    (w, o) for w in ("alpha", "beta", "gamma", "delta", "text") for o in ("hook", "words", "other"))]


def rows(df):
    return sorted((r.query_id, r["rank"], r.doc_id, r.namespace, round(r.score, 9), r.text) for r in df.collect())


@pytest.mark.parametrize("k", [1, 4])
def test_a_batch_without_bound_has_the_same_hits(spark, chunks, monkeypatch, k):  # noqa: F811
    """Beyond the bound the grid, the joins of postings and the filtered hydration do what the shipped batch does."""
    queries = spark.createDataFrame(ASKED, "query_id long, question string, namespaces array<string>")
    queries = queries.withColumn("vector", mock_embedding(F.col("question"), 8))
    index = Bm25Index.build(chunks)
    want = rows(hybrid_search(chunks, index, queries, k).hydrated)
    monkeypatch.setattr(batches, "MAX_BATCH_QUERIES", 4)
    found = hybrid_search(chunks, index, queries, k)
    plan = found.hydrated._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "scalar-subquery" in plan
    assert rows(found.hydrated) == want and len(want) > len(ASKED) / 2
    found.ranked.unpersist()
