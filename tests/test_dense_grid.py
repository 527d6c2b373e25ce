import numpy as np
import pytest
from test_retrieval import as_hits

from corpusloom.operators import dense as dn

CHUNKS = "doc_id string, namespace string, embedding array<float>"
ASKED = "query_id long, namespaces array<string>, vector array<float>"


def tables(spark, docs, asked, seed=6):
    rng = np.random.default_rng(seed)
    corpus = [(f"d{i:05d}", "ab"[i % 3 == 0], rng.integers(-4, 5, 8).astype(float).tolist()) for i in range(docs)]
    batch = [(i, [["a"], ["a", "b"], ["b", "none"]][i % 3], rng.integers(-4, 5, 8).astype(float).tolist()) for i in range(asked)]
    return spark.createDataFrame(corpus, CHUNKS), spark.createDataFrame(batch, ASKED)


@pytest.mark.parametrize("cells", [{}, {"docs_per_cell": 7, "queries_per_cell": 3}])
def test_grid_equals_the_shipped_batch(spark, cells):
    chunks, queries = tables(spark, 300, 40)
    got, want = as_hits(dn.dense_search_grid(chunks, queries, 5, **cells)), as_hits(dn.dense_search(chunks, queries, 5))
    assert {key: d for key, (d, _) in got.items()} == {key: d for key, (d, _) in want.items()}
    assert all(got[key][1] == pytest.approx(want[key][1], abs=1e-9) for key in want)


def test_ten_thousand_queries_are_one_plan(spark):
    chunks, queries = tables(spark, 60, 10_000)
    chunks.write.format("noop").mode("overwrite").save()
    hits = dn.dense_search(chunks, queries, 3)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FlatMapCoGroupsInArrow") == 1
    counts = hits.groupBy("query_id", "namespace").count()
    assert counts.where("count != 3").count() == 0
    assert counts.count() == sum((1, 2, 1)[i % 3] for i in range(10_000))


def test_vectors_of_another_length_are_named(spark):
    chunks = spark.createDataFrame([("1", "a", [1.0, 2.0]), ("2", "a", [1.0])], CHUNKS).coalesce(1)
    queries = spark.createDataFrame([(1, ["a"], [1.0, 0.0])], ASKED)
    for search in (dn.dense_search, dn.dense_search_grid):
        with pytest.raises(Exception, match="a vector of 1 entries among vectors of 2"):
            search(chunks, queries).collect()


def test_nothing_asked_and_no_corpus(spark):
    chunks, queries = tables(spark, 20, 5)
    assert dn.dense_search_grid(chunks, queries.where("false")).count() == 0
    assert dn.dense_search_grid(chunks.where("false"), queries).count() == 0
    blank = spark.createDataFrame([(1, ["a"], None), (2, None, [1.0] * 8), (3, ["a"], [])], ASKED)
    assert dn.dense_search_grid(chunks, blank).count() == 0
