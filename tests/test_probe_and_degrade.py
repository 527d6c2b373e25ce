import json
import logging

import pytest
from pyspark.sql import functions as F
from test_quality import chunks  # noqa: F401

from corpusloom import __main__ as cli
from corpusloom.config import Settings
from corpusloom.functions.vectors import mock_embedding
from corpusloom.operators.bm25 import Bm25Index
from corpusloom.plans.probe import STAGES, probe
from corpusloom.plans.search import hybrid_search
from corpusloom.sources.chunk_store import ChunkStore, as_stored
from corpusloom.sources.embedding_cache import EmbeddingCache, embed_with_cache

ASKED = [(0, "alpha hook", ["n"]), (1, "beta", ["n", "m"]), (2, "omega", ["none"])]


def batch(spark):
    asked = spark.createDataFrame(ASKED, "query_id long, question string, namespaces array<string>")
    return asked.withColumn("vector", mock_embedding(F.col("question"), 8))


@pytest.mark.parametrize("rerank", [True, False])
def test_probe_counts_every_stage(spark, chunks, rerank):  # noqa: F811
    settings = Settings(reranker_type="identity")
    queries, index = batch(spark), Bm25Index.build(chunks)
    found = probe(chunks, index, queries, 2, settings, rerank)
    assert set(found.seconds) == set(found.rows) == set(STAGES) and all(s >= 0 for s in found.seconds.values())
    rows = {r.query_id: r for r in found.questions.collect()}
    direct = hybrid_search(chunks, index, queries, settings.retriever_top_k if rerank else 2, settings)
    for name, part in (("bm25", direct.bm25), ("dense", direct.dense), ("ranked", direct.ranked), ("hydrated", direct.hydrated)):
        counts = {r.query_id: r["count"] for r in part.groupBy("query_id").count().collect()}
        assert {q: r[name] for q, r in rows.items()} == {q: counts.get(q, 0) for q in rows}
        assert found.rows[name] == sum(counts.values())
    assert rows[2].hits == [] and rows[2].final == 0 and all(len(r.hits) == r.final <= 2 for r in rows.values())
    assert [h.rank for h in rows[1].hits] == [0, 1]


def test_probe_command_prints_a_line_for_each_question(spark, chunks, tmp_path, capsys):  # noqa: F811
    store = ChunkStore(spark, str(tmp_path))
    store.apply(as_stored(chunks.withColumn("embedding", mock_embedding(F.col("text"), 768))))
    assert cli.main(["probe", "alpha hook", "beta", "--namespaces", "n", "m", "--store", str(tmp_path), "--no-rerank"]) == 0
    lines = [json.loads(line) for line in capsys.readouterr().out.splitlines() if line.startswith("{")]
    assert [line["question"] for line in lines] == ["alpha hook", "beta"]
    assert lines[0]["hits"][0]["path"] == "a.md" and set(lines[0]["seconds"]) == set(STAGES)


@pytest.mark.parametrize("place", ["/proc/no/cache", "nosuchstore://host/cache"])
def test_a_cache_out_of_reach_costs_no_run(spark, chunks, place, caplog):  # noqa: F811
    with caplog.at_level(logging.WARNING):
        cache = EmbeddingCache(spark, place, "org/model")
        rows = embed_with_cache(chunks.drop("embedding").limit(3), lambda t: mock_embedding(t, 8), cache)
    assert rows.where("size(embedding) = 8").count() == 3 and "embedding without" in caplog.text
    assert embed_with_cache(chunks.select("doc_id", F.lit(None).cast("string").alias("text")), lambda t: mock_embedding(t, 8), None).where("embedding IS NOT NULL").count() == 0
