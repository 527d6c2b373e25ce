import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.__main__ import main
from corpusloom.config import Settings
from corpusloom.functions.vectors import cosine, get_embedder
from corpusloom.operators import bm25 as bm
from corpusloom.operators.batches import as_batch
from corpusloom.sources.golden import golden_namespaces, load_golden


class Encoder:
    def encode(self, sentences, batch_size, normalize_embeddings, show_progress_bar, convert_to_numpy):
        assert batch_size == 32 and normalize_embeddings
        made = np.array([[len(s), 1.0, s.count("a")] for s in sentences], dtype=np.float64)
        return made / np.linalg.norm(made, axis=1, keepdims=True)


def test_model_embedder(spark):
    embed = get_embedder(Settings(use_mock_embeddings=False), Encoder)
    df = spark.createDataFrame([("1", "banana"), ("2", "x")], "id string, text string")
    got = {r["id"]: r["v"] for r in df.withColumn("v", embed(F.col("text"))).collect()}
    want = np.array([6.0, 1.0, 3.0])
    assert got["1"] == pytest.approx(list(want / np.linalg.norm(want)), abs=1e-6)
    assert len(get_embedder(Settings(dense_dim=12))(F.lit("x")).alias("v")._jc.toString()) > 0


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    assert df.select(cosine(F.col("a"), F.col("b"))).first()[0] == pytest.approx(2**-0.5)


def test_ingest_search_evaluate(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setenv("DENSE_DIM", "8")
    monkeypatch.setenv("RERANKER_TYPE", "identity")
    tree, store = tmp_path / "tree", str(tmp_path / "store")
    tree.mkdir()
    (tree / "a.md").write_text("# Hooks\nhow hooks are registered\n# Other\nnothing\n")
    (tree / "b.py").write_text("def hook():\n    pass\n")
    common = ["--namespace", "docs", "--source", str(tree), "--store", store, "--change-key", "content"]
    assert main(["ingest", *common, "--dry-run"]) == 0
    assert json.loads(capsys.readouterr().out)["chunks_written"] == 3
    assert main(["ingest", *common]) == 0
    assert json.loads(capsys.readouterr().out)["files_indexed"] == 2
    assert main(["search", "hooks registered", "--namespaces", "docs", "--store", store, "--top-k", "2"]) == 0
    lines = [json.loads(line) for line in capsys.readouterr().out.splitlines()]
    assert len(lines) == 2 and lines[0]["namespace"] == "docs" and isinstance(lines[0]["start_line"], int)

    index = str(tmp_path / "index")
    assert main(["index", "--store", store, "--index", index]) == 0
    assert main(["search", "hooks registered", "--namespaces", "docs", "--store", store, "--top-k", "2", "--index", index]) == 0
    assert [json.loads(line) for line in capsys.readouterr().out.splitlines()] == lines

    golden = tmp_path / "golden.jsonl"
    golden.write_text(json.dumps({
        "id": "q", "query": "hooks registered", "namespaces": ["docs"],
        "relevant_chunks": [{"namespace": "docs", "path": "a.md", "symbol": "Hooks"}]}) + "\n")
    evaluate = ["evaluate", "--dataset", str(golden), "--store", store]
    assert main([*evaluate, "--validate-only"]) == 0
    assert json.loads(capsys.readouterr().out) == {"valid_items": 1}
    assert main([*evaluate, "--min-recall", "0.9"]) == 0
    told = json.loads(capsys.readouterr().out)
    assert told["metrics"]["recall_at_10"] == 1.0 and told["passed"]
    assert main([*evaluate, "--min-recall", "1.1"]) == 1
    capsys.readouterr()
    mined, train, held = (str(tmp_path / name) for name in ("mined", "train", "held"))
    assert main(["mine", "--dataset", str(golden), "--store", store, "--output", mined]) == 0
    assert {r["query"] for r in spark.read.json(mined).collect()} == {"hooks registered"}
    assert main(["holdout", "--dataset", str(golden), "--quota", "docs=1", "--train", train, "--holdout", held]) == 0
    assert spark.read.schema("id string").json(held).count() == 1 and spark.read.schema("id string").json(train).count() == 0
    assert [r[0] for r in golden_namespaces(load_golden(spark, str(golden))).collect()] == ["docs"]


def test_batches(spark, monkeypatch):
    df = spark.range(10).withColumnRenamed("id", "query_id")
    batch = as_batch(df)
    assert batch.bounded and batch.df.count() == 10 and as_batch(batch) is batch
    assert "LocalTableScan" in batch.df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("blocks", [True, False])
def test_a_third_of_the_corpus_are_copies(spark, monkeypatch, blocks):
    rows = [(f"c{i:04d}", "n", "the same copied words") for i in range(400)]
    rows += [(f"d{i:04d}", "n", f"word{i % 37} other{i % 11} text") for i in range(800)]
    rows += [("best", "n", "copied words same copied")]
    chunks = spark.createDataFrame(rows, "doc_id string, namespace string, text string").repartition(7)
    queries = spark.createDataFrame([("q", "same copied", ["n"])], "query_id string, question string, namespaces array<string>")
    if not blocks:
        monkeypatch.setattr(bm, "MAX_BLOCK_WEIGHTS", 0)
    hits = bm.bm25_search(bm.Bm25Index.build(chunks), queries, 20).orderBy("rank").collect()
    assert [r["doc_id"] for r in hits] == ["best"] + [f"c{i:04d}" for i in range(19)]
