"""Runs that must not lose or invent data: broken sources, unreadable files, odd ids, halfway scores."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.config import Settings
from corpusloom.functions.vectors import mock_embedding
from corpusloom.operators import bm25 as bm
from corpusloom.operators.contains import containing
from corpusloom.operators.dense import dense_search
from corpusloom.operators.ranking import order_units
from corpusloom.operators.rerank import overlap_score, rerank_by
from corpusloom.operators.sync import sync_diff
from corpusloom.plans.ingest import ingest
from corpusloom.sources.chunk_store import ChunkStore
from corpusloom.sources.files import list_files, read_files
from corpusloom.streaming.sync import file_stream

SETTINGS = Settings(dense_dim=4)


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree"
    root.mkdir()
    (root / "one.md").write_bytes(b"# One\r\nbody\r\n")
    (root / "two.txt").write_text("two")
    return root


@pytest.fixture
def store(spark, tmp_path):
    return ChunkStore(spark, str(tmp_path / "store"))


def run(spark, tree, store, **options):
    return ingest(spark, "ns", str(tree), store, settings=SETTINGS, **options)


def paths(store):
    return sorted(r[0] for r in store.read("ns").select("file_path").distinct().collect())


def test_a_folder_without_history_fails_and_keeps_the_store(spark, tree, store):
    run(spark, tree, store, change_key="content")
    with pytest.raises(Exception, match="git log in"):
        run(spark, tree, store)
    assert paths(store) == ["one.md", "two.txt"]


def test_an_emptied_source_is_refused_unless_allowed(spark, tree, store):
    run(spark, tree, store, change_key="content")
    for name in ("one.md", "two.txt"):
        (tree / name).unlink()
    with pytest.raises(ValueError, match="no files left"):
        run(spark, tree, store, change_key="content")
    assert len(paths(store)) == 2
    assert run(spark, tree, store, change_key="content", allow_empty=True).files_deleted == 2
    assert paths(store) == []


def test_an_unreadable_file_is_an_error_and_keeps_its_chunks(spark, tree, store, monkeypatch):
    run(spark, tree, store, change_key="content")
    (tree / "two.txt").unlink()
    (tree / "two.txt").symlink_to(tree / "gone.txt")
    from corpusloom.plans import ingest as plan

    real = plan.relative_files
    extra = spark.createDataFrame([("two.txt", str(tree / "gone.txt"))], "path string, absolute string")
    monkeypatch.setattr(plan, "relative_files", lambda *a: real(*a).where("path <> 'two.txt'").unionByName(extra))
    report = run(spark, tree, store, change_key="content")
    assert (report.files_deleted, report.error_count) == (0, 1) and "two.txt" in report.errors[0]
    assert paths(store) == ["one.md", "two.txt"]


def test_batch_and_stream_share_their_change_key(spark, tree):
    files = list_files(spark, str(tree), (".md",)).select(F.col("listed").alias("path"), "absolute")
    batch = read_files(files).first()
    stream = file_stream(spark, str(tree)).writeStream.format("memory").queryName("keys").trigger(availableNow=True).start()
    stream.awaitTermination()
    row = spark.table("keys").where("path LIKE '%one.md'").first()
    assert batch["digest"] == row["commit_sha"] and batch["text"] == row["text"] == "# One\nbody\n"


def test_null_keys_are_errors_not_absence(spark):
    schema = "file_path string, commit_sha string"
    now = spark.createDataFrame([("a", None), ("b", "1"), ("c", None), ("d", "1")], schema)
    before = spark.createDataFrame([("a", "1"), ("b", None), ("d", "1"), ("e", None)], schema)
    got = {r["file_path"]: r["action"] for r in sync_diff(now, before).collect()}
    assert got == {"a": "error", "b": "update", "c": "error", "d": "skip", "e": "delete"}


@pytest.mark.parametrize("kind", ["int", "long", "string"])
def test_ids_of_any_kind(spark, kind):
    rows = [(1, "n", "red fox", [1.0, 0.0]), (2, "n", "blue fox", [0.0, 1.0]), (3, "n", "grey owl", [1.0, 1.0])]
    chunks = spark.createDataFrame(rows, "doc_id int, namespace string, text string, embedding array<float>")
    chunks = chunks.withColumn("doc_id", F.col("doc_id").cast(kind))
    asked = spark.createDataFrame([(7, "red owl", ["n"], [1.0, 0.1])], "query_id int, question string, namespaces array<string>, vector array<float>")
    asked = asked.withColumn("query_id", F.col("query_id").cast(kind))
    hits = bm.bm25_search(bm.Bm25Index.build(chunks), asked, 2).collect()
    assert [str(h["doc_id"]) for h in sorted(hits, key=lambda h: h["rank"])] == ["1", "3"]
    assert [str(h["doc_id"]) for h in dense_search(chunks, asked, 2).orderBy("rank").collect()] == ["1", "3"]


def test_tasks_and_the_final_order_round_alike(spark):
    rng = np.random.default_rng(0)
    scores = np.concatenate([(np.arange(2000) + 0.5) * 1e-9, rng.random(2000), rng.random(500) * 40])
    got = spark.createDataFrame([(i, float(s)) for i, s in enumerate(scores)], "i int, s double").select("i", order_units(F.col("s")).alias("u"))
    units = {r["i"]: r["u"] for r in got.collect()}
    assert [units[i] for i in range(len(scores))] == np.floor(scores * 1e9 + 0.5).astype(int).tolist()


def test_short_passages_are_found_like_long_ones(spark):
    rng = random.Random(2)
    text = lambda n: " ".join(rng.choice(["ab", "b", "cab", "é"]) for _ in range(n))
    texts = [(i, text(30)) for i in range(40)] + [(90, None), (91, "")]
    passages = [(i, text(n)) for i, n in enumerate([1, 1, 2, 2, 3, 4, 5])] + [(50, "b"), (51, ""), (52, None), (53, "b c")]
    left = spark.createDataFrame(texts, "doc_id int, text string")
    right = spark.createDataFrame(passages, "query_id int, passage string")
    want = sorted((d, q) for d, t in texts for q, p in passages if t and p and p in t)
    for size in (1 << 20, 40):
        assert sorted((r["doc_id"], r["query_id"]) for r in containing(left, right, size).collect()) == want
    assert containing(left, right.where("query_id > 99")).collect() == []


def test_figures_of_a_namespace_with_all_terms_are_dealt(spark):
    terms = spark.createDataFrame([("n", f"t{i}", i % 9 + 1) for i in range(900)] + [("m", "t", 1)], "namespace string, term string, n long")
    means = spark.createDataFrame([("n", 20, 3.0, 0.5), ("m", 5, 3.0, 0.5)], "namespace string, n_docs long, avgdl double, mean_idf double")
    found = bm.idf_table(terms, means)
    assert found.count() == 901
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" in plan and "shuffle_hash" in plan.lower()


def test_reranking_limits_each_query_before_the_shuffle(spark):
    rows = [(q, f"w{i % 7} word", "word", float(i), i) for q in range(3) for i in range(200)]
    df = spark.createDataFrame(rows, "query_id int, text string, question string, score double, rank int")
    found = rerank_by(df, overlap_score(F.col("question"), F.col("text")), 10)
    assert "WindowGroupLimit" in found._jdf.queryExecution().executedPlan().toString()
    assert [r["rank"] for r in found.where("query_id = 1").orderBy("rank").collect()] == list(range(10))
