import threading

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_quality import chunks, golden  # noqa: F401

from corpusloom.config import Settings
from corpusloom.functions.vectors import embedding_or_error
from corpusloom.operators.answers import answer_usage, generate_answers
from corpusloom.operators.bm25 import Bm25Index
from corpusloom.plans.evaluate import evaluate_apart, guarded_searcher
from corpusloom.sources.chunk_store import ChunkStore
from corpusloom.sources.files import list_files
from corpusloom.streaming.sync import start_mirror


class Model:
    def encode(self, sentences, **options):
        if any("beta" in s or s is None for s in sentences):
            raise ValueError("cannot take beta")
        return np.array([[len(s), 1.0] for s in sentences])


def test_one_text_costs_its_own_row(spark):
    rows = [(i, "beta" if i % 7 == 3 else f"text {i}") for i in range(50)]
    made = spark.createDataFrame(rows, "id long, text string").repartition(3).withColumn("made", embedding_or_error(F.col("text"), Model)).collect()
    assert {r.id for r in made if r.made.error} == {i for i, t in rows if t == "beta"}
    assert all(r.made.error == "ValueError: cannot take beta" and r.made.vector is None for r in made if r.text == "beta")
    assert all(r.made.vector == [float(len(r.text)), 1.0] for r in made if r.text != "beta")


def test_failing_questions_are_skipped_in_one_job(spark, golden, chunks):  # noqa: F811
    store = chunks.withColumn("embedding", F.array(F.lit(1.0), F.lit(0.5)).cast("array<float>"))
    search = guarded_searcher(store, Bm25Index.build(store), lambda text: embedding_or_error(text, Model))
    report, rows = evaluate_apart(search, golden)
    assert (report.items, report.evaluated, report.skipped, report.error) == (2, 1, 1, None)
    assert {r.query_id: r.error for r in rows.collect()} == {"g1": None, "g2": "ValueError: cannot take beta"}
    assert report.passes(0.1) and report.aggregate["recall_at_10"] == rows.where("NOT skipped").first()["recall_at_10"]


def test_what_no_question_causes_is_raised(spark, golden, chunks):  # noqa: F811
    def no_model():
        raise RuntimeError("no weights")

    search = guarded_searcher(chunks, Bm25Index.build(chunks), lambda text: embedding_or_error(text, no_model))
    with pytest.raises(Exception, match="no weights"):
        evaluate_apart(search, golden)
    assert evaluate_apart(search, golden.limit(0))[0].error == "dataset empty or not found"


class Client:
    def stream(self, messages):
        number = int(messages[0]["content"])
        yield "part ", None
        if number == 42:
            raise TimeoutError("service")
        yield "end", None if number % 10 == 0 else (number, 1)


def test_one_failing_request_leaves_the_others(spark):
    prompted = spark.range(100).select(
        F.col("id").alias("query_id"), F.array(F.struct(F.lit("user").alias("role"), F.col("id").cast("string").alias("content"))).alias("messages")
    )
    with pytest.raises(Exception, match="service"):
        generate_answers(prompted, Client, Settings()).collect()
    answers = generate_answers(prompted, Client, Settings(), keep_errors=True).persist()
    failed = answers.where("error IS NOT NULL").collect()
    assert [(r.query_id, r.fragments, r.error) for r in failed] == [(42, None, "TimeoutError: service")]
    assert answers.where("size(fragments) = 2").count() == 99
    usage = answer_usage(answers).first()
    assert (usage.requests, usage.failed, usage.without_usage) == (100, 1, 10)
    assert usage.prompt_tokens == sum(i for i in range(100) if i % 10 and i != 42) and usage.completion_tokens == 89


def test_one_deep_directory_is_listed_by_all_tasks(spark, tmp_path):
    for i in range(60):
        folder = tmp_path / "tree" / "top" / f"d{i}" / "deep"
        folder.mkdir(parents=True)
        (folder / "_a.md").write_text("x")
        (folder.parent / "b.py").write_text("x")
    (tmp_path / "tree" / "root.md").write_text("x")
    (tmp_path / "tree" / "loop").symlink_to(tmp_path / "tree" / "top")
    (tmp_path / "tree" / "link.md").symlink_to(tmp_path / "tree" / "root.md")
    found = list_files(spark, str(tmp_path / "tree"), (".md", ".py"))
    rows = {(r.listed, r.absolute) for r in found.collect()}
    root = str(tmp_path / "tree")
    want = {(f"{root}/top/d{i}/deep/_a.md",) * 2 for i in range(60)} | {(f"{root}/top/d{i}/b.py",) * 2 for i in range(60)}
    assert rows == want | {(f"{root}/root.md",) * 2, (f"{root}/link.md", f"{root}/root.md")}
    assert found.count() == len(rows)


def test_deleted_files_leave_the_store(spark, tmp_path):
    tree = tmp_path / "tree"
    tree.mkdir()
    (tree / "_hidden.md").write_text("# A\n\nfirst")
    (tree / "b.md").write_text("# B\n\nsecond")
    store, reports = ChunkStore(spark, str(tmp_path / "store")), []
    settings = Settings(use_mock_embeddings=True)

    def turn():
        done = threading.Event()
        query = start_mirror(
            spark, "ns", str(tree), store, str(tmp_path / "checkpoint"), settings=settings, once=True, on_report=lambda r: (reports.append(r), done.set())
        )
        query.awaitTermination(60)
        query.stop()
        assert done.is_set()
        return {r.file_path for r in store.read("ns").select("file_path").distinct().collect()}

    assert turn() == {"_hidden.md", "b.md"}
    (tree / "b.md").unlink()
    (tree / "c.md").write_text("# C\n\nthird")
    assert turn() == {"_hidden.md", "c.md"}
    assert (reports[-1].files_deleted, reports[-1].files_indexed) == (1, 1)


def test_all_unreadable_files_of_a_dry_run_are_listed(spark, tmp_path, monkeypatch):
    from corpusloom.plans import ingest as plan

    (tmp_path / "good.py").write_text("x = 1\n")
    real = plan.list_files
    gone = spark.createDataFrame([(f"bad{i}.py", str(tmp_path / f"bad{i}.py")) for i in range(130)], "listed string, absolute string")
    monkeypatch.setattr(plan, "list_files", lambda *a: real(*a).unionByName(gone))
    report = plan.ingest(spark, "ns", str(tmp_path), dry_run=True)
    assert report.error_count == 130 and len(report.errors) == 100
    found = plan.unloadable_files(spark, str(tmp_path)).collect()
    assert {r.path for r in found} == {f"bad{i}.py" for i in range(130)} and all("bad" in r.error for r in found)
