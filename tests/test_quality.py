import json
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators.bm25 import Bm25Index
from corpusloom.functions.vectors import mock_embedding
from corpusloom.operators.metrics import aggregate_metrics, mean_recall, query_metrics
from corpusloom.operators.training import holdout_split
from corpusloom.plans.evaluate import compare_models, evaluate, hybrid_searcher
from corpusloom.plans.mining import mine_triples
from corpusloom.sources.golden import load_golden, write_jsonl


def tables(spark, cases):
    queries = spark.createDataFrame([(q,) for q in cases], "query_id string")
    got = [(q, i, *t) for q, (hits, _) in cases.items() for i, t in enumerate(hits)]
    wanted = [(q, *t) for q, (_, rel) in cases.items() for t in rel]
    triple = "namespace string, path string, symbol string"
    return (
        queries,
        spark.createDataFrame(got, f"query_id string, rank int, {triple}"),
        spark.createDataFrame(wanted, f"query_id string, {triple}"),
    )


def t(name, ns="n"):
    return (ns, f"{name}.md", name)


def slow(hits, rel, k):
    wanted, top = set(rel), hits[:k]
    found = [h in wanted for h in top]
    recall = sum(found) / len(wanted) if wanted else 1.0
    precision = sum(found) / len(top) if top else 0.0
    mrr = (1 / (found.index(True) + 1) if True in found else 0.0) if wanted else 1.0
    return recall, precision, mrr


def test_metrics_equal_slow_reading(spark):
    rng = random.Random(9)
    names = [t(x) for x in "abcdefgh"]
    cases = {
        "none-wanted": ([t("a")], []),
        "none-found": ([], [t("a")]),
        "both-empty": ([], []),
        "other-namespace": ([t("a", "m")], [t("a")]),
        "twice": ([t("a"), t("a"), t("b")], [t("a"), t("a")]),
    }
    for i in range(40):
        cases[f"r{i}"] = (rng.choices(names, k=rng.randint(0, 12)), rng.sample(names, rng.randint(0, 4)))
    got = query_metrics(*tables(spark, cases), recall_at=(2, 5, 10), precision_at=(2, 5), mrr_at=(2, 10)).collect()
    assert len(got) == len(cases)
    for row in got:
        hits, rel = cases[row["query_id"]]
        assert row["retrieved_count"] == len(hits)
        for k in (2, 5, 10):
            assert row[f"recall_at_{k}"] == slow(hits, rel, k)[0]
        for k in (2, 5):
            assert row[f"precision_at_{k}"] == slow(hits, rel, k)[1]
        for k in (2, 10):
            assert row[f"mrr_at_{k}"] == slow(hits, rel, k)[2]


def test_aggregate_and_mean_recall(spark):
    queries, got, wanted = tables(spark, {"a": ([t("x")], [t("x")]), "b": ([t("y")], [t("x")]), "c": ([], [t("x")])})
    row = aggregate_metrics(query_metrics(queries, got, wanted)).first()
    assert (row["items"], row["evaluated"], row["skipped"]) == (3, 3, 0)
    assert row["recall_at_10"] == pytest.approx(1 / 3)
    assert tuple(mean_recall(queries, got, wanted).first()) == (2, 0.5)
    skipped = query_metrics(queries, got, wanted).withColumn("skipped", F.lit(True))
    row = aggregate_metrics(skipped).first()
    assert (row["evaluated"], row["skipped"], row["recall_at_10"]) == (0, 3, 0.0)
    assert tuple(mean_recall(queries, got.limit(0), wanted).first()) == (0, 0.0)


def test_holdout_split(spark, tmp_path):
    sizes = {"n1": (13, 3), "n2": (13, 3), "n3": (11, 2), "n4": (9, 2)}
    rows, expected, number = [], set(), 0
    for ns, (size, quota) in sizes.items():
        ids = []
        for _ in range(size):
            number += 1
            ids.append(f"q{number:03d}")
            rows.append((ids[-1], [ns]))
        expected |= {sorted(ids)[int(i * size / quota + size / quota / 2)] for i in range(quota)}
    rows += [(f"q{number + i:03d}", ["n1", "n2"]) for i in range(1, 5)]
    items = spark.createDataFrame(rows, "id string, namespaces array<string>")
    train, held = holdout_split(items, {ns: q for ns, (_, q) in sizes.items()})
    assert {r["id"] for r in held.collect()} == expected and held.count() == 10
    assert train.count() == 40
    write_jsonl(held, str(tmp_path / "held"), single_file=True)
    assert spark.read.json(str(tmp_path / "held")).count() == 10


GOLDEN = [
    {"id": "g1", "query": "alpha hook", "namespaces": ["n"], "relevant_chunks": [
        {"namespace": "n", "path": "a.md", "symbol": "A"}, {"namespace": "n", "path": "gone.md", "symbol": "G"}],
     "answer_keywords": ["k"]},
    {"id": "g2", "query": "beta", "namespaces": ["n", "m"], "relevant_chunks": [
        {"namespace": "m", "path": "b.md", "symbol": "B"}]},
]


@pytest.fixture
def golden(spark, tmp_path):
    file = tmp_path / "golden.jsonl"
    file.write_text(json.dumps(GOLDEN[0]) + "\n\n" + json.dumps(GOLDEN[1]) + "\n")
    return load_golden(spark, str(file))


@pytest.fixture
def chunks(spark):
    rows = [
        ("1", "n", "a.md", "A", "  alpha hook text  "), ("2", "n", "c.md", "C", "alpha other"),
        ("3", "m", "b.md", "B", "beta words"), ("4", "m", "d.md", "D", "   "), ("5", "n", "e.md", "E", "gamma"),
        ("6", "m", "f.md", "F", "delta beta"),
    ]
    df = spark.createDataFrame(rows, "doc_id string, namespace string, file_path string, symbol string, text string")
    extra = {name: F.lit(None).cast(kind) for name, kind in [
        ("chunk_type", "string"), ("heading_path", "string"), ("language", "string"), ("commit_sha", "string"),
        ("start_line", "int"), ("end_line", "int")]}
    return df.withColumns(extra).withColumn("embedding", mock_embedding(F.col("text"), 8))


def test_golden_reader(spark, golden, tmp_path):
    rows = {r["id"]: r for r in golden.collect()}
    assert rows["g1"]["answer_keywords"] == ["k"] and rows["g2"]["answer_keywords"] == []
    assert load_golden(spark, str(tmp_path / "missing.jsonl")).count() == 0
    bad = tmp_path / "bad.jsonl"
    bad.write_text('{"id": "x", "namespaces": []}\n')
    with pytest.raises(Exception, match="required field"):
        load_golden(spark, str(bad)).collect()


def searcher(chunks, k):
    return hybrid_searcher(chunks, Bm25Index.build(chunks), lambda c: mock_embedding(c, 8), k)


def test_evaluate(spark, golden, chunks):
    report, rows = evaluate(searcher(chunks, 10), golden)
    assert (report.items, report.evaluated, report.skipped) == (2, 2, 0)
    assert report.aggregate["recall_at_10"] == pytest.approx(0.75)
    assert report.passes(0.75) and not report.passes(0.8)
    assert rows.count() == 2

    def failing(_):
        raise RuntimeError("no store")

    report, _ = evaluate(failing, golden)
    assert (report.evaluated, report.skipped, report.error) == (0, 2, "no store") and not report.passes(0.9)
    assert report.reasons == {"g1": "no store", "g2": "no store"}
    assert evaluate(failing, golden.limit(0))[0].error == "dataset empty or not found"


def test_one_poisoned_question_is_skipped_alone(spark, golden, chunks):
    real = searcher(chunks, 10)

    def poisoned(queries):
        if queries.where("query_id = 'g2'").count():
            raise RuntimeError("cannot answer g2")
        return real(queries)

    report, rows = evaluate(poisoned, golden)
    assert (report.items, report.evaluated, report.skipped) == (2, 1, 1)
    assert report.reasons == {"g2": "cannot answer g2"} and [r["query_id"] for r in rows.collect()] == ["g1"]
    assert report.passes(0.1)


def test_compare_models(spark, golden, chunks):
    def broken(_):
        raise RuntimeError("no weights")

    got = compare_models(chunks, golden, {"m8": lambda c: mock_embedding(c, 8), "gone": None, "bad": broken})
    assert got["m8"] == pytest.approx(0.75) and got["gone"] is None and got["bad"] is None


def test_mine_triples(spark, golden, chunks):
    rows = mine_triples(chunks, golden, searcher(chunks, 20), 2).collect()
    by_query = {}
    for r in rows:
        by_query.setdefault(r["query"], []).append((r["positive"], r["hard_negative"]))
    assert {p for p, _ in by_query["alpha hook"]} == {"alpha hook text"}
    assert len(by_query["alpha hook"]) == len(by_query["beta"]) == 2
    for pairs in by_query.values():
        assert all(n.strip() and n.strip() != p for p, n in pairs)
