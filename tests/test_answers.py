import json

import pytest
from pyspark.sql import functions as F

from corpusloom.config import Settings, load_settings
from corpusloom.functions.sse import answer_text
from corpusloom.functions.vectors import mock_embedding
from corpusloom.operators import answers as an
from corpusloom.operators.bm25 import Bm25Index
from corpusloom.operators.hydrate import chunk_summary, chunk_title, display_rows
from corpusloom.operators.requests import split_valid, with_defaults
from corpusloom.operators.rerank import get_reranker, overlap_score, rerank_by, rerank_identity
from corpusloom.plans.answer import answer
from corpusloom.plans.registry import IndexRegistry, health, reload_indexes
from corpusloom.sources.chunk_store import ChunkStore
from corpusloom.streaming.sync import start_sync

SETTINGS = Settings(dense_dim=8, reranker_type="identity", default_namespaces=("n", "m"))


def hydrated(spark, rows):
    schema = ("query_id string, rank int, score double, namespace string, path string, symbol string, "
              "chunk_type string, text string, metadata map<string,string>")
    return spark.createDataFrame(rows, schema)


def hit(rank, ns="n", text="body", **meta):
    return ("q", rank, 1.0 / (rank + 1), ns, f"p{rank}.py", f"s{rank}", "code", text,
            {"heading_path": "", "start_line": "", "end_line": "", **meta})


def test_request_checks(spark):
    rows = [("a", "x", [], None), ("b", "", ["z"], 5), ("c", "y" * 2001, ["z"], 5), ("d", "y" * 2000, ["z", "z"], 50),
            ("e", "q", ["z"], 51), ("f", "q", ["z"], 0)]
    df = spark.createDataFrame(rows, "query_id string, question string, namespaces array<string>, top_k int")
    good, bad = split_valid(with_defaults(df, ["n", "m"]))
    kept = {r["query_id"]: r for r in good.collect()}
    assert set(kept) == {"a", "d"}
    assert (kept["a"]["namespaces"], kept["a"]["top_k"], kept["a"]["retrieval_only"]) == (["n", "m"], 10, False)
    assert kept["d"]["namespaces"] == ["z"]
    assert {r["query_id"] for r in bad.collect()} == {"b", "c", "e", "f"}


def test_chunk_summary(spark):
    rows = [hit(0, text="é😀" * 200, start_line="12", end_line="30", heading_path="A > B"), hit(1, start_line="x")]
    got = chunk_summary(hydrated(spark, rows)).orderBy("rank").collect()
    assert got[0]["snippet"] == ("é😀" * 200)[:300]
    assert (got[0]["start_line"], got[0]["end_line"], got[0]["heading_path"]) == (12, 30, "A > B")
    assert (got[1]["start_line"], got[1]["end_line"]) == (None, None)


def test_display(spark):
    df = spark.createDataFrame([("q", r, "n", f"0123456789{r}", 0.5) for r in range(12)],
                               "query_id string, rank int, namespace string, doc_id string, score double")
    rows = display_rows(df).collect()
    assert len(rows) == 10 and rows[0]["doc_id"] == "01234567"
    title = df.limit(1).select(chunk_title(F.lit("n"), F.lit("f"), F.lit("H")), chunk_title(F.lit("n"), F.lit("f"), F.lit("")))
    assert tuple(title.first()) == ("[n] f > H", "[n] f")


def candidates(spark, texts, question="red fox"):
    rows = [("q", question, 3, f"d{i}", i, 0.5 - i / 10, text) for i, text in enumerate(texts)]
    return spark.createDataFrame(
        rows, "query_id string, question string, top_k int, doc_id string, rank int, score double, text string")


class Pairs:
    def predict(self, pairs, batch_size, show_progress_bar):
        assert batch_size == 32 and pairs
        return [float(len(text)) for _, text in pairs]


def test_rerankers(spark):
    df = candidates(spark, ["red", "blue", "red fox", "fox", "a red fox"])
    kept = rerank_identity(df, "top_k").orderBy("rank").collect()
    assert [(r["doc_id"], r["score"]) for r in kept] == [("d0", 0.5), ("d1", 0.4), ("d2", 0.3)]
    best = rerank_by(df, overlap_score(F.col("question"), F.col("text")), 4).orderBy("rank").collect()
    assert [(r["doc_id"], r["score"]) for r in best] == [("d2", 1.0), ("d4", 1.0), ("d0", 0.5), ("d3", 0.5)]
    cross = get_reranker(Settings(reranker_type="cross_encoder"), load_model=Pairs)
    got = cross(df, 2).orderBy("rank").collect()
    assert [(r["doc_id"], r["score"], r["score_kind"]) for r in got] == [("d4", 9.0, "relevance"), ("d2", 7.0, "relevance")]
    assert cross(df, 99).count() == 5
    assert cross(df.limit(0), 3).count() == 0
    with pytest.raises(ValueError, match="nope"):
        get_reranker(Settings(reranker_type="nope"))


def test_prompts_and_mock_answers(spark):
    queries = spark.createDataFrame([("q", "why?"), ("none", "what?")], "query_id string, question string")
    found = hydrated(spark, [hit(1, "m"), hit(0), hit(2, "m"), hit(3, "z")])
    rows = {r["query_id"]: r for r in an.prompts(queries, found).collect()}
    parts = [f"[{ns}:p{i}.py:s{i}]\nbody" for i, ns in enumerate("nmmz")]
    assert rows["q"]["user_message"] == "Context:\n\n" + "\n\n---\n\n".join(parts) + "\n\nQuestion: why?"
    assert rows["none"]["user_message"] == an.EMPTY_CONTEXT + "\n\nQuestion: what?"
    assert [m["role"] for m in rows["none"]["messages"]] == ["system", "user"]
    texts = {r[0]: r[1] for r in an.mock_answers(queries, found).collect()}
    assert texts["q"] == "Hits by namespace (3):\n  m: 2 chunks\n  n: 1 chunks\n  z: 1 chunks"
    assert texts["none"] == an.NO_CHUNKS_ANSWER


def test_token_fragments(spark):
    df = spark.createDataFrame([("a b",), ("one",), ("x  y",), ("",)], "t string")
    got = [r[0] for r in df.select(an.token_fragments(F.col("t"))).collect()]
    assert got == [["a", " ", "b"], ["one"], ["x", " ", "", " ", "y"], [""]]


class Client:
    def stream(self, messages):
        assert [m["role"] for m in messages] == ["system", "user"]
        yield "Hel", None
        yield "", None
        yield "lo", None
        if "why" in messages[1]["content"]:
            yield None, (1000, 500)


def test_generated_answers_and_cost(spark):
    queries = spark.createDataFrame([("q", "why?"), ("r", "what?")], "query_id string, question string")
    settings = Settings(use_mock_answers=False, answer_api_key="k", answer_model="doubao-seed-2.0-pro")
    rows = an.get_answerer(settings, Client)(queries, hydrated(spark, [hit(0)])).collect()
    got = {r["query_id"]: r for r in rows}
    assert got["q"]["fragments"] == ["Hel", "lo"]
    assert (got["q"]["prompt_tokens"], got["q"]["completion_tokens"]) == (1000, 500)
    assert got["q"]["input_cost"] == pytest.approx(0.0032) and got["q"]["output_cost"] == pytest.approx(0.008)
    assert got["r"]["prompt_tokens"] is None and got["r"]["input_cost"] is None
    other = spark.createDataFrame([("?", 10, 10)], "model string, prompt_tokens long, completion_tokens long")
    assert an.token_cost(other).first()["output_cost"] == 0.0
    with pytest.raises(an.GenerationError):
        an.get_answerer(Settings(use_mock_answers=False))


@pytest.fixture
def store(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "store"))
    rows = [("1", "n", "a.md", "A", "s", "alpha hook", 3), ("2", "n", "b.md", "B", "s", "beta", 1), ("3", "m", "c.md", "C", "s", "alpha", 1)]
    df = spark.createDataFrame(
        rows, "doc_id string, namespace string, file_path string, symbol string, commit_sha string, text string, start_line int")
    store.upsert(df.withColumn("embedding", mock_embedding(F.col("text"), 8)))
    return store


def test_answer_events(spark, store):
    requests = spark.createDataFrame(
        [("r1", "alpha", [], 2, False), ("r2", "alpha", ["n"], 5, True), ("r3", " ", ["n"], 5, False), ("r4", "", ["n"], 5, False)],
        "query_id string, question string, namespaces array<string>, top_k int, retrieval_only boolean")
    chunks = store.read()
    result = answer(chunks, Bm25Index.build(chunks), requests, SETTINGS)
    events = {}
    for row in result.events.orderBy("query_id", "seq").collect():
        events.setdefault(row["query_id"], []).append((row["event"], row["data"]))
    assert set(events) == {"r1", "r2", "r3"}
    assert [e for e, _ in events["r2"]] == ["retrieved", "done"]
    assert [e for e, _ in events["r1"]][0] == "retrieved" and events["r1"][-1] == ("done", "")
    assert {e for e, _ in events["r1"][1:-1]} == {"token"}
    payload = json.loads(events["r1"][0][1])["chunks"]
    assert sorted(c["namespace"] for c in payload) == ["m", "n"]
    assert all(isinstance(c["start_line"], int) for c in payload)
    said = "".join(d for e, d in events["r1"] if e == "token")
    assert said.startswith("Hits by namespace (2):")
    assert "".join(d for e, d in events["r3"] if e == "token") == an.NO_CHUNKS_ANSWER
    assert [r["query_id"] for r in result.rejected.collect()] == ["r4"]

    body = result.events.withColumn("wire", an.wire_format(F.col("event"), F.col("data")))
    bodies = body.groupBy("query_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "wire"))), lambda x: x["wire"]), "").alias("body"))
    parsed = {r["query_id"]: r for r in answer_text(bodies, "query_id").collect()}
    assert parsed["r1"]["answer"] == said and json.loads(parsed["r1"]["retrieved"])["chunks"] == payload


def test_debug_payload(spark, store):
    requests = spark.createDataFrame([("r", "alpha", ["n"])], "query_id string, question string, namespaces array<string>")
    settings = Settings(dense_dim=8, reranker_type="identity", expose_retrieval_debug=True)
    chunks = store.read()
    events = answer(chunks, Bm25Index.build(chunks), requests, settings).events
    debug = json.loads(events.where("event = 'retrieved'").first()["data"])["debug"]
    assert set(debug) == {"bm25_top", "dense_top", "rrf_top", "reranked_top"}
    assert len(debug["dense_top"]) == 2 and len(debug["reranked_top"]) == 2


def test_registry(spark, store):
    registry = IndexRegistry(store)
    registry.prime(["n", "m"])
    assert registry.get(["m", "n"]) is registry.get(["n", "m"])
    more = spark.createDataFrame([("9", "n", "z.md", "Z", "s", "new")],
                                 "doc_id string, namespace string, file_path string, symbol string, commit_sha string, text string")
    store.upsert(more)
    assert registry.invalidate("n") == 3
    assert reload_indexes(registry, settings=Settings()) == {"reloaded": [], "bm25_chunks": {}}
    real = Settings(use_mock_embeddings=False, default_namespaces=("n", "m"))
    assert reload_indexes(registry, settings=real) == {"reloaded": ["n", "m"], "bm25_chunks": {"n": 3, "m": 1}}
    assert reload_indexes(registry, "m", real)["reloaded"] == ["m"]
    registry.clear()
    assert health(Settings())["status"] == "ok"


def test_settings(tmp_path):
    file = tmp_path / ".env"
    file.write_text("# c\nDENSE_DIM=16\nunknown=1\nDEFAULT_NAMESPACES=a, b\nUSE_MOCK_ANSWERS='false'\n")
    settings = load_settings({"dense_dim": "32"}, str(file))
    assert (settings.dense_dim, settings.default_namespaces, settings.use_mock_answers) == (32, ("a", "b"), False)


def test_streaming_sync(spark, tmp_path):
    source, store = tmp_path / "src", ChunkStore(spark, str(tmp_path / "store"))
    (source / "d").mkdir(parents=True)
    (source / "d" / "a.md").write_text("# One\nx\n# Two\n")
    (source / "b.py").write_text("def f():\n    pass\n")
    (source / "no.bin").write_bytes(b"\0")

    def run():
        query = start_sync(spark, "n", str(source), store, str(tmp_path / "ck"),
                           lambda c: mock_embedding(c, 8), available_now=True)
        query.awaitTermination(120)
        return sorted((r["file_path"], r["symbol"]) for r in store.read("n").collect())

    assert run() == [("b.py", "f"), ("d/a.md", "One"), ("d/a.md", "Two")]
    (source / "c.txt").write_text("plain")
    assert run() == [("b.py", "f"), ("c.txt", "c"), ("d/a.md", "One"), ("d/a.md", "Two")]
