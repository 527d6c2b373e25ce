import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.config import Settings
from corpusloom.operators import batches as ba
from corpusloom.operators import bm25 as bm
from corpusloom.operators import dense as dn
from corpusloom.operators.fusion import cross_namespace_fuse, hybrid_fuse, rrf
from corpusloom.operators.ranking import spread_row_number
from corpusloom.plans.search import hybrid_search, search_debug

WORDS = "the of cat dog tree house run tensor hook_fn graph batch loss node edge".split()


def corpus(seed=5, n=60, namespaces=("a", "b", "c")):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = rng.choices(WORDS, weights=[9, 8] + [1] * (len(WORDS) - 2), k=rng.randint(0, 25))
        rows.append((f"d{i:03d}", rng.choice(namespaces), " ".join(words)))
    rows += [(f"x{i}", "a", "the cat hook_fn") for i in range(5)]
    return rows


def okapi(docs, query, k1=1.5, b=0.75, eps=0.25):
    """Slow scoring of one namespace, document by document."""
    bags = {d: Counter(w.lower() for w in re.findall(r"\w+", t)) for d, t in docs if t}
    if not bags:
        return {}
    avgdl = sum(sum(c.values()) for c in bags.values()) / len(bags)
    n = Counter(w for c in bags.values() for w in c)
    raw = {w: math.log(len(bags) - f + 0.5) - math.log(f + 0.5) for w, f in n.items()}
    floor = eps * sum(raw.values()) / max(1, len(raw))
    idf = {w: floor if v < 0 else v for w, v in raw.items()}
    scores = {}
    for d, bag in bags.items():
        dl, total = sum(bag.values()), 0.0
        for w in (w.lower() for w in re.findall(r"\w+", query)):
            f = bag.get(w, 0)
            if f:
                total += idf[w] * f * (k1 + 1) / (f + k1 * (1 - b + b * dl / avgdl))
        if total > 0:
            scores[d] = total
    return scores


def expected_hits(rows, queries, k):
    out = {}
    for qid, question, namespaces in queries:
        for ns in namespaces:
            scores = okapi([(d, t) for d, n, t in rows if n == ns], question)
            order = sorted(scores, key=lambda d: (-round(scores[d], 9), d))[:k]
            for rank, d in enumerate(order):
                out[qid, ns, rank] = (d, scores[d])
    return out


QUERIES = [
    ("q1", "the hook_fn", ["a"]),
    ("q2", "Tensor graph the the of", ["a", "b"]),
    ("q3", "!!!", ["a"]),
    ("q4", "absent_word", ["a", "b"]),
    ("q5", "cat dog cat", ["c", "b", "a", "zzz"]),
    ("q6", "cat", []),
]


def as_hits(df):
    return {(r["query_id"], r["namespace"], r["rank"]): (r["doc_id"], r["score"]) for r in df.collect()}


@pytest.fixture
def tables(spark):
    rows = corpus()
    chunks = spark.createDataFrame(rows, "doc_id string, namespace string, text string")
    queries = spark.createDataFrame(QUERIES, "query_id string, question string, namespaces array<string>")
    return rows, chunks, queries


@pytest.mark.parametrize("way", ["blocks", "join", "written"])
def test_bm25_equals_slow_scoring(spark, tables, way, monkeypatch, tmp_path):
    rows, chunks, queries = tables
    index = bm.Bm25Index.build(chunks)
    if way == "join":
        monkeypatch.setattr(bm, "MAX_BLOCK_WEIGHTS", 0)
        monkeypatch.setattr(bm, "MAX_BROADCAST_ROWS", 0)
    if way == "written":
        index.write(str(tmp_path))
        index = bm.Bm25Index.read(spark, str(tmp_path))
        assert index.size("a") == sum(1 for _, n, t in rows if n == "a" and t)
    for k in (4, 50):
        got, want = as_hits(bm.bm25_search(index, queries, k)), expected_hits(rows, QUERIES, k)
        assert {key: d for key, (d, _) in got.items()} == {key: d for key, (d, _) in want.items()}
        for key in want:
            assert got[key][1] == pytest.approx(want[key][1], abs=1e-9)


def test_written_index_keeps_namespace_strings(spark, tmp_path):
    rows = [("1", "007", "alpha beta"), ("2", "007", "gamma"), ("3", "007", "delta"), ("4", "8", "alpha")]
    chunks = spark.createDataFrame(rows, "doc_id string, namespace string, text string")
    bm.Bm25Index.build(chunks).write(str(tmp_path))
    asked = spark.createDataFrame([("q", "alpha", ["007"])], "query_id string, question string, namespaces array<string>")
    hits = bm.bm25_search(bm.Bm25Index.read(spark, str(tmp_path)), asked).collect()
    assert [(r["namespace"], r["doc_id"]) for r in hits] == [("007", "1")]


def test_bm25_empty_corpus(spark, tables):
    _, chunks, queries = tables
    assert bm.bm25_search(bm.Bm25Index.build(chunks.limit(0)), queries).count() == 0


def test_bm25_persisted_index(spark, tables):
    rows, chunks, queries = tables
    index = bm.Bm25Index.build(chunks).persist()
    assert len(as_hits(bm.bm25_search(index, queries, 4))) == len(expected_hits(rows, QUERIES, 4))
    index.unpersist()


def vectors(seed=2, n=90, dim=8):
    rng = np.random.default_rng(seed)
    made = rng.integers(-3, 4, (n, dim)).astype(float)
    made[10:16] = made[3]
    return [(f"v{i:03d}", "ab"[i % 2], [float(x) for x in v]) for i, v in enumerate(made) if v.any()]


@pytest.mark.parametrize("per_pass", [4096, 5])
def test_dense_equals_slow_scoring(spark, monkeypatch, per_pass):
    monkeypatch.setattr(ba, "MAX_BATCH_QUERIES", per_pass)
    monkeypatch.setattr(dn, "MAX_BATCH_QUERIES", per_pass)
    rows = vectors()
    asked = [(i, ["a", "b"][: 1 + i % 2], rows[i * 7][2]) for i in range(6)] + [(99, [], rows[0][2])]
    chunks = spark.createDataFrame(rows, "doc_id string, namespace string, embedding array<float>").repartition(5)
    queries = spark.createDataFrame(asked, "query_id long, namespaces array<string>, vector array<float>")
    got = as_hits(dn.dense_search(chunks, queries, 7))
    want = {}
    for qid, namespaces, q in asked:
        for ns in namespaces:
            score = {
                d: np.dot(v, q) / (np.linalg.norm(v) * np.linalg.norm(q)) for d, n, v in rows if n == ns
            }
            for rank, d in enumerate(sorted(score, key=lambda d: (-round(score[d], 9), d))[:7]):
                want[qid, ns, rank] = (d, score[d])
    assert {k: d for k, (d, _) in got.items()} == {k: d for k, (d, _) in want.items()}
    assert all(got[k][1] == pytest.approx(want[k][1], abs=1e-9) for k in want)


def ranked(spark, lists):
    rows = [("q", ns, no, d, r) for no, (ns, ids) in enumerate(lists) for r, d in enumerate(ids)]
    return spark.createDataFrame(rows, "query_id string, namespace string, list_no int, doc_id string, rank int")


def slow_fuse(lists):
    score, best = {}, {}
    for ids in lists:
        for r, d in enumerate(ids):
            score[d] = score.get(d, 0.0) + 1.0 / (60 + r + 1)
            best[d] = min(best.get(d, 10**9), r)
    return [(d, score[d]) for d in sorted(score, key=lambda d: (-score[d], best[d], d))]


def in_order(df):
    return [(r["doc_id"], r["score"]) for r in df.orderBy("rank").collect()]


def test_hybrid_fuse(spark):
    rng = random.Random(11)
    for _ in range(6):
        a, b = (rng.sample([f"d{i}" for i in range(12)], rng.randint(0, 10)) for _ in range(2))
        got = hybrid_fuse(ranked(spark, [("n", a)]), ranked(spark, [("n", b)]))
        assert in_order(got) == slow_fuse([a, b])


def test_cross_namespace_fuse(spark):
    names = ["n1", "n2", "n3"]
    queries = spark.createDataFrame([("q", names)], "query_id string, namespaces array<string>")
    cases = [
        [["a", "b"], ["c", "d"], []],
        [["x"], ["x"], ["x", "a"]],
        [["a", "b", "c"], ["b", "a", "c"], []],
        [["p"], ["dummy", "q"], ["q"]],
        [[], [], []],
    ]
    for lists in cases:
        fused = ranked(spark, list(zip(names, lists, strict=True))).withColumn("score", F.lit(0.5))
        assert in_order(cross_namespace_fuse(fused, queries)) == slow_fuse(lists)
    one = spark.createDataFrame([("q", ["n1"])], "query_id string, namespaces array<string>")
    fused = ranked(spark, [("n1", ["b", "a"])]).withColumn("score", 0.5 - F.col("rank") / 10)
    assert in_order(cross_namespace_fuse(fused, one)) == [("b", 0.5), ("a", 0.4)]
    both = ranked(spark, [("n2", ["x"]), ("n1", ["x"])]).withColumn("score", F.lit(0.5))
    assert cross_namespace_fuse(both, queries).first()["namespace"] == "n1"


def test_rrf_ties_by_first_appearance(spark):
    lists = [["z", "b"], ["a", "b"], ["y"]]
    got = in_order(rrf(ranked(spark, [("n", ids) for ids in lists])))
    assert [d for d, _ in got] == ["b", "z", "a", "y"]
    assert got[0][1] == 1 / 62 + 1 / 62


def test_spread_row_number(spark):
    rng = random.Random(4)
    ids = rng.sample(range(10000), 600)
    rows = [(f"k{i:05d}", "hot" if rng.random() < 0.8 else rng.choice("abc")) for i in ids]
    df = spark.createDataFrame(rows, "key string, grp string").repartition(6)
    got = {r["key"]: (r["position"], r["group_size"]) for r in spread_row_number(df, "grp", "key", buckets=5).collect()}
    for group in {g for _, g in rows}:
        keys = sorted(k for k, g in rows if g == group)
        assert [got[k] for k in keys] == [(i, len(keys)) for i in range(len(keys))]


def test_hybrid_search_end_to_end(spark, tables):
    rows, chunks, queries = tables
    rng = np.random.default_rng(0)
    emb = [(d, [float(x) for x in rng.normal(size=4)]) for d, _, _ in rows]
    full = chunks.join(spark.createDataFrame(emb, "doc_id string, embedding array<float>"), "doc_id")
    for name, kind in [("file_path", "string"), ("symbol", "string"), ("chunk_type", "string"), ("heading_path", "string"),
                       ("language", "string"), ("commit_sha", "string"), ("start_line", "int"), ("end_line", "int")]:
        full = full.withColumn(name, F.lit(None).cast(kind))
    asked = queries.withColumn("vector", F.array(*[F.lit(float(x)) for x in (1, 0, 2, 1)]))
    result = hybrid_search(full, bm.Bm25Index.build(full), asked, 5, Settings(retriever_top_k=10))
    got = result.hydrated.collect()
    assert {r["query_id"] for r in got} == {"q1", "q2", "q3", "q4", "q5"}
    text = {d: t for d, _, t in rows}
    for r in got:
        assert r["text"] == text[r["doc_id"]] and r["chunk_type"] == "doc"
        assert set(r["metadata"]) == {"heading_path", "language", "commit_sha", "start_line", "end_line"}
        assert set(r["metadata"].values()) == {""}
    bm_hits = expected_hits(rows, QUERIES, 10)
    lexical = [bm_hits["q1", "a", r][0] for r in range(10) if ("q1", "a", r) in bm_hits]
    unit = {d: np.dot(v, (1, 0, 2, 1)) / np.linalg.norm(v) for d, v in emb}
    near = sorted((d for d, n, _ in rows if n == "a"), key=lambda d: (-unit[d], d))[:10]
    final = [(r["doc_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == "q1"]
    assert final == slow_fuse([lexical, near])[:5]
    debug = {r["query_id"]: r for r in search_debug(result, asked).collect()}
    assert [h["doc_id"] for h in debug["q1"]["bm25_top"]] == lexical
    assert [h["doc_id"] for h in debug["q1"]["dense_top"]] == near
    assert [h["doc_id"] for h in debug["q1"]["rrf_top"]] == [d for d, _ in final]
    assert debug["q6"]["bm25_top"] == []


def test_scoring_takes_documents_in_slices(spark, monkeypatch):
    """What a task holds at a time is bounded, whatever the size of an Arrow batch; hits stay the same."""
    seen = []

    def cuts(sizes, bound):
        found = blocks.cuts(sizes, bound)
        seen.append(max((int(sum(sizes[a:b])) for a, b in found if b - a > 1), default=0) <= bound)
        return found

    import pyarrow as pa

    from corpusloom.operators import blocks

    monkeypatch.setattr(bm, "SLICE_TOKENS", 30)
    monkeypatch.setattr(bm, "MAX_ENTRIES", 4)
    monkeypatch.setattr(bm, "cuts", cuts)
    weights = {"a": (pa.array(["blue", "red"]), 4.0, np.array([0, 1]), np.array([0, 2]), np.array([2, 1]), np.array([0, 1, 0]), np.array([1.0, 2.0, 0.5]))}

    class Sent:
        value = (pa.array(["p", "q"]), weights)

    texts = [["red", "blue"] * (i % 7) + ["grey"] * (i % 5) for i in range(60)]
    batch = pa.RecordBatch.from_arrays(
        [pa.array([f"{i:03}" for i in range(60)]), pa.array(["a"] * 60), pa.array([len(t) for t in texts], pa.int32()), pa.array(texts, pa.list_(pa.string()))],
        names=["doc_id", "namespace", "dl", "tokens"],
    )
    parts = list(bm._block_scorer(Sent, 60, 1.2, 0.75)([batch]))
    got = {(q, d): s for part in parts for q, _, d, s in zip(*(c.to_pylist() for c in part.columns))}
    assert len(parts) > 5 and all(seen) and len(seen) > len(parts)
    want = {}
    for i, text in enumerate(texts):
        for term, query, weight in (("blue", "p", 1.0), ("blue", "q", 2.0), ("red", "p", 0.5)):
            if tf := text.count(term):
                want[query, f"{i:03}"] = want.get((query, f"{i:03}"), 0) + weight * tf / (tf + 1.2 * (0.25 + 0.75 * len(text) / 4.0))
    assert got == pytest.approx(want)


def test_written_index_is_split_by_size_and_keeps_its_figures(spark, tmp_path):
    """No task sorts all of a frequent bucket; the figures are those of the corpus."""
    rows = [(str(i), "a", "red " * (i % 3 + 1) + f"w{i}") for i in range(400)] + [("x", "b", "--")]
    index = bm.Bm25Index.build(spark.createDataFrame(rows, "doc_id string, namespace string, text string"))
    size = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    try:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "256")
        index.write(str(tmp_path), salts=1)
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", size)
    files = spark.read.parquet(f"{tmp_path}/postings").where("term = 'red'").select(F.input_file_name()).distinct().count()
    assert files > 1
    stored = bm.Bm25Index.read(spark, str(tmp_path))

    def same(a, b, *columns):
        return sorted(a.select(*columns).collect()) == sorted(b.select(*columns).collect())

    assert same(stored.frequencies, index.frequencies, "namespace", "term", "n")
    assert same(stored.means.where("namespace = 'a'"), index.means, "namespace", "n_docs", "avgdl")
