import random

import pytest
from test_retrieval import QUERIES, as_hits, corpus, expected_hits

from corpusloom.config import Settings
from corpusloom.operators import bm25 as bm
from corpusloom.operators.block_max import BlockMaxIndex, block_max_search

CHUNKS = "doc_id string, namespace string, text string"
ASKED = "query_id string, question string, namespaces array<string>"


@pytest.mark.parametrize("stored", [False, True])
def test_equals_slow_scoring(spark, stored, tmp_path):
    rows = corpus(seed=11, n=90)
    index = BlockMaxIndex.build(spark.createDataFrame(rows, CHUNKS), block_docs=2)
    if stored:
        index.write(str(tmp_path))
        index = BlockMaxIndex.read(spark, str(tmp_path))
    queries = spark.createDataFrame(QUERIES, ASKED)
    for k in (1, 4, 50):
        got, want = as_hits(block_max_search(index, queries, k).hits), expected_hits(rows, QUERIES, k)
        assert {key: d for key, (d, _) in got.items()} == {key: d for key, (d, _) in want.items()}
        for key in want:
            assert got[key][1] == pytest.approx(want[key][1], abs=1e-9)


def test_larger_batches_shuffle_with_the_same_hits(spark, monkeypatch):
    from corpusloom.operators import block_max

    rows = corpus(seed=12, n=60)
    index = BlockMaxIndex.build(spark.createDataFrame(rows, CHUNKS), block_docs=2)
    for name in ("MAX_BLOCK_WEIGHTS", "MAX_BROADCAST_ROWS"):
        monkeypatch.setattr(block_max, name, 0)
    got = as_hits(block_max_search(index, spark.createDataFrame(QUERIES, ASKED), 4).hits)
    assert {key: d for key, (d, _) in got.items()} == {key: d for key, (d, _) in expected_hits(rows, QUERIES, 4).items()}


def skewed(count=600):
    """Texts of all lengths in which a few short ones are full of what is asked for."""
    rng = random.Random(3)
    rows = []
    for i in range(count):
        words = [rng.choice("red blue green grey pale dark cold warm".split()) for _ in range(rng.choice([5, 20, 80, 300]))]
        words += ["amber"] * (rng.random() < 0.5) + ["amber", "ochre"] * (4 if i % 97 == 0 else 0)
        rows.append((str(i), "a", " ".join(words)))
    return rows


def test_blocks_below_the_last_hit_are_not_scored(spark):
    rows = skewed()
    chunks = spark.createDataFrame(rows, CHUNKS)
    asked = [("q", "amber ochre", ["a"]), ("r", "amber", ["a"])]
    queries = spark.createDataFrame(asked, ASKED)
    index = BlockMaxIndex.build(chunks, block_docs=8)
    found = block_max_search(index, queries, 3)
    want = as_hits(bm.bm25_search(bm.Bm25Index.build(chunks), queries, 3))
    assert {key: d for key, (d, _) in as_hits(found.hits).items()} == {key: d for key, (d, _) in want.items()}

    def postings(blocks, term):
        lists = index.lists.where(f"term = '{term}'").join(blocks.select("block").distinct(), "block")
        return lists.agg({"n": "sum"}).first()[0] or 0

    scored = found.first.unionByName(found.rest).where("query_id = 'q'")
    every = index.lists.where("term = 'amber'").agg({"n": "sum"}).first()[0]
    assert postings(scored, "amber") < every / 2


def test_ceilings_hold_for_any_weighting(spark):
    rows = skewed(200)
    chunks = spark.createDataFrame(rows, CHUNKS)
    queries = spark.createDataFrame([("q", "amber pale", ["a"])], ASKED)
    index = BlockMaxIndex.build(chunks, block_docs=4)
    for k1, b in ((0.4, 0.0), (3.0, 1.0), (0.0, 0.5)):
        settings = Settings(bm25_k1=k1, bm25_b=b)
        got = as_hits(block_max_search(index, queries, 5, settings).hits)
        assert got.keys() == as_hits(bm.bm25_search(bm.Bm25Index.build(chunks), queries, 5, settings)).keys()


def test_blank_questions_and_empty_corpus(spark):
    index = BlockMaxIndex.build(spark.createDataFrame([("1", "a", "red")], CHUNKS))
    queries = spark.createDataFrame([("q", "  ", ["a"]), ("r", None, ["a"]), ("s", "red", None)], ASKED)
    assert block_max_search(index, queries).hits.count() == 0
    empty = BlockMaxIndex.build(spark.createDataFrame([], CHUNKS))
    assert block_max_search(empty, queries).hits.count() == 0


def test_lists_of_whole_blocks_are_cut_in_their_tasks(spark):
    """One list per term and block though a batch is taken in slices; a batch whose weights are shipped groups no postings."""
    rows = skewed(120)
    index = BlockMaxIndex.build(spark.createDataFrame(rows, CHUNKS), block_docs=4)
    lists = index.lists.persist()
    assert lists.count() == lists.select("namespace", "term", "block").distinct().count()
    want = {(d, w): text.split().count(w) for d, _, text in rows for w in set(text.split())}
    got = {(p["doc_id"], r["term"]): p["tf"] for r in lists.collect() for p in r["postings"]}
    assert got == want
    for row in lists.collect():
        assert (row["n"], row["max_tf"], row["min_dl"]) == (len(row["postings"]), max(p["tf"] for p in row["postings"]), min(p["dl"] for p in row["postings"]))
    assert "ObjectHashAggregate" not in index.lists._jdf.queryExecution().executedPlan().toString()
    lists.unpersist()


def test_disk_follows_the_texts(spark, tmp_path, monkeypatch):
    """What a written index and its search hold on disk, with nothing given back meanwhile, is about the size of the texts."""
    from corpusloom.operators import block_max

    monkeypatch.setattr(block_max, "release", lambda spark: None, raising=False)
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(3000)]
    rows = [(str(i), "ab"[i % 2], " ".join(words[int(len(words) * rng.random() ** 3)] for _ in range(150))) for i in range(3000)]
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        files = disk.getAllFiles()
        found = (files.apply(i) for i in range(files.size()))
        return {f.getName(): f.length() for f in found if f.getName().startswith("shuffle")}

    chunks = spark.createDataFrame(rows, CHUNKS).persist()
    chunks.count()
    before = shuffled()
    BlockMaxIndex.build(chunks, block_docs=16).write(str(tmp_path))
    queries = spark.createDataFrame([(f"q{i}", " ".join(words[i::100]), ["a", "b"]) for i in range(20)], ASKED)
    found = block_max_search(BlockMaxIndex.read(spark, str(tmp_path)), queries, 10)
    got = as_hits(found.hits)
    moved = sum(size for name, size in shuffled().items() if name not in before)
    stored = sum(f.stat().st_size for f in tmp_path.rglob("*") if f.is_file())
    found.release()
    want = as_hits(bm.bm25_search(bm.Bm25Index.build(chunks), queries, 10))
    assert {key: d for key, (d, _) in got.items()} == {key: d for key, (d, _) in want.items()}
    chunks.unpersist()
    text = sum(len(t) for _, _, t in rows)
    assert moved + stored < 1.3 * text, (moved / text, stored / text)


def test_repeated_ids_and_slices_of_a_segment(spark, tmp_path, monkeypatch):
    """Rows of one id and length are one document, also where a segment is cut in many slices; texts without words have no lists."""
    from corpusloom.operators import block_max

    rows = [(str(i % 40) if i % 7 else None, "ab"[i % 2], f"red {'blue ' * (i % 3)}w{i % 5}") for i in range(120)] + [("x", "a", " . "), ("y", "a", "")]
    monkeypatch.setattr(block_max, "SLICE_TOKENS", 8)
    index = BlockMaxIndex.build(spark.createDataFrame(rows, CHUNKS), block_docs=2)
    index.write(str(tmp_path))
    index = BlockMaxIndex.read(spark, str(tmp_path))
    lists = index.lists.collect()
    assert len(lists) == len({(r["namespace"], r["term"], r["block"]) for r in lists})
    assert sum(r["n"] for r in lists) == sum(len(set(t.split())) for _, _, t in rows[:120])
    queries = spark.createDataFrame([("q", "blue w3", ["a", "b"])], ASKED)
    hits = block_max_search(index, queries, 200).hits.collect()
    documents = {(n, i, len(t.split())) for i, n, t in rows[:120] if {"blue", "w3"} & set(t.split())}
    assert len(hits) == len(documents)
