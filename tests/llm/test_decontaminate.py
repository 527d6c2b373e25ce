import hashlib
import random
import re

import numpy as np

from corpusloom.llm.decontaminate import FmIndex, benchmark_hits, contamination_digest

DOCS = "doc_id long, text string, item_id string, spans int"
ITEMS = "item_id long, text string, doc_id long"


def words(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute(text, items, window):
    """Every window of every item at every place."""
    have, hit, found = words(text), set(), set()
    for item, passage in items:
        w = words(passage)
        for at in range(max(1, len(w) - window + 1) if w else 0):
            phrase = w[at : at + window]
            for start in range(len(have) - len(phrase) + 1):
                if have[start : start + len(phrase)] == phrase:
                    hit.update(range(start, start + len(phrase)))
                    found.add(str(item))
    sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    return (len(have), len(hit), len(found), sha, bool(hit))


def compare(spark, docs, items, **options):
    found = benchmark_hits(
        spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(docs)], DOCS),
        spark.createDataFrame([(i, t, 3) for i, t in items], ITEMS),
        **options,
    )
    got = {r.doc_id: tuple(r)[1:] for r in contamination_digest(found).collect()}
    assert got == {i: brute(t, items, options.get("window", 10)) for i, t in enumerate(docs)}


def test_equals_brute_force(spark):
    rng = random.Random(3)
    vocabulary = ["a", "b", "c", "dé", "é", "9", "zz"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.randint(0, 9))) for i in range(12)] + [(50, "a b"), (51, "A, b!"), (52, None), (53, "q")]
    docs = [None, "", "  ", "a", "A-B", "q q;Q"] + [text(rng.randint(1, 60)) for _ in range(60)] + [text(3000)]
    compare(spark, docs, items, window=4)
    compare(spark, docs, items, window=4, phrase_bytes=300)  # several passes
    compare(spark, docs, [(1, "")], window=4)
    compare(spark, docs, [], window=4)


def test_supplied_tables(spark):
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    compare(spark, docs, items)


def test_empty_documents(spark):
    found = benchmark_hits(spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a b", 3)], ITEMS))
    assert contamination_digest(found).collect() == []


def test_backward_search_and_locate():
    rng = np.random.default_rng(1)
    text = rng.integers(1, 5, 500)
    index = FmIndex(text)
    phrases = rng.integers(1, 7, (80, 3))
    low, high = index.search(phrases, np.full(80, 3))
    for phrase, a, b in zip(phrases, low, high):
        want = [i for i in range(498) if (text[i : i + 3] == phrase).all()]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want
