import random
import re

import numpy as np
import pytest

from corpusloom.llm.neardup import (
    BANDS,
    ROWS,
    components,
    least_matches,
    near_duplicates,
    shingle_sets,
    signature,
)

SCHEMA = "doc_id long, text string, node string, n int"


def shingles(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if len(words) < 4:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 4]) for i in range(len(words) - 3)}


def brute(texts, percent=80):
    """Every pair, and union-find."""
    sets = {i: shingles(t) for i, t in texts.items()}
    parent = {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(i for i in sets if sets[i])
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(sets[i]), root(i), root(i) == i) for i in texts}


def near_copies():
    rng = random.Random(6)
    word = lambda: rng.choice(["alpha", "Beta", "ça", "d", "e"]) + str(rng.randint(0, 400))
    texts = [None, "", " \n", "one", "ONE", "one two three", "one two  Three", "one two", "a b c d", "x\x85y b c d", "É b c d", "é b c d"]
    for size in (6, 12, 40, 300):
        base = [word() for _ in range(size)]
        for share in (0.0, 0.02, 0.04, 0.05, 0.06, 0.08, 0.1, 0.2, 0.0):
            texts.append(" ".join(word() if rng.random() < share else w for w in base))
    chain = [word() for _ in range(120)]
    for at in range(0, 60, 4):  # neighbours are alike, the ends are not
        texts.append(" ".join(chain[at : at + 60]))
    base = [word() for _ in range(100)]
    for _ in range(60):  # a large group of near copies around the threshold
        copy = list(base)
        for k in rng.sample(range(100), rng.randint(1, 5)):
            copy[k] = word()
        texts.append(" ".join(copy))
    texts += ["long " * 30_000, "long " * 30_000 + "end"]
    ids = list(range(1000, 1000 + len(texts)))
    rng.shuffle(ids)
    return dict(zip(ids, texts))


@pytest.mark.parametrize("tile", [1024, 5])
def test_equals_brute_force(spark, tile):
    texts = near_copies()
    docs = spark.createDataFrame([(i, t, "n", 0) for i, t in texts.items()], SCHEMA).repartition(5)
    got = {r.doc_id: tuple(r)[1:] for r in near_duplicates(docs, tile=tile).collect()}
    assert got == brute(texts)


def test_supplied_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("doc_id < 500")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: tuple(r)[1:] for r in near_duplicates(docs).collect()}
    assert got == brute(texts)


def test_repeated_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(7, "a b c d e", "", 1)] * 3 + [(9, "a b c d e", "", 1), (7, None, "", 1)], SCHEMA)
    got = sorted(tuple(r) for r in near_duplicates(docs).collect())
    assert got == [(7, 0, 7, True)] + [(7, 2, 7, True)] * 3 + [(9, 2, 7, False)]
    assert near_duplicates(docs.filter("doc_id = 1")).collect() == []


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 150), (150, 199)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {100 + i: 100 for i in range(1, 30)} | {200: 150, 199: 150}


def test_posterior_bound():
    """The chance that a pair at the threshold is dropped stays near the chosen one; far pairs go at once."""
    rng = np.random.default_rng(0)
    least = least_matches()
    matches = rng.binomial(32, 0.8, 200_000)
    assert (matches < least[32]).mean() < 2e-5
    assert least[32] > 32 * 0.35 and least[BANDS * ROWS] > BANDS * ROWS * 0.55


def test_signature_estimates_similarity():
    words = [f"w{i}" for i in range(1200)]
    texts = [" ".join(words[:1000]).encode(), " ".join(words[100:1100]).encode()]
    sets = shingle_sets(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, len(texts[0]), len(texts[1])]))
    true = len(np.intersect1d(*sets)) / len(np.union1d(*sets))
    assert abs((signature(sets[0]) == signature(sets[1])).mean() - true) < 0.12


def test_rows_without_id(spark):
    text = lambda seed: " ".join(f"{seed}{i}" for i in range(30))
    docs = spark.createDataFrame([(None, text("a")), (None, text("b")), (5, text("b")), (None, None), (7, None)], "doc_id long, text string")
    got = sorted(((r.doc_id or -1, r.component_id or -1, r.kept) for r in near_duplicates(docs).collect()))
    assert got == [(-1, -1, True), (-1, -1, True), (-1, 5, False), (5, 5, True), (7, 7, True)]
