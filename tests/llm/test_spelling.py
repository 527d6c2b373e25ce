import random
import re
import zlib
from collections import Counter

import pytest

from corpusloom.llm import spelling
from corpusloom.llm.spelling import near_words, spelling_variants, trie_nodes

SCHEMA = "doc_id long, text string, word string, n int"


def table(spark, rows):
    return spark.createDataFrame([(*row, "x", 3) for row in rows], SCHEMA)


def counted(rows):
    """Words of the texts, letter by letter."""
    found = Counter()
    for doc, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {word: n for word, n in found.items() if len(word) >= 6 and n >= 5}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(a == b[:i] + b[i + 1 :] for i in range(len(b)))


def brute(words):
    near = {a: [b for b in words if one_apart(a, b)] for a in words}
    form = {}
    for a in words:
        best = min(near[a], key=lambda b: (-words[b], b), default=None)
        form[a] = best if best is not None and words[best] >= 5 * words[a] else None

    def root(a):
        return a if form[a] is None else root(form[a])

    return sorted((a, form[a] or "", root(a), words[a], len(near[a]), words.get(form[a]) or 0) for a in words)


def rows_of(result):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in result.collect())


def variants(seed, count, letters="abeé"):
    rng = random.Random(seed)
    words = {}
    for _ in range(count):
        word = "".join(rng.choice(letters) for _ in range(rng.randrange(6, 9)))
        words[word] = rng.choice([5, 5, 6, 30, 150, 800])
    return words


@pytest.mark.parametrize("seed", range(3))
def test_near_words_equal_all_pairs(spark, seed):
    words = variants(seed, 150)
    got = near_words(spark.createDataFrame(list(words.items()), "word string, n long").repartition(5))
    assert rows_of(got) == brute(words)


def test_supplied_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    words = counted([(r.doc_id, r.text) for r in docs.collect()])
    assert rows_of(spelling_variants(docs)) == brute(words)


def test_texts_with_nulls_and_equal_rows(spark):
    rows = [(1, None), (2, ""), (None, "Straßen straßen STRASSEN"), (None, "straßen strabßen"), (3, "÷×ÿÀéß a b")] * 6
    rows += [(i, f"straßen{chr(9)}Strassen,strabßen x{i}") for i in range(400)]
    assert rows_of(spelling_variants(table(spark, rows))) == brute(counted(rows))
    assert spelling_variants(table(spark, [])).collect() == []
    assert spelling_variants(table(spark, [(1, None), (2, "short")])).collect() == []


def test_chains_lead_to_their_root(spark):
    words = {"aaaaaa": 5, "aaaaab": 25, "aaaabb": 125, "aaabbb": 625, "aabbbb": 3125, "abbbbb": 15625, "bbbbbb": 78125, "bbbbbbb": 400000}
    got = near_words(spark.createDataFrame(list(words.items()), "word string, n long"))
    assert rows_of(got) == brute(words)
    assert {r.root for r in got.collect()} == {"bbbbbbb"}


def test_one_very_long_word(spark):
    """Pairs are numbers, so a word of many letters makes no rows of its own size."""
    long = "ab" * 20_000
    words = {long: 50, long[1:]: 5, long + "c": 9, "abcdef": 7}
    got = {r.word: (r.form, r.n_near) for r in near_words(spark.createDataFrame(list(words.items()), "word string, n long")).collect()}
    assert got == {long: (None, 2), long[1:]: (long, 1), long + "c": (long, 1), "abcdef": (None, 0)}


def test_nodes_are_prefixes_across_ranges(spark, monkeypatch):
    """Equal prefixes have one number and different ones two, whatever ranges the words fell into."""
    words = sorted({*variants(9, 400, "ab"), "a", "ab", "aba", "z"})
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = trie_nodes(spark.createDataFrame([(w,) for w in words], "word string").repartition(3), "word").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    nodes = {}
    for r in rows:
        assert len(r.path) == len(r.word) + 1
        for depth, node in enumerate(r.path):
            assert nodes.setdefault(node, r.word[:depth]) == r.word[:depth]
    assert len(nodes) == len({w[:d] for w in words for d in range(len(w) + 1)})
    assert [r.word for r in sorted(rows, key=lambda r: r.number)] == words


def test_shared_prefix():
    assert [spelling._shared(a, b) for a, b in (("", "a"), ("abc", "abd"), ("abc", "abc"), ("ab", "abc"))] == [0, 2, 3, 2]
