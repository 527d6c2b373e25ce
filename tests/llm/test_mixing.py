import random
import re

import numpy as np
import pytest

from corpusloom.llm.mixing import flight, landing, mix_sources, settle, word_counts

SCHEMA = "doc_id long, text string, source string, size string, number int"


def table(spark, rows):
    return spark.createDataFrame([(*row, "x", 3) for row in rows], SCHEMA)


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def targets(sizes):
    """The excess is shared again until none is above: a plain loop."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    want, full = dict.fromkeys(order, 0.0), set()
    left = 1.5 * sum(sizes.values())
    while left > 1e-9:
        free = [s for s in order if s not in full]
        total, given = sum(weight[s] for s in free), left
        left = 0.0
        for s in free:
            want[s] += given * weight[s] / total
            if want[s] > 2 * sizes[s]:
                left += want[s] - 2 * sizes[s]
                want[s] = 2.0 * sizes[s]
                full.add(s)
    return want


def check(result, rows, near):
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + words(text)
    want, taken = targets(sizes), dict.fromkeys(sizes, 0)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.source or "", r.size) for r in result) == sorted((i is None, i or 0, s or "", words(t)) for i, t, s in rows)
    for r in result:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert r.taken == r.times * r.size and 0 <= r.times <= 2
        taken[r.source] += r.taken
    for source in sizes:
        assert abs(taken[source] - want[source]) <= near, source


def texts(count, seed, longest=300):
    rng = random.Random(seed)
    return [(i, "w " * int(rng.paretovariate(0.8) % longest), f"s{rng.randrange(7)}") for i in range(count)]


def test_sources_come_near_their_targets(spark):
    rows = texts(3000, 1)
    docs = table(spark, rows)
    first = mix_sources(docs, group=128).collect()
    check(first, rows, near=2)
    again = mix_sources(docs.repartition(7), group=128).collect()
    assert sorted(first, key=str) == sorted(again, key=str)


def test_nulls_equal_rows_and_empty_texts(spark):
    rows = [(None, "a b c", None)] * 200 + [(5, "a b", "x")] * 300 + [(6, None, "x"), (7, "", None), (8, " \n", "y"), (9, "one word two", "z")]
    rows += [(i, "a " * (i % 50), "x") for i in range(400)]
    check(mix_sources(table(spark, rows), group=32).collect(), rows, near=2)


def test_empty_table_and_one_source_without_words(spark):
    assert mix_sources(table(spark, [])).collect() == []
    (row,) = mix_sources(table(spark, [(1, None, None)])).collect()
    assert (row.size, row.source_size, row.target, row.taken) == (0, 0, 0.0, 0)


def test_supplied_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    check(mix_sources(docs).collect(), rows, near=40)


def test_flight_keeps_both_sums_and_leaves_two():
    rng = random.Random(3)
    sizes = [float(rng.choice([1, 5, 5, 5, 90, rng.randrange(1, 1000)])) for _ in range(500)]
    chances = [rng.random() for _ in sizes]
    out = flight(chances, sizes, random.Random(1))
    assert sum(0 < c < 1 for c in out) <= 2
    assert sum(out) == pytest.approx(sum(chances)) and np.dot(out, sizes) == pytest.approx(np.dot(chances, sizes))


def test_flight_takes_each_with_its_chance():
    sizes, chances = [1.0, 2.0, 4.0, 8.0, 3.0, 3.0, 7.0, 5.0], [0.1, 0.5, 0.9, 0.3, 0.7, 0.2, 0.4, 0.6]
    seen = np.mean([flight(chances, sizes, random.Random(k)) for k in range(4000)], axis=0)
    assert abs(seen - chances).max() < 0.03


def test_last_problem_makes_up_for_a_large_document():
    sizes = [5000.0, *(float(2 ** (k % 12)) for k in range(48))]
    chances = [0.5] * len(sizes)
    out = settle(chances, sizes, True, "seed")
    assert set(out) == {0.0, 1.0} and abs(np.dot(out, sizes) - np.dot(chances, sizes)) <= 1
    assert landing([0.6], [10.0]) == [1.0]


def test_word_counts_of_blocks():
    samples = ["", "a", " a", "a b", "é  x\n", "  ", "x" * 100]
    data = np.frombuffer("".join(samples).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(s.encode()) for s in samples])])
    assert word_counts(data, offsets).tolist() == [words(s) for s in samples]
