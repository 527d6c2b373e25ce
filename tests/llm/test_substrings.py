import hashlib
import random

import numpy as np
import pytest

from corpusloom.llm.substrings import leftmost_minima, meeting_parts, remove_repeats, repeated_starts, sliding_minimum

SCHEMA = "doc_id long, text string, spans string, n_bytes int"


def brute(texts, width):
    """All windows of all texts in one dictionary."""
    bodies = [(t or "").encode() for t in texts]
    places = {}
    for i, body in enumerate(bodies):
        for at in range(len(body) - width + 1):
            places.setdefault(body[at : at + width], []).append((i, at))
    gone = [np.zeros(len(b), bool) for b in bodies]
    for found in places.values():
        if len(found) > 1:
            for i, at in found:
                gone[i][at : at + width] = True
    out = []
    for body, mask in zip(bodies, gone):
        edges = np.diff(np.concatenate([[False], mask]).astype(int))
        rest = bytes(np.frombuffer(body, np.uint8)[~mask])
        out.append((len(body), int(mask.sum()), int((edges == 1).sum()), hashlib.sha256(rest).hexdigest(), rest))
    return out


def compare(spark, texts, **options):
    docs = spark.createDataFrame([(i, t, "s", 0) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in remove_repeats(docs, **options).collect()}
    want = brute(texts, options.get("width", 400))
    assert [got[i] for i in range(len(texts))] == want


def odd_texts(rng):
    text = lambda n: "".join(rng.choice("abé ") for _ in range(n))
    shared = text(60)
    rows = [None, "", "x", "a" * 300, "ab" * 200, text(25)]
    rows += [text(rng.randint(0, 30)) + shared[rng.randint(0, 20) :][: rng.randint(10, 60)] + text(rng.randint(0, 30)) for _ in range(60)]
    rows += [text(500)] + rows[-3:] + ["日本語" * 50]
    return rows


@pytest.mark.parametrize("max_segments", [256, 3])
def test_equals_brute_force(spark, max_segments):
    compare(spark, odd_texts(random.Random(max_segments)), width=24, anchor=8, max_segments=max_segments)


def test_supplied_documents(spark):
    compare(spark, [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()])


@pytest.mark.parametrize("max_segments", [256, 1])
def test_null_and_shared_ids(spark, max_segments):
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared = text(90)
    rows = [(None, shared), (1, shared), (2, text(9) + shared[:70] + text(20)), (3, text(30) + shared[15:] + text(9))]
    rows += [(None, text(60)), (None, shared[20:60]), (7, shared[40:] + text(9)), (7, text(40)), (None, shared), (None, None)]
    docs = spark.createDataFrame([(*r, "s", 0) for r in rows], SCHEMA).repartition(3)
    got = remove_repeats(docs, width=24, anchor=8, max_segments=max_segments).collect()
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in got]
    want = [(i, *w) for (i, _), w in zip(rows, brute([t for _, t in rows], 24))]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], SCHEMA)).collect() == []


def test_helpers():
    rng = np.random.default_rng(3)
    for n in (0, 1, 6, 7, 8, 50):
        values = rng.integers(0, 99, n)
        assert sliding_minimum(values, 7).tolist() == [values[i : i + 7].min() for i in range(n - 6)]
    parts = [b"abcdefgh", b"xxbcdefg", b"zzzzzz", b"yyyyy"]
    assert [r.tolist() for r in repeated_starts(parts, 5)] == [[1, 2], [2, 3], [0, 1], []]


def test_suffix_arrays_get_what_can_share_a_window():
    """Of segments around one anchor, those go on that share a window; of unlike ones nothing does."""
    rng = random.Random(8)
    text = lambda n: bytes(rng.choices(b"abcdefgh", k=n))
    width, anchor, key = 80, 8, b"ANCHORED"
    place = width - anchor
    sides = [(text(place), text(place)) for _ in range(60)]
    unlike = [(7, 100 + i, 1, place, left + key + right) for i, (left, right) in enumerate(sides)]
    assert meeting_parts(unlike, width, anchor) == []
    for _ in range(200):  # neighbours that agree on a few bytes before and after the anchor
        before, after = rng.randint(0, place), rng.randint(0, place)
        left, right = text(place), text(place)
        rows = [(7, i, c, place, (text(place - before) + left[place - before :]) + key + right[:after] + text(place - after)) for i, c in enumerate((1, 1, 2))]
        rows += rng.sample(unlike, 3)
        want = {s: starts.tolist() for (_, s, *_), starts in zip(rows, repeated_starts([r[4] for r in rows], width))}
        parts = meeting_parts(rows, width, anchor)
        got = {s: (first + starts).tolist() for (*_, s, _, first, _), starts in zip(parts, repeated_starts([p[4] for p in parts], width) if parts else [])}
        assert [got.get(s, []) for s in want] == list(want.values())
    known = [(7, i, 2, place, text(9) + sides[0][0][9:] + key + sides[0][1]) for i in range(3)]
    assert meeting_parts(known, width, anchor) == []  # all windows of a segment that comes twice are repeated


def test_minima_compare_whole_values():
    """Values that differ in their last bits only, in arrays of many lengths: the place is that of the smallest."""
    rng = np.random.default_rng(6)
    for count in (5, 40, 3000):
        values = (rng.integers(0, 3, count).astype(np.uint64) << np.uint64(40)) + rng.integers(0, 4, count).astype(np.uint64)
        want = [i + int(values[i : i + 5].argmin()) for i in range(count - 4)]
        assert leftmost_minima(values, 5).tolist() == want


def test_long_text_beside_short_ones(spark):
    """A text of 2 MB is a block of its own; passages that it shares with short texts go from both."""
    rng = np.random.default_rng(9)
    long = bytes(rng.integers(97, 123, 2 << 20).astype(np.uint8)).decode()
    parts = [long[at : at + 450 + at % 97] for at in range(5000, len(long) - 1000, 150_001)]
    rows = [(0, long), *((i + 1, f"start {i} {part} end {i}") for i, part in enumerate(parts)), (90, long[100:499]), (91, None)]
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: (sum(map(len, parts)), len(parts)), **{i + 1: (len(part), 1) for i, part in enumerate(parts)}, 90: (0, 0), 91: (0, 0)}
