"""Benchmark passages in training texts, found with an FM-index per shard of texts."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.batches import TextBlock, apart, giving_back, text_blocks
from corpusloom.llm.suffix import suffix_array

WINDOW_WORDS = 10
#: Texts of one index, and benchmark text sent to every task at a time.
SHARD_BYTES = 4 << 20
PHRASE_BYTES = 16 << 20
_SAMPLE = 8

#: Letters and digits in lower case stay; every other ASCII byte is a space; other bytes are letters.
_WORD_BYTES = bytes(
    b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256)
)


class WaveletMatrix:
    """Ranks of symbols in a sequence: one bit row per binary digit, with counts of ones before each place."""

    def __init__(self, sequence: np.ndarray):
        self.bits = max(1, int(sequence.max()).bit_length())
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        for bit in reversed(range(self.bits)):
            row = (sequence >> bit) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(row, dtype=np.int32)]).astype(np.int32))
            self.zeros.append(len(row) - int(self.ones[-1][-1]))
            sequence = sequence[row.argsort(kind="stable")]

    def rank(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its place."""
        first, last = np.zeros_like(places), places.copy()
        for level, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            one = (symbols >> (self.bits - 1 - level)) & 1 == 1
            first_ones, last_ones = ones[first], ones[last]
            first = np.where(one, zeros + first_ones, first - first_ones)
            last = np.where(one, zeros + last_ones, last - last_ones)
        return last - first


class FmIndex:
    """Backward search over a text of whole numbers from 1 on."""

    def __init__(self, text: np.ndarray):
        text = np.append(text, 0)
        order = suffix_array(text)
        last = text[order - 1]
        self.ranks = WaveletMatrix(last)
        self.last = last
        counts = np.bincount(text)
        self.before = np.concatenate([[0], np.cumsum(counts)])
        self.marked = order % _SAMPLE == 0
        self.marks_before = np.cumsum(self.marked) - self.marked
        self.samples = order[self.marked]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and one past the last place in the array of the suffixes that start with each phrase.

        ``phrases`` has one row per phrase, filled up on the right; symbols the text lacks are allowed.
        """
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), len(self.last), np.int64)
        for step in range(int(lengths.max(initial=0))):
            live = np.flatnonzero((lengths > step) & (low < high))
            if not len(live):
                break
            symbols = phrases[live, lengths[live] - 1 - step]
            known = symbols < len(self.before) - 1
            high[live[~known]] = low[live[~known]]
            live, symbols = live[known], symbols[known]
            low[live] = self.before[symbols] + self.ranks.rank(symbols, low[live])
            high[live] = self.before[symbols] + self.ranks.rank(symbols, high[live])
        return low, high

    def locate(self, places: np.ndarray) -> np.ndarray:
        """Text positions of places in the array: step to the left until a sampled one is met."""
        at, steps = places.copy(), np.zeros(len(places), np.int64)
        walking = np.flatnonzero(~self.marked[at])
        while len(walking):
            symbols = self.last[at[walking]]
            at[walking] = self.before[symbols] + self.ranks.rank(symbols, at[walking])
            steps[walking] += 1
            walking = walking[~self.marked[at[walking]]]
        return self.samples[self.marks_before[at]] + steps


class Phrases:
    """Windows of benchmark items as symbol rows, with the items that have each of them."""

    def __init__(self, items: Iterable[tuple[str, str | None]], window: int):
        self.symbols: dict[bytes, int] = {}
        found: dict[tuple[int, ...], dict[str, None]] = {}
        for item, text in items:
            words = [
                self.symbols.setdefault(w, len(self.symbols) + 2)
                for w in (text or "").encode().translate(_WORD_BYTES).split()
            ]
            for at in range(max(1, len(words) - window + 1) if words else 0):
                found.setdefault(tuple(words[at : at + window]), {})[item] = None
        self.items = [list(i) for i in found.values()]
        self.lengths = np.array([len(w) for w in found], np.int64)
        self.rows = np.zeros((len(found), window), np.int64)
        pairs: set[tuple[int, int]] = set()
        for row, words in enumerate(found):
            self.rows[row, : len(words)] = words
            pairs.update(zip(words, words[1:]))
        self.base = len(self.symbols) + 2
        self.pairs = np.array(sorted(a * self.base + b for a, b in pairs), np.int64)
        self.shortest = int(self.lengths.min(initial=window))

    def runs(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What of a word sequence can hold a phrase, with a 1 after each run, and its places there.

        Neighbours in a phrase are neighbours somewhere in the benchmark, so a run ends where two
        words are not; a run shorter than the shortest phrase holds none.
        """
        codes = symbols[:-1] * self.base + symbols[1:]
        joined = np.zeros(len(symbols), bool)  # with the word before
        near = np.flatnonzero((symbols[:-1] > 0) & (symbols[1:] > 0))
        if len(self.pairs) and len(near):
            at = np.searchsorted(self.pairs, codes[near])
            joined[near + 1] = self.pairs[np.minimum(at, len(self.pairs) - 1)] == codes[near]
        starts = np.flatnonzero(~joined)
        sizes = np.diff(np.append(starts, len(symbols)))
        keep = (sizes >= self.shortest) & (symbols[starts] > 0)
        starts, sizes = starts[keep], sizes[keep] + 1
        begins = np.cumsum(sizes) - sizes
        places = np.repeat(starts - begins, sizes) + np.arange(int(sizes.sum()))
        text = symbols[np.minimum(places, len(symbols) - 1)] if len(symbols) else symbols
        text[begins + sizes - 1] = 1
        return text, places


def _hits(block: TextBlock, phrases: Phrases) -> tuple[list[int], list[list[tuple[int, int]]], list[list[str]]]:
    """Word counts, merged word spans that are hit, and the items found, of each text of a shard."""
    symbol_of = phrases.symbols.get
    counts, sequences = [], []
    for row in range(len(block)):
        words = block.text(row).translate(_WORD_BYTES).split()
        counts.append(len(words))
        sequences.append(np.array([symbol_of(w, 0) for w in words] + [0], np.int64))
    spans: list[list[tuple[int, int]]] = [[] for _ in counts]
    items: list[dict[str, None]] = [{} for _ in counts]
    text, places = phrases.runs(np.concatenate(sequences))
    if len(text):
        index = FmIndex(text)
        low, high = index.search(phrases.rows, phrases.lengths)
        found = np.flatnonzero(high > low)
        sizes = (high - low)[found]
        begins = np.cumsum(sizes) - sizes
        which = np.repeat(found, sizes)
        at = index.locate(np.repeat(low[found] - begins, sizes) + np.arange(int(sizes.sum())))
        starts = places[at]
        offsets = np.cumsum([0] + [c + 1 for c in counts])
        docs = np.searchsorted(offsets, starts, side="right") - 1
        order = np.argsort(starts, kind="stable")
        for doc, phrase, start in zip(docs[order].tolist(), which[order].tolist(), (starts - offsets[docs])[order].tolist()):
            end = start + int(phrases.lengths[phrase])
            merged = spans[doc]
            if merged and start <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(end, merged[-1][1]))
            else:
                merged.append((start, end))
            items[doc].update(dict.fromkeys(phrases.items[phrase]))
    return counts, spans, [list(i) for i in items]


_ADDED = T.StructType(
    [
        T.StructField("_n_words", T.LongType()),
        T.StructField("_spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
        T.StructField("_items", T.ArrayType(T.StringType())),
    ]
)


def benchmark_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
    window: int = WINDOW_WORDS,
    phrase_bytes: int = PHRASE_BYTES,
    cut: bool = False,
) -> DataFrame:
    """``docs`` with all its columns, and _n_words, _spans (word positions, end exclusive, merged), _items (ids as text).

    Words are runs of ASCII letters, lowered, digits and non-ASCII characters. A benchmark item gives its
    windows of ``window`` words, or all its words as one if it has fewer. The benchmark is read in
    blocks of about ``phrase_bytes`` of text (one item at least), each sent to the tasks for a further
    pass over the same rows; no row is shuffled. Nulls and texts without words have no hits, items without
    words no windows; repeated rows are each reported; empty tables give no rows or no hits. With ``cut`` the
    last pass takes the spans out of the text.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_column).cast("string").alias("item"), F.col(item_text_column).cast("string").alias("text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 64
    total = items.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    blocks = max(1, -(-total // phrase_bytes))
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks)))
    kept, where = len(docs.columns), docs.columns.index(text_column)
    schema = T.StructType([*docs.schema.fields, *_ADDED.fields])
    found = docs.select(
        "*",
        F.lit(None).cast("long").alias("_n_words"),
        F.array().cast(_ADDED["_spans"].dataType).alias("_spans"),
        F.array().cast("array<string>").alias("_items"),
    )
    for block in range(blocks):
        rows = dealt.filter(F.col("block") == block).select("item", "text").collect()
        sent = spark.sparkContext.broadcast([(r["item"], r["text"]) for r in rows])

        def scan(batches: Iterable[pa.RecordBatch], sent=sent, cut=cut and block == blocks - 1) -> Iterator[pa.RecordBatch]:
            phrases = Phrases(sent.value, window)
            for batch in batches:
                at = 0
                for shard in text_blocks([batch], text_column, text_column, SHARD_BYTES):
                    rows = batch.slice(at, len(shard))
                    at += len(shard)
                    counts, spans, items = _hits(shard, phrases)
                    earlier = list(zip(rows.column(kept + 1).to_pylist(), rows.column(kept + 2).to_pylist()))
                    merged = [_merged(s, e) for s, (e, _) in zip(spans, earlier)]
                    columns = rows.columns[:kept]
                    if cut and any(merged):
                        texts = zip(columns[where].to_pylist(), merged)
                        columns[where] = pa.array([cut_words(t, s) if s else t for t, s in texts], pa.string())
                    yield pa.RecordBatch.from_arrays(
                        [
                            *columns,
                            pa.array(counts, pa.int64()),
                            pa.array(merged, _SPANS),
                            pa.array([sorted({*i, *e}) for i, (_, e) in zip(items, earlier)], pa.list_(pa.string())),
                        ],
                        names=batch.schema.names,
                    )

        found = found.mapInArrow(giving_back(scan), schema)
    return found


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _merged(spans: list[tuple[int, int]], earlier: list[dict]) -> list[dict]:
    """The union of two sorted lists of spans."""
    out: list[dict] = []
    for start, end in sorted([*spans, *((s["start"], s["end"]) for s in earlier)]):
        if out and start <= out[-1]["end"]:
            out[-1]["end"] = max(end, out[-1]["end"])
        else:
            out.append({"start": start, "end": end})
    return out


def cut_words(text: str, spans: list[dict]) -> str:
    """The text without spans of words, each from the start of its first word to the end of its last."""
    body = text.encode()
    words = [m.span() for m in re.finditer(rb"[^ ]+", body.translate(_WORD_BYTES))]
    kept, at = [], 0
    for span in spans:
        kept.append(body[at : words[span["start"]][0]])
        at = words[span["end"] - 1][1]
    return b"".join([*kept, body[at:]]).decode()


def remove_hits(docs: DataFrame, benchmark: DataFrame, *, text_column: str = "text", **options) -> DataFrame:
    """``docs`` without the spans that ``benchmark_hits`` finds; the options are its. Rows, and other columns of any
    name, stay as they are; null texts stay null; empty tables give no rows or cut nothing."""
    packed, back = apart(docs, text_column)
    return back(benchmark_hits(packed, benchmark, cut=True, **options))


def contamination_digest(found: DataFrame, *, id_column: str = "doc_id") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of the rows of ``benchmark_hits``."""
    hit = F.aggregate("_spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    return found.select(
        F.col(id_column).alias("doc_id"),
        F.col("_n_words").alias("n_words"),
        hit.alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("_items"), ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )
