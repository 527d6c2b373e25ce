"""Toxicity by subword bags: byte n-gram embeddings, averaged over a short window of words, into a linear softmax."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.batches import text_blocks, two_columns

GRAMS = (3, 4, 5)
BUCKET_BITS = 17
EMBEDDING = 8
WINDOW_WORDS = 12
THRESHOLD = 0.3
#: The classifier is fitted on about so many labelled documents of each label, none longer than so many bytes.
SAMPLE_PER_LABEL = 2500
SAMPLE_BYTES = 4096
EPOCHS = 12
BATCHES = 10

_WORD_BYTES = bytes(
    b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256)
)
_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Bags:
    """N-gram buckets of texts in window order, the start of each window, and the text of each window."""

    grams: np.ndarray
    starts: np.ndarray
    texts: np.ndarray


def subword_bags(data: np.ndarray, offsets: np.ndarray, window: int = WINDOW_WORDS) -> Bags:
    """Windows of ``window`` words over whole texts, and the n-grams of their words.

    A word is a run of ASCII letters, lowered, digits and non-ASCII bytes, with a space on both sides;
    its n-grams are all substrings of it of the lengths ``GRAMS``. A word that repeats the one before it
    is passed over: it says nothing new, and a line of one word would be nothing but that word.
    """
    rows = len(offsets) - 1
    table = np.frombuffer(_WORD_BYTES, np.uint8)
    # a space before each text and two at the end, so that no n-gram spans two texts
    text = np.full(len(data) + rows + 2 * max(GRAMS), 32, np.uint8)
    row_of = np.repeat(np.arange(rows), np.diff(offsets))
    text[np.arange(len(data)) + row_of + 1] = table[data]
    n = len(data) + rows + 1
    in_word = text != 32
    edges = np.flatnonzero(in_word[1:] != in_word[:-1]) + 1
    word_at, sizes = edges[::2], edges[1::2] - edges[::2]
    if not len(word_at):
        return Bags(np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64))
    text_starts = offsets[:-1] + np.arange(rows)
    owner = np.searchsorted(text_starts, word_at, side="right") - 1
    alike = np.flatnonzero((sizes[1:] == sizes[:-1]) & (owner[1:] == owner[:-1])) + 1
    if len(alike):
        begins = np.cumsum(sizes[alike]) - sizes[alike]
        inside = np.arange(int(sizes[alike].sum())) - np.repeat(begins, sizes[alike])
        same = text[np.repeat(word_at[alike], sizes[alike]) + inside] == text[np.repeat(word_at[alike - 1], sizes[alike]) + inside]
        repeats = alike[np.logical_and.reduceat(same, begins)]
        for at, size in zip(word_at[repeats].tolist(), sizes[repeats].tolist()):
            text[at : at + size] = 32
        in_word = text != 32
        word_at, owner = np.delete(word_at, repeats), np.delete(owner, repeats)
    first_word = np.searchsorted(owner, np.arange(rows))
    number = np.arange(len(word_at)) - first_word[owner]
    opening = np.flatnonzero(number % window == 0)
    window_at = word_at[opening] - 1  # the space before its first word
    codes = np.zeros(n, np.uint64)
    whole = np.ones(n, bool)
    found, places = [], []
    for k in range(max(GRAMS)):
        codes |= text[k : n + k].astype(np.uint64) << np.uint64(8 * k)
        if k + 1 in GRAMS:
            # inner bytes belong to one word; the outer ones may be the spaces beside it
            at = np.flatnonzero(whole & (in_word[:n] | in_word[k : n + k]) if k == 1 else whole)
            mixed = (codes[at] ^ np.uint64(k)) * _MIX
            found.append((mixed >> np.uint64(64 - BUCKET_BITS)).astype(np.int32))
            places.append(at)
        if k:
            whole &= in_word[k : n + k]
    at = np.concatenate(places)
    order = np.argsort(at, kind="stable")
    grams = np.concatenate(found)[order]
    return Bags(grams, np.searchsorted(at[order], window_at), owner[opening])


def _bags_in_parts(data: np.ndarray, offsets: np.ndarray, texts: int = 250) -> Bags:
    """The same for a whole sample, a few texts at a time: the steps in between take many times the memory of the result."""
    grams, starts, owners, size = [], [], [], 0
    for first in range(0, len(offsets) - 1, texts):
        cut = offsets[first : first + texts + 1]
        part = subword_bags(data[cut[0] : cut[-1]], cut - cut[0])
        grams.append(part.grams)
        starts.append(part.starts + size)
        owners.append(part.texts + first)
        size += len(part.grams)
    return Bags(*(np.concatenate(x) for x in (grams, starts, owners)))


@dataclass
class SubwordSoftmax:
    embedding: np.ndarray  # bucket, dimension
    dense: np.ndarray  # dimension, 2
    offset: np.ndarray  # 2

    def evidence(self) -> np.ndarray:
        """What each bucket adds to the log odds of label 1: the averaging and the layer above are linear."""
        return (self.embedding @ (self.dense[:, 1] - self.dense[:, 0])).astype(np.float32)

    @property
    def bias(self) -> float:
        return float(self.offset[1] - self.offset[0])


def window_odds(bags: Bags, evidence: np.ndarray, bias: float) -> np.ndarray:
    """Log odds of each window: the mean evidence of its n-grams, plus the bias."""
    counts = np.diff(bags.starts, append=len(bags.grams))
    sums = np.add.reduceat(evidence[bags.grams], np.minimum(bags.starts, max(len(bags.grams) - 1, 0))) if len(bags.grams) else 0
    return np.where(counts > 0, sums / np.maximum(counts, 1), 0) + bias


def train(data: np.ndarray, offsets: np.ndarray, toxic: np.ndarray, epochs: int = EPOCHS, seed: int = 11) -> SubwordSoftmax:
    """Fit embeddings and softmax together with Adam.

    A text is judged by its most toxic window, as in scoring; in the first epochs by all its windows, so that
    the evidence is found at all.
    """
    rng = np.random.default_rng(seed)
    bags = _bags_in_parts(data, offsets)
    net = SubwordSoftmax(
        rng.normal(0, 0.1, (1 << BUCKET_BITS, EMBEDDING)).astype(np.float32), rng.normal(0, 0.3, (EMBEDDING, 2)), np.zeros(2)
    )
    first = np.flatnonzero(np.diff(bags.texts, prepend=-1))  # the first window of each text with words
    labels = toxic[bags.texts[first]].astype(np.float64)
    window_ends = np.append(first, len(bags.texts))
    gram_ends = np.append(bags.starts, len(bags.grams))
    values = [net.embedding, net.dense, net.offset]
    means, squares = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    cuts = np.linspace(0, len(first), BATCHES + 1).astype(int)
    parts = [(a, b) for a, b in zip(cuts, cuts[1:]) if b > a]
    step = 0
    for epoch in range(epochs):
        for a, b in parts:
            step += 1
            low, high = window_ends[a], window_ends[b]
            base = gram_ends[low]
            part = Bags(bags.grams[base : gram_ends[high]], bags.starts[low:high] - base, bags.texts[low:high])
            odds = window_odds(part, net.evidence(), net.bias)
            begins = window_ends[a:b] - low
            per_text = np.diff(np.append(begins, high - low))
            if epoch < epochs // 4:
                error = (1 / (1 + np.exp(-odds)) - np.repeat(labels[a:b], per_text)) / np.repeat(per_text, per_text)
            else:
                top = np.maximum.reduceat(odds, begins)
                best = np.flatnonzero(odds == np.repeat(top, per_text))
                best = best[np.unique(part.texts[best], return_index=True)[1]]
                error = np.zeros(len(odds))
                error[best] = 1 / (1 + np.exp(-top)) - labels[a:b]
            error /= b - a
            sizes = np.diff(part.starts, append=len(part.grams))
            weights = np.repeat(error / np.maximum(sizes, 1), sizes)
            pull = np.bincount(part.grams, weights, 1 << BUCKET_BITS).astype(np.float32)
            direction = (net.dense[:, 1] - net.dense[:, 0]).astype(np.float32)
            back = net.embedding.T @ pull
            grads = [pull[:, None] * direction, np.stack([-back, back], axis=1), np.array([-error.sum(), error.sum()])]
            rate = 0.05 * min(1.0, 2 * (1 - step / (epochs * len(parts) + 1)))
            for value, grad, m, v in zip(values, grads, means, squares):
                m += 0.1 * (grad - m)
                v += 0.01 * (grad * grad - v)
                value -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return net


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def fit(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "toxic",
    per_label: int = SAMPLE_PER_LABEL,
    max_bytes: int = SAMPLE_BYTES,
) -> SubwordSoftmax | None:
    """Train on a bounded sample: of each label about ``per_label`` documents of at most ``max_bytes``, chosen by a
    hash of their ids. Held-out documents are never read for it; documents with contradictory labels count
    as label 1. None unless both labels occur."""
    rated = (
        labels.select(F.col(id_column).alias("doc_id"), F.col(label_column).cast("int").alias("toxic"))
        .filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    counts = {r["toxic"]: r["count"] for r in rated.groupBy("toxic").count().collect()}
    if len(counts) < 2:
        return None
    share = F.when(F.col("toxic") == 1, min(1.0, per_label / counts[1])).otherwise(min(1.0, per_label / counts[0]))
    chosen = rated.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < share * 1_000_003)
    # at most about twice per_label ids and labels
    texts = two_columns(docs, id_column, text_column).filter(F.octet_length("text") <= max_bytes)
    rows = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic").collect()
    rows.sort(key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), r["text"]))  # mixed, and the same each time
    toxic = np.array([r["toxic"] for r in rows], np.int64)
    if len(set(toxic.tolist())) < 2:
        return None
    texts = [r["text"].encode() for r in rows]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    return train(np.frombuffer(b"".join(texts), np.uint8), offsets, toxic)


def score(
    docs: DataFrame,
    net: SubwordSoftmax | None,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    The score is the softmax of the text's most toxic window; a null text, one without words, and every
    text when nothing could be learned, scores 0. Repeated rows are each scored; an empty table gives
    no rows; further columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(None if net is None else (net.evidence(), net.bias))
    rows = two_columns(docs, id_column, text_column)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, "doc_id", "text"):
            values = np.zeros(len(block))
            if sent.value is not None:
                evidence, bias = sent.value
                bags = subword_bags(block.data, block.offsets)
                if len(bags.texts):
                    first = np.flatnonzero(np.diff(bags.texts, prepend=-1))
                    top = np.maximum.reduceat(window_odds(bags, evidence, bias), first)
                    values[bags.texts[first]] = 1 / (1 + np.exp(-np.clip(top, -500, 500)))
            yield pa.RecordBatch.from_arrays([block.ids, pa.array(values)], names=["doc_id", "score"])

    found = rows.mapInArrow(scan, f"doc_id {kind}, score double")
    return found.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
