"""Language identification with a byte convolutional network."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.batches import giving_back, text_blocks, two_columns, unused

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 8
EMBEDDING = 8
#: At most about so many labelled documents of a language are read to fit the network, one window of each.
SAMPLE_PER_LANGUAGE = 3000
STEPS = 400
BATCH = 128
UNKNOWN = "und"
#: Fewer labelled windows are too few to tell what is none of their languages.
LEAST_WINDOWS = 100
#: First letters of some scripts, and what texts without words are made of.
SCRIPTS = (0x391, 0x410, 0x531, 0x5D0, 0x621, 0x905, 0x995, 0xE01, 0x10D0, 0x1200, 0x3041, 0x30A1, 0x4E00, 0xAC00)
SYMBOLS = (b"0123456789abcdef", b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", bytes(range(33, 127)))
#: Texts whose windows are cut at a time.
BLOCK_BYTES = 1 << 20


@dataclass
class ByteNetwork:
    """Byte embeddings, filters of several widths over them, their largest value in a window, softmax. A class without a
    name is that of no language; ``sample`` are the windows and labels of the fit."""

    languages: list[str | None]
    embedding: np.ndarray
    filters: list[np.ndarray]  # one (width, embedding, filters) each
    bias: np.ndarray
    dense: np.ndarray
    offset: np.ndarray
    sample: tuple[np.ndarray, np.ndarray] | None = None

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """What two bytes add to every filter as its first two bytes, and as its third and fourth."""
        parts = [np.einsum("be,wef->wbf", self.embedding, f) for f in self.filters]
        pair = [p[0][:, None, :] + p[1][None, :, :] for p in parts]
        first = np.concatenate(pair, axis=2).reshape(65536, -1) + self.bias
        none = np.zeros((256, 256, FILTERS), np.float32)
        later = [none + p[2][:, None, :] + (p[3][None, :, :] if len(p) > 3 else 0) for p in parts if len(p) > 2]
        return first.astype(np.float32), np.concatenate(later, axis=2).reshape(65536, -1).astype(np.float32)

    def probabilities(self, windows: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        first, later = tables
        pooled = np.empty((len(windows), first.shape[1]), np.float32)
        for at in range(0, len(windows), 64):
            rows = windows[at : at + 64].astype(np.int32)
            codes = rows[:, :-1] * 256 + rows[:, 1:]
            values = first[codes[:, :-2]]
            values[:, :, FILTERS:] += later[codes[:, 2:]]
            values.max(axis=1, out=pooled[at : at + 64])
        return _softmax(np.maximum(pooled, 0) @ self.dense + self.offset)


def _softmax(scores: np.ndarray) -> np.ndarray:
    powers = np.exp(scores - scores.max(axis=1, keepdims=True))
    return powers / powers.sum(axis=1, keepdims=True)


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str | None], steps: int = STEPS, seed: int = 7) -> ByteNetwork:
    """Fit all weights together with Adam on the cross entropy. Windows are cut to random lengths for short texts."""
    rng = np.random.default_rng(seed)
    net = ByteNetwork(
        languages,
        rng.normal(0, 0.5, (256, EMBEDDING)),
        [rng.normal(0, (2 / (w * EMBEDDING)) ** 0.5, (w, EMBEDDING, FILTERS)) for w in WIDTHS],
        np.zeros(len(WIDTHS) * FILTERS),
        rng.normal(0, 0.2, (len(WIDTHS) * FILTERS, len(languages))),
        np.zeros(len(languages)),
    )
    values = [net.embedding, *net.filters, net.bias, net.dense, net.offset]
    first, second = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    places = windows.shape[1] - max(WIDTHS) + 1
    for step in range(1, steps + 1):
        pick = rng.integers(0, len(windows), BATCH)
        rows = windows[pick].astype(np.int64)
        cut = np.where(rng.random(BATCH) < 0.5, windows.shape[1], rng.integers(12, windows.shape[1], BATCH))
        rows[np.arange(windows.shape[1]) >= cut[:, None]] = 0
        vectors = net.embedding[rows]
        pooled, at = [], []
        for width, f in zip(WIDTHS, net.filters):
            found = sum(vectors[:, k : k + places] @ f[k] for k in range(width))
            at.append(found.argmax(axis=1))
            pooled.append(np.take_along_axis(found, at[-1][:, None, :], 1)[:, 0])
        hidden = np.concatenate(pooled, axis=1) + net.bias
        active = np.maximum(hidden, 0)
        error = _softmax(active @ net.dense + net.offset)
        error[np.arange(BATCH), labels[pick]] -= 1
        error /= BATCH
        back = (error @ net.dense.T) * (hidden > 0)
        grads = [np.zeros_like(net.embedding)]
        for i, (width, f) in enumerate(zip(WIDTHS, net.filters)):
            own = back[:, i * FILTERS : (i + 1) * FILTERS]
            grad = np.zeros_like(f)
            for k in range(width):
                bytes_at = np.take_along_axis(rows, at[i] + k, 1)
                grad[k] = np.einsum("bfe,bf->ef", net.embedding[bytes_at], own)
                np.add.at(grads[0], bytes_at.ravel(), (own[:, :, None] * f[k].T[None]).reshape(-1, EMBEDDING))
            grads.append(grad)
        grads += [back.sum(axis=0), active.T @ error, error.sum(axis=0)]
        rate = 0.02 * min(1.0, 2 * (1 - step / (steps + 1)))
        for value, grad, m, v in zip(values, grads, first, second):
            m += 0.1 * (grad - m)
            v += 0.001 * (grad * grad - v)
            value -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def cut_windows(data: np.ndarray, offsets: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Windows of ``size`` bytes over every whole text, and the row of each. The last window of a text ends
    with it; a shorter text is filled up with zeros; an empty one has one window of zeros."""
    lengths = np.diff(offsets)
    counts = np.maximum(1, -(-lengths // size))
    rows = np.repeat(np.arange(len(lengths)), counts)
    number = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = np.maximum(0, np.minimum(number * size, lengths[rows] - size))
    inside = starts[:, None] + np.arange(size)
    windows = np.concatenate([data, np.zeros(1, np.uint8)])[
        np.where(inside < lengths[rows][:, None], offsets[:-1][rows][:, None] + inside, len(data))
    ]
    return windows, rows


def no_language(windows: np.ndarray, seed: int = 11) -> np.ndarray:
    """Counter-examples of windows: their letters exchanged by one key or each for itself, or written in letters of another
    script, or runs of symbols of their length."""
    rng = np.random.default_rng(seed)
    lower = np.arange(256)
    lower[65:91] += 32
    found = np.zeros_like(windows)
    for i, window in enumerate(windows):
        data = lower[window[: np.count_nonzero(window)]]
        letter = (data >= 97) & (data <= 122) | (data >= 128)
        kind = rng.integers(4)
        if kind == 0:
            key = np.concatenate([np.arange(97), 97 + rng.permutation(26), np.arange(123, 128), 97 + rng.integers(0, 26, 128)])
            text = np.where(letter, key[data], data)
        elif kind == 1:
            text = np.where(letter, 97 + rng.integers(0, 26, len(data)), data)
        elif kind == 2:
            key = rng.choice(SCRIPTS) + rng.integers(0, rng.integers(6, 60), 256)
            text = np.frombuffer("".join(map(chr, np.where(letter, key[data], data))).encode(), np.uint8)[: windows.shape[1]]
        else:
            symbols = np.frombuffer(SYMBOLS[rng.integers(len(SYMBOLS))], np.uint8)
            text = symbols[rng.integers(0, len(symbols), len(data))]
        found[i, : len(text)] = text
    return found


def with_no_language(net: ByteNetwork | None) -> ByteNetwork | None:
    """The network trained anew on its sample with a class for what is none of its languages, as large as that of each;
    the same network where the sample has too few windows to tell."""
    if net is None or net.sample is None or len(net.sample[0]) < LEAST_WINDOWS:
        return net
    windows, labels = net.sample
    even = _evenly(labels, len(net.languages))
    some = np.random.default_rng(5).permutation(even)[: max(LEAST_WINDOWS, len(even) // len(net.languages))]
    others = no_language(windows[some])
    windows, labels = np.concatenate([windows, others]), np.append(labels, np.full(len(others), len(net.languages)))
    languages = [*net.languages, None]
    even = _evenly(labels, len(languages))
    return train(windows[even], labels[even], languages)


def _evenly(labels: np.ndarray, count: int) -> np.ndarray:
    """Places of the labels, each label's repeated to the number of the commonest."""
    order = np.argsort(labels, kind="stable")
    sizes = np.bincount(labels, minlength=count)
    return np.concatenate([np.resize(part, int(sizes.max())) for part in np.split(order, np.cumsum(sizes)[:-1]) if len(part)])


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def fit(
    docs: DataFrame,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    lang_column: str = "lang",
    per_language: int = SAMPLE_PER_LANGUAGE,
) -> ByteNetwork | None:
    """Train on a bounded sample: of each language about ``per_language`` labelled documents chosen by a hash of
    their ids, one window from a place the hash chooses. Held-out documents are never read for it. None
    if there is nothing to learn from."""
    labelled = docs.select(
        F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"), F.col(lang_column).alias("lang")
    ).filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out(F.col("doc_id")))
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not counts:
        return None
    dice = F.xxhash64("doc_id")
    share = F.element_at(F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, per_language / n))]), F.col("lang"))
    spare = F.greatest(F.lit(1), F.length("text") - WINDOW)
    sample = labelled.filter(F.pmod(dice, F.lit(1_000_003)) < share * 1_000_003).select(
        "doc_id", "lang", F.substring("text", F.pmod(F.xxhash64("doc_id", F.lit(1)), spare).cast("int") + 1, F.lit(WINDOW)).alias("text")
    )
    rows = sorted(sample.collect(), key=lambda r: str(r["doc_id"]))
    languages = sorted(counts)
    windows = np.zeros((len(rows), WINDOW), np.uint8)
    for i, row in enumerate(rows):
        cut = row["text"].encode()[:WINDOW]
        windows[i, : len(cut)] = np.frombuffer(cut, np.uint8)
    labels = np.array([languages.index(r["lang"]) for r in rows], np.int64)
    even = _evenly(labels, len(languages))
    return replace(train(windows[even], labels[even], languages), sample=(windows, labels))


def classify(docs: DataFrame, net: ByteNetwork | None, *, text_column: str = "text") -> DataFrame:
    """``docs`` with all its columns, and ``_lang_pred`` and ``_lang_score``, names it must not have; see ``identify``. A text
    that a network ``with_no_language`` finds to have none has a null ``_lang_pred``."""
    sent = docs.sparkSession.sparkContext.broadcast(net and replace(net, sample=None))
    letters = F.coalesce(F.col(text_column).cast("string").rlike(r"\p{L}"), F.lit(False)) & F.lit(net is not None)
    kept = len(docs.columns)
    own_text, rows = text_column, docs
    if dict(docs.dtypes).get(text_column) != "string":  # a text that is one already travels once
        own_text = unused(docs, "_text")
        rows = docs.withColumn(own_text, F.col(text_column).cast("string"))
    rows = rows.select("*", letters.alias(unused(docs, "_letters")))

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = sent.value
        tables = net.tables() if net else None
        for batch in batches:
            has_letters = np.asarray(batch.column(batch.num_columns - 1).to_pylist(), bool)
            at = 0
            for block in text_blocks([batch], own_text, own_text, BLOCK_BYTES):
                own = has_letters[at : at + len(block)]
                names, score = np.full(len(block), UNKNOWN, object), np.zeros(len(block))
                if net and own.any():
                    windows, row = cut_windows(block.data, block.offsets)
                    logs = np.log(net.probabilities(windows, tables) + 1e-9)
                    starts = np.searchsorted(row, np.arange(len(block)))
                    share = _softmax(np.add.reduceat(logs, starts) / np.bincount(row)[:, None])
                    names[own] = np.array(net.languages, object)[share.argmax(axis=1)[own]]
                    score[own] = share.max(axis=1)[own]
                columns = batch.slice(at, len(block)).columns[:kept]
                at += len(block)
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(names, pa.string()), pa.array(score, pa.float64())],
                    names=[*batch.schema.names[:kept], "_lang_pred", "_lang_score"],
                )

    schema = T.StructType([*docs.schema.fields, T.StructField("_lang_pred", T.StringType()), T.StructField("_lang_score", T.DoubleType())])
    return rows.mapInArrow(giving_back(scan), schema)


def identify(
    docs: DataFrame, net: ByteNetwork | None, *, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    Every window of a text is classified; the text takes the language of the largest mean log
    probability, and the score is that language's share. A null text, one without a letter, and every
    text when nothing could be learned, is ``und`` with score 0. Repeated rows are each answered;
    an empty table gives no rows; further columns are not read.
    """
    found = classify(two_columns(docs, id_column, text_column), net)
    return found.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_lang_pred").alias("lang_pred"), F.col("_lang_score").alias("score")
    )
