"""Quality rules on repetition: base counts, and repeated substrings from a suffix array over words."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.batches import TextBlock, text_blocks, two_columns
from corpusloom.llm.suffix import permuted_common_prefixes, suffix_array
from corpusloom.llm.words import hash_spans, hash_windows, word_spans

#: A repeated substring counts towards the covered share from so many words on.
MIN_REPEAT_WORDS = 8
MAX_COVERED_PERCENT = 30
MAX_LONGEST_WORDS = 100

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered_words", "longest_repeat")


def repeated_runs(hashes: np.ndarray, texts: np.ndarray, size: int = 3) -> np.ndarray:
    """Which words lie in a window of ``size`` words that is found twice or more in their text."""
    marked = np.zeros(len(hashes), bool)
    if len(hashes) < size:
        return marked
    inside = texts[size - 1 :] == texts[: len(texts) - size + 1]
    at = np.flatnonzero(inside)
    keys = hash_windows(hashes, size)[at]
    order = np.lexsort((keys, texts[at]))
    same = (keys[order[1:]] == keys[order[:-1]]) & (texts[at[order[1:]]] == texts[at[order[:-1]]])
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    for k in range(size):
        marked[at[twice] + k] = True
    return marked


def longest_repeats(hashes: np.ndarray, texts: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """For each word, the length in words of the longest substring of its text that starts there and occurs again.

    One suffix array over all candidate runs of a block. Words are numbered per text and every run ends in
    a number of its own, so that no common prefix crosses texts or runs. A suffix's longest repeat is the
    larger of the common prefixes with its two neighbours: the innermost interval that holds it.
    """
    found = np.zeros(len(hashes), np.int64)
    at = np.flatnonzero(candidates)
    if not len(at):
        return found
    breaks = np.flatnonzero((np.diff(at) > 1) | (np.diff(texts[at]) > 0)) + 1
    runs = len(breaks) + 1
    _, numbers = np.unique(np.rec.fromarrays([texts[at], hashes[at]]), return_inverse=True)
    symbols = np.insert(numbers.ravel() + runs + 1, np.append(breaks, len(at)), np.arange(1, runs + 1))
    symbols = np.append(symbols, 0)
    order = suffix_array(symbols)
    shared = permuted_common_prefixes(symbols, order)[order]
    longest = np.empty(len(symbols), np.int64)
    longest[order] = np.maximum(shared, np.append(shared[1:], 0))
    found[at] = longest[symbols > runs]
    return found


def _duplicate_lines(text: bytes) -> int:
    lines = [line for line in text.split(b"\n") if line.strip()]
    return len(lines) - len(set(lines))


def count_block(block: TextBlock, min_repeat: int) -> dict[str, np.ndarray]:
    rows = len(block)
    starts, ends, texts = word_spans(block.data, block.offsets)
    hashes = hash_spans(block.data, starts, ends)
    repeated = repeated_runs(hashes, texts)
    longest = longest_repeats(hashes, texts, repeated)
    # a span opened at each word whose repeat is long enough
    opened = np.flatnonzero(longest >= min_repeat)
    edges = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(edges, opened, 1)
    np.add.at(edges, opened + longest[opened], -1)
    covered = np.cumsum(edges[:-1]) > 0

    def per_text(values: np.ndarray) -> np.ndarray:
        return np.bincount(texts, values, rows).astype(np.int64)

    points = np.concatenate([[0], np.cumsum((block.data & 0xC0) != 0x80)])
    symbols = np.concatenate([[0], np.cumsum(_SYMBOLS[block.data])])[block.offsets]
    most = np.zeros(rows, np.int64)
    np.maximum.at(most, texts, longest)
    return {
        "n_words": np.bincount(texts, minlength=rows),
        "word_chars": per_text(points[ends] - points[starts]),
        "n_symbols": np.diff(symbols),
        "n_dup_lines": np.array([_duplicate_lines(block.text(r)) for r in range(rows)], np.int64),
        "n_repeat_words": per_text(repeated),
        "n_covered_words": per_text(covered),
        "longest_repeat": most,
    }


def repetition_rules(
    docs: DataFrame,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    min_repeat: int = MIN_REPEAT_WORDS,
    max_covered_percent: int = MAX_COVERED_PERCENT,
    max_longest: int = MAX_LONGEST_WORDS,
) -> DataFrame:
    """One row per document: doc_id, the counts, base_failed, kept, n_covered_words, longest_repeat.

    Words are runs of bytes other than ASCII white space. The base rule fails texts of under 50 words or with
    more than half of their words in repeated 3-word windows. A text that passes is kept unless repeated
    substrings of ``min_repeat`` words or more cover over ``max_covered_percent`` of its words, or its
    longest one exceeds ``max_longest`` words (occurrences may overlap). A null or empty text has zero
    counts and fails; repeated rows are each judged; an empty table gives no rows; further columns are
    not read. Every text is judged inside its own row: nothing is shuffled. ``min_repeat`` is at least 3.
    """
    if min_repeat < 3:
        raise ValueError("min_repeat must be at least 3")
    rows = two_columns(docs, id_column, text_column)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, "doc_id", "text"):
            counts = count_block(block, min_repeat)
            yield pa.RecordBatch.from_arrays(
                [block.ids, *(pa.array(counts[c], pa.int64()) for c in _COUNTS)], names=["doc_id", *_COUNTS]
            )

    found = rows.mapInArrow(scan, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in _COUNTS))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    passes = (100 * F.col("n_covered_words") <= max_covered_percent * F.col("n_words")) & (F.col("longest_repeat") <= max_longest)
    return found.select(
        "doc_id",
        *_COUNTS[:5],
        failed.alias("base_failed"),
        (~failed & passes).alias("kept"),
        *_COUNTS[5:],
    )
