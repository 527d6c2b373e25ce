"""Partial top-k over score blocks inside Arrow tasks, shared by the two retrievers.

A task scores one Arrow batch against all its queries as a matrix and passes on, per batch and
query, at most ``k`` rows, and none below the task's running cut. What leaves a task therefore does
not grow with its documents, however many of them are copies of each other.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from corpusloom.operators.ranking import ORDER_DIGITS

MAX_CELLS = 4_000_000


def id_array(values: Sequence, data_type: T.DataType) -> pa.Array:
    return pa.array(values, to_arrow_type(data_type))


def by_namespace(batch: pa.RecordBatch, known, width: int) -> Iterator[tuple[str, pa.Table]]:
    """Parts of a batch with one namespace each, in id order, with rows x width in bounds."""
    keys = [("namespace", "ascending"), ("doc_id", "ascending")]
    table = pa.Table.from_batches([batch])
    table = table.take(pc.sort_indices(table, sort_keys=keys))
    runs = pc.run_end_encode(table.column("namespace").combine_chunks())
    step = max(1, MAX_CELLS // max(1, width))
    start = 0
    for namespace, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist(), strict=True):
        if namespace in known:
            for at in range(start, end, step):
                yield namespace, table.slice(at, min(step, end - at)).combine_chunks()
        start = end


def cuts(sizes: np.ndarray, bound: int) -> list[tuple[int, int]]:
    """Ranges of neighbouring items, begin and end, of at most ``bound`` in all; a larger item is a range of its own."""
    ends = np.cumsum(sizes)
    ranges, at = [], 0
    while at < len(sizes):
        before = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, before + bound, side="right")))
        ranges.append((at, end))
        at = end
    return ranges


def whole_runs(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of sorted rows with the starts of their runs of equal keys, none of which is cut between two tables."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        table = table.combine_chunks()
        starts = _run_starts(table, keys)
        last = starts[-1] if len(starts) else 0
        held = table.slice(last)
        if last:
            yield table.slice(0, last), starts[:-1]
    if held is not None and held.num_rows:
        yield held, np.zeros(1, np.int64)


def _run_starts(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    if not table.num_rows:
        return np.zeros(0, np.int64)
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for key in keys:
        column = table.column(key)
        differs = pc.not_equal(column.slice(1), column.slice(0, table.num_rows - 1))
        new[1:] |= differs.to_numpy(zero_copy_only=False) if isinstance(differs, pa.Array) else differs.to_numpy()
    return np.flatnonzero(new)


class PartialTopK:
    """Running cut-offs of one task: a score below the current k-th best is not passed on."""

    def __init__(self, query_ids: pa.Array, k: int) -> None:
        self._query_ids = query_ids
        self._k = k
        self._floors: dict[str, np.ndarray] = {}

    def _first_k(self, rounded: np.ndarray, floors: np.ndarray) -> np.ndarray:
        """Mask of at most ``k`` rows per column: highest scores, then first rows (smallest ids)."""
        if len(rounded) <= self._k:
            return rounded >= floors
        cut = np.partition(rounded, len(rounded) - self._k, axis=0)[len(rounded) - self._k]
        kept = rounded >= np.maximum(cut, floors)
        crowded = np.flatnonzero(kept.sum(axis=0) > self._k)
        if len(crowded):
            above = rounded[:, crowded] > cut[crowded]
            tied = rounded[:, crowded] == cut[crowded]
            room = self._k - above.sum(axis=0)
            kept[:, crowded] = above | (tied & (np.cumsum(tied, axis=0) <= room))
        np.maximum(floors, cut, out=floors)
        return kept

    def kept(self, namespace: str, slots: np.ndarray, scores: np.ndarray, positive_only: bool = False) -> np.ndarray:
        """Mask of the surviving cells of a (rows in their order x slots) block."""
        floors = self._floors.setdefault(namespace, np.full(len(slots), -np.inf))
        kept = self._first_k(np.floor(scores * float(10**ORDER_DIGITS) + 0.5), floors)
        return kept & (scores > 0) if positive_only else kept

    def rows(
        self,
        namespace: str,
        slots: np.ndarray,
        doc_ids: pa.Array,
        scores: np.ndarray,
        positive_only: bool = False,
    ) -> pa.RecordBatch:
        """Surviving cells of a (documents in id order x slots) block."""
        docs, columns = np.nonzero(self.kept(namespace, slots, scores, positive_only))
        return pa.RecordBatch.from_arrays(
            [
                self._query_ids.take(pa.array(slots[columns])),
                pa.array(np.full(len(docs), namespace, dtype=object), pa.string()),
                doc_ids.take(pa.array(docs)),
                pa.array(scores[docs, columns]),
            ],
            names=["query_id", "namespace", "doc_id", "score"],
        )
