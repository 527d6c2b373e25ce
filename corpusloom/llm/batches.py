"""Arrow batches of texts as byte arrays, cut into blocks of bounded size."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_BYTES = 2 << 20


class TextBlock:
    """Whole rows of a batch: their ids, and their texts as one byte array with offsets."""

    def __init__(self, ids: pa.Array, data: np.ndarray, offsets: np.ndarray):
        self.ids = ids
        self.data = data
        self.offsets = offsets

    def __len__(self) -> int:
        return len(self.offsets) - 1

    @property
    def lengths(self) -> np.ndarray:
        return np.diff(self.offsets)

    def text(self, row: int) -> bytes:
        return self.data[self.offsets[row] : self.offsets[row + 1]].tobytes()


def byte_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string()).cast(pa.large_binary())
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    start, end = int(offsets[0]), int(offsets[-1])
    raw = np.frombuffer(data, np.uint8)[start:end] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - start


def text_blocks(
    batches: Iterable[pa.RecordBatch], id_column: str, text_column: str, limit: int = BLOCK_BYTES
) -> Iterator[TextBlock]:
    """Blocks of whole texts of about ``limit`` bytes; a longer text is a block of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column(batch.schema.get_field_index(id_column))
        data, offsets = byte_column(batch.column(batch.schema.get_field_index(text_column)))
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
            last = min(max(last, first + 1), batch.num_rows)
            cut = offsets[first : last + 1]
            yield TextBlock(ids[first:last], data[cut[0] : cut[-1]], cut - cut[0])
            first = last


def unused(docs: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``docs`` does not have, whatever the case of its letters."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def apart(docs: DataFrame, text_column: str = "text") -> tuple[DataFrame, Callable[..., DataFrame]]:
    """(others, text) of ``docs``, so that columns an operator adds meet no other names, and the way back to its columns."""
    others = [c for c in docs.columns if c != text_column]
    fields = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)]
    packed = docs.select(F.struct(F.lit(0).alias("none"), *fields).alias("others"), F.col(f"`{text_column}`").alias("text"))

    def back(found: DataFrame, **missing: Column) -> DataFrame:
        """``missing`` has, by column, what stands where ``docs`` has a null."""
        places = {c: F.col("others")[f"c{i}"] for i, c in enumerate(others)} | {text_column: F.col("text")}
        places |= {c: F.coalesce(places[c], value) for c, value in missing.items()}
        return found.select(*[places[c].alias(c) for c in docs.columns])

    return packed, back


def two_columns(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Only what an operator reads, so that the scan is pruned and other columns cannot clash."""
    return docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))


def use_shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session; one of this machine only for a local session without one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="checkpoint-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def release(spark: SparkSession) -> None:
    """Give back the disk of steps whose tables are checkpointed by now. Spark deletes their shuffle files once the
    driver's garbage is collected, which a driver with little to do may put off for the whole run."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: What operators keep in a Python worker from task to task.
_KEPT: dict[str, object] = {}


def keep(name: str, make: Callable[[], object]) -> object:
    """What ``make`` gave in this worker, until a task of an operator that does not use it runs here."""
    if name not in _KEPT:
        _KEPT[name] = make()
    return _KEPT[name]


def giving_back(scan: Callable[[Iterable], Iterator], uses: str | None = None) -> Callable[[Iterable], Iterator]:
    """``scan`` for tasks whose worker lives on and shares its executor's memory: what other operators than ``uses`` have
    kept goes first, and memory that is free at the end goes back to the machine."""

    def run(batches: Iterable) -> Iterator:
        forget(uses)
        try:
            yield from scan(batches)
        finally:
            give_back()

    return run


def forget(uses: str | None) -> None:
    """Drop what is kept in this worker but ``uses``. A function of the module, as what is nested in ``giving_back`` is sent
    to the workers with a copy of the names it reads."""
    others = [name for name in _KEPT if name != uses]
    for name in others:
        del _KEPT[name]
    if others:
        give_back()


def give_back() -> None:
    """Memory that is free in this worker goes back to the machine."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library is another
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def one_thread() -> None:
    """Native libraries of a Python worker keep to the core of their task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
