"""Sum-of-squares packing of documents into token sequences of fixed capacity."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.batches import giving_back, text_blocks, two_columns, use_shared_folder
from corpusloom.llm.tokenize import KEPT, word_tokens

TOKENIZER = "word_bpe_49k.json"
CAPACITY = 4096
END_ID = 1
#: Pieces packed by one task. Each group leaves about one partly filled sequence in a hundred groups' worth.
GROUP_PIECES = 8192

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PACKED = f"{_PIECES}, sequence_id long, offset long"


def token_pieces(
    docs: DataFrame,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    tokenizer: str = TOKENIZER,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
) -> DataFrame:
    """Pieces of at most ``capacity`` tokens: (doc_id, piece, start, length, ids_crc32).

    A document's ids are those of its whole text, then ``end_id``; a null or empty text has ``end_id``
    alone. Only documents longer than the capacity are cut, and only the last piece is shorter.
    """
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = word_tokens(tokenizer)
        for block in text_blocks(batches, "doc_id", "text"):
            rows = []
            for row, doc in enumerate(block.ids.to_pylist()):
                ids = tokens.ids(block.text(row)) + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*rows))
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return two_columns(docs, id_column, text_column).mapInArrow(giving_back(cut, KEPT), _PIECES)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of each item, in the order given.

    An item goes where the sum of the squared counts of open bins per residual gap becomes smallest;
    ``gain`` is what the sum falls by, for each gap that holds the item and for a new bin. Full bins
    are closed and count nowhere. Ties take the smallest gap.
    """
    open_bins = np.zeros(capacity + 1, np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins = np.empty(len(lengths), np.int64)
    offsets = np.empty(len(lengths), np.int64)
    none = np.iinfo(np.int64).min
    made = 0
    for i, size in enumerate(lengths.tolist()):
        holds = open_bins[size:]
        gain = np.where(holds > 0, 2 * (holds - open_bins[: capacity + 1 - size]) - 2, none)
        if holds[0]:
            gain[0] = 2 * holds[0] - 1  # the bin is closed
        gain[-1] = -2 * open_bins[capacity - size] - 1  # a new bin
        gap = size + int(gain.argmax())
        if gap == capacity:
            number = made
            made += 1
        else:
            number = stacks[gap].pop()
            open_bins[gap] -= 1
        left = gap - size
        if left:
            stacks[left].append(number)
            open_bins[left] += 1
        bins[i] = number
        offsets[i] = capacity - gap
    return bins, offsets


def pack(pieces: DataFrame, groups: int, capacity: int = CAPACITY) -> DataFrame:
    """Give every piece a sequence and an offset in it.

    Pieces, of which the table must be a checkpoint, are dealt by their place in it into ``groups`` equal groups, whatever
    ids they have, each packed by one task; inside a group the longest come first, so short ones fill what they leave. Sequence numbers
    are unique across groups, not consecutive.
    """

    def place(key, rows):
        rows = rows.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], na_position="last")
        bins, offsets = sum_of_squares(rows["length"].to_numpy(), capacity)
        rows["sequence_id"] = bins * groups + key[0]
        rows["offset"] = offsets
        return rows[["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    dealt = pieces.withColumn("group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    return dealt.groupBy("group").applyInPandas(place, _PACKED)


def pack_documents(
    docs: DataFrame,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    tokenizer: str = TOKENIZER,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    group_pieces: int = GROUP_PIECES,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Tokenising and packing meet in one shuffle of 40-byte rows, which are checkpointed to be counted. Null or
    empty texts are packed as their end token; rows with the same id or text are packed each for itself; an
    empty table gives no rows; further columns are not read.
    """
    use_shared_folder(docs.sparkSession)
    pieces = token_pieces(
        docs,
        id_column=id_column,
        text_column=text_column,
        tokenizer=tokenizer,
        capacity=capacity,
        end_id=end_id,
    ).checkpoint()
    groups = max(1, -(-pieces.count() // group_pieces))
    return pack(pieces, groups, capacity)
