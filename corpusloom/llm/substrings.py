"""Removal of byte strings that occur twice or more, with suffix arrays by induced sorting per shard.

Every window of ``width`` bytes has an anchor: the leftmost of its smallest hashed ``anchor``-byte strings.
Equal windows have equal anchors at equal offsets, so windows are looked for only among those with the
same anchor. Neighbouring windows with one anchor form a segment. Segments whose anchor occurs once are
settled; equal segments are counted before they move; the different segments of an anchor meet in a task,
which leaves out windows whose core, the bytes shared by all windows at like distances from the anchor, no other
segment has. The rest fills shards, whose suffix arrays and permuted common prefixes tell which windows occur elsewhere.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.batches import TextBlock, byte_column, release, text_blocks, use_shared_folder
from corpusloom.llm.suffix import permuted_common_prefixes, suffix_array
from corpusloom.llm.words import _multipliers, mix

WIDTH = 400
ANCHOR = 32
#: Bytes of one shard's suffix array.
SHARD_BYTES = 1 << 20
#: Texts that are hashed at a time; a longer one is a block of its own.
BLOCK_BYTES = 1 << 20
#: An anchor with more different segments is settled by halves instead of in one shard.
MAX_SEGMENTS = 1024
#: Ranges of distances from the anchor, each with a core of its own.
RANGES = 16

_STEP = np.uint64(0x9E3779B97F4A7C15)


def string_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of the ``size`` bytes from each place on; ``size`` is a multiple of 8."""
    count = len(data) - size + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    data = np.ascontiguousarray(data)
    total = np.zeros(count, np.uint64)
    for k, weight in enumerate(_multipliers(size // 8)):
        eight = np.ndarray((count,), "<u8", data.data, 8 * k, (1,))
        total += mix(eight * weight)
    return mix(total)


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` neighbouring values, from minima from both ends of fixed blocks."""
    count = len(values) - width + 1
    if count <= 0:
        return values[:0]
    padded = np.full(-(-len(values) // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:count], before[width - 1 : width - 1 + count])


def leftmost_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Where the first of the smallest values of each ``width`` neighbours lies, whole values compared.

    Value and place share one number, in which the value's last bits give way to the place, as many as the array
    is long. Where two smallest values differ in those bits only, the place is looked up again, so that equal windows have
    equal answers in arrays of any length.
    """
    bits = np.uint64(max(1, len(values).bit_length()))
    places = np.arange(len(values), dtype=np.uint64)
    found = sliding_minimum((values >> bits << bits) | places, width)
    at = (found & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    for i in np.flatnonzero(values[at] != sliding_minimum(values, width)).tolist():
        at[i] = i + int(values[i : i + width].argmin())
    return at


def _prefix_sums(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of hashes weighted by powers of an odd number, and the inverse powers."""
    powers = np.full(len(hashes) + 1, _STEP)
    powers[0] = 1
    inverse = np.full(len(hashes) + 1, np.uint64(pow(int(_STEP), -1, 1 << 64)))
    inverse[0] = 1
    np.multiply.accumulate(powers, out=powers)
    np.multiply.accumulate(inverse, out=inverse)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * powers[:-1], out=sums[1:])
    return sums, inverse


def segments(block: TextBlock, width: int, anchor: int) -> dict[str, np.ndarray]:
    """All segments of a block: row, anchor and segment hashes, first and last window start in the text, and the place
    of the anchor behind the first."""
    hashes = string_hashes(block.data, anchor)
    empty = {k: np.zeros(0, np.int64) for k in ("row", "anchor", "segment", "first", "last", "place")}
    if len(block.data) < width:
        return empty
    at = leftmost_minima(hashes, width - anchor + 1)
    row = np.repeat(np.arange(len(block)), block.lengths)[: len(at)]
    inside = np.arange(len(at)) + width <= block.offsets[1:][row]
    start = np.flatnonzero(inside)
    if not len(start):
        return empty
    at, row = at[start], row[start]
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (row[1:] != row[:-1])]))
    first, last = start[new], start[np.append(new[1:], len(start)) - 1]
    sums, inverse = _prefix_sums(hashes)
    ends = last + width - anchor + 1
    content = mix(((sums[ends] - sums[first]) * inverse[first]) ^ (last - first).astype(np.uint64) * _STEP)
    row = row[new]
    begins = block.offsets[:-1][row]
    return {
        "row": row,
        "anchor": hashes[at[new]].view(np.int64),
        "segment": content.view(np.int64),
        "first": first - begins,
        "last": last - begins,
        "place": at[new] - first,
    }


def _all_segments(docs: DataFrame, width: int, anchor: int) -> DataFrame:
    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for block in text_blocks([batch], "row_key", "text", BLOCK_BYTES):
                rows = batch.slice(at, len(block))
                at += len(block)
                found = segments(block, width, anchor)
                which = pa.array(found["row"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found["anchor"]), pa.array(found["segment"]), rows.column(0).take(which), rows.column(2).take(which)]
                    + [pa.array(found[c].astype(np.int32)) for c in ("first", "last", "place")],
                    names=["anchor", "segment", "row_key", "text_key", "first", "last", "place"],
                )

    return docs.select("row_key", "text", "text_key").mapInArrow(scan, "anchor long, segment long, row_key long, text_key long, first int, last int, place int")


def _contents(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """The bytes of wanted segments."""
    lists = wanted.groupBy("row_key", "text_key").agg(F.collect_list(F.struct("anchor", "segment", "copies", "first", "last", "place", "crowded")).alias("wanted"))

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = byte_column(batch.column(0))
            out: list[tuple] = []
            size = 0
            for row, items in enumerate(batch.column(1).to_pylist()):
                text = data[offsets[row] : offsets[row + 1]]
                for s in items:
                    part = text[s["first"] : s["last"] + width]
                    out.append((s["anchor"], s["segment"], s["copies"], s["last"] - s["first"], s["place"], part.tobytes(), s["crowded"]))
                    size += len(part)
                    if size > SHARD_BYTES:
                        yield _content_batch(out)
                        out, size = [], 0
            if out:
                yield _content_batch(out)

    joined = docs.join(lists, ["row_key", "text_key"]).select("text", "wanted")
    return joined.mapInArrow(scan, "anchor long, segment long, copies long, windows int, place int, content binary, crowded boolean")


def _content_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.bool_())
    names = ["anchor", "segment", "copies", "windows", "place", "content", "crowded"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def meeting_parts(rows: list[tuple], width: int, anchor: int) -> list[tuple]:
    """What of an anchor's different segments can share a window: (anchor, segment, copies, first window, bytes).

    ``rows`` are (anchor, segment, copies, place, content). Equal windows lie at equal distances from the anchor, so
    they have equal cores, the bytes that all windows of a range of distances have. A window stays if another
    segment has its core, and one of those that have it occurs once: the others are known to be repeated.
    """
    step = -(-(width - anchor + 1) // RANGES)
    times: dict[tuple, int] = {}
    single: set[tuple] = set()
    cores = []
    for _, _, copies, place, content in rows:
        nearest = place - (len(content) - width)
        mine = []
        for low in range(nearest // step * step, place + 1, step):
            high = min(low + step - 1, width - anchor)
            core = (low, content[place - low : place - high + width])
            times[core] = times.get(core, 0) + 1
            if copies == 1:
                single.add(core)
            mine.append(core)
        cores.append(mine)
    out = []
    for (key, segment, copies, place, content), mine in zip(rows, cores):
        lows = [core[0] for core in mine if times[core] > 1 and core in single]
        if lows:
            first = max(place - (lows[-1] + step - 1), 0)
            last = min(place - lows[0], len(content) - width)
            out.append((key, segment, copies, first, content[first : last + width]))
    return out


def repeated_starts(parts: list[bytes], width: int) -> list[np.ndarray]:
    """Of each byte string, the starts of windows that occur elsewhere in the list, from one suffix array."""
    sizes = np.array([len(p) for p in parts])
    text = np.frombuffer(b"\0".join([*parts, b""]), np.uint8).astype(np.int32) + 2
    begins = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    text[begins + sizes] = 1
    text = np.append(text, 0)
    order = suffix_array(text)
    shared = permuted_common_prefixes(text, order)
    longest = shared.copy()
    np.maximum.at(longest, order[:-1], shared[order[1:]])
    return [np.flatnonzero(longest[b : b + s - width + 1] >= width) for b, s in zip(begins.tolist(), sizes.tolist())]


def _ranges(starts: np.ndarray) -> list[tuple[int, int]]:
    """Runs of whole numbers, first and last."""
    cuts = np.flatnonzero(np.diff(starts) > 1)
    return list(zip(starts[np.concatenate([[0], cuts + 1])].tolist(), starts[np.append(cuts, len(starts) - 1)].tolist()))


_FOUND = "anchor long, segment long, low int, high int"


def _by_suffix_arrays(contents: DataFrame, width: int, anchor: int) -> DataFrame:
    """(anchor, segment, low, high): window starts, counted from the segment's, that occur in another segment too.

    A partition's anchors are taken in order, as many at a time as fill a shard with what can share a window.
    """

    def solve(parts: list[tuple]) -> pa.RecordBatch:
        out = []
        for (key, segment, copies, first, _), starts in zip(parts, repeated_starts([p[4] for p in parts], width)):
            if len(starts) and copies == 1:
                out += [(key, segment, first + a, first + b) for a, b in _ranges(starts)]
        columns = zip(*out) if out else ([], [], [], [])
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["anchor", "segment", "low", "high"])

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        rows = (row for batch in batches for row in zip(*(batch.column(i).to_pylist() for i in range(5))))
        for _, group in groupby(rows, itemgetter(0)):
            different = [next(same) for _, same in groupby(group, itemgetter(1))]  # the same row may come again
            parts = meeting_parts(different, width, anchor)
            held += parts
            size += sum(len(p[4]) for p in parts)
            if size >= SHARD_BYTES:
                yield solve(held)
                held, size = [], 0
        if held:
            yield solve(held)

    plain = contents.filter("not crowded").select("anchor", "segment", "copies", "place", "content")
    return plain.repartition("anchor").sortWithinPartitions("anchor", "segment").mapInArrow(scan, _FOUND)


def _by_halves(contents: DataFrame, width: int, anchor: int) -> DataFrame:
    """The same for crowded anchors, however many segments one has.

    Windows are told by their distance from the anchor. Those of a range of distances share a core, the bytes that all
    of them have; equal windows have equal cores. Segments are grouped by core: alone, a segment's windows in the
    range occur nowhere else; where all members are equal and there are two, they all occur elsewhere; what is
    mixed goes on with the halves of the range, in the end with single windows, which are their own core.
    """
    first, last = F.col("place") - F.col("windows"), F.col("place")  # nearest and farthest distance
    rows = contents.filter("crowded").select(
        "anchor", "segment", "copies", "place", "content", first.alias("near"), last.alias("far"), F.lit(0).alias("range")
    )
    size = 1
    while 2 * size <= width - anchor:
        size *= 2
    found = None
    while size and not rows.isEmpty():
        halves = rows.withColumn("range", F.explode(F.array(2 * F.col("range"), 2 * F.col("range") + 1)))
        low, high = size * F.col("range"), size * F.col("range") + size - 1
        cut = halves.withColumn("near", F.greatest("near", low)).withColumn("far", F.least("far", high)).filter("near <= far")
        core = F.substring("content", F.col("place") - low + 1, F.lit(width - size + 1))
        own = F.substring("content", F.col("place") - F.col("far") + 1, F.col("far") - F.col("near") + width)
        cut = cut.withColumn("core", F.md5(F.concat(F.encode(F.concat_ws(":", "anchor", "range"), "utf-8"), core)))
        cut = cut.withColumn("own", F.concat_ws(":", F.md5(own), "near", "far")).checkpoint()
        groups = cut.groupBy("core").agg(F.sum("copies").alias("times"), F.min("own").alias("least"), F.max("own").alias("most"))
        groups = groups.filter("times > 1").select("core", (F.col("least") != F.col("most")).alias("mixed"))
        met = cut.join(groups, "core").checkpoint()
        settled = met.filter("NOT mixed AND copies = 1").select(
            "anchor", "segment", (F.col("place") - F.col("far")).alias("low"), (F.col("place") - F.col("near")).alias("high")
        )
        found = settled if found is None else found.unionByName(settled)
        rows = met.filter("mixed").select("anchor", "segment", "copies", "place", "content", "near", "far", "range")
        size //= 2
    if found is None:
        return contents.sparkSession.createDataFrame([], _FOUND)
    return found


def repeated_spans(docs: DataFrame, width: int = WIDTH, anchor: int = ANCHOR, max_segments: int = MAX_SEGMENTS) -> DataFrame:
    """(row_key, text_key, spans) of texts with repeats; ``docs`` has row_key, text and text_key, the keys never null.

    Spans are (start, end) in bytes and may overlap.
    """
    spark = docs.sparkSession
    rows = _all_segments(docs, width, anchor).checkpoint()
    # checkpointed, so that both sides of the joins are plain shuffles, of which Spark splits those of a frequent anchor
    often = rows.groupBy("anchor").count().filter("count > 1").select("anchor").checkpoint()
    rows = rows.join(often, "anchor", "left_semi").checkpoint()
    different = (
        rows.groupBy("anchor", "segment")
        .agg(F.count("*").alias("copies"), F.min(F.struct("row_key", "text_key", "first", "last", "place")).alias("at"))
        .checkpoint()
    )
    release(spark)
    kinds = different.groupBy("anchor").agg(F.count("*").alias("kinds")).filter("kinds > 1").checkpoint()
    wanted = different.join(kinds, "anchor").select("anchor", "segment", "copies", "at.*", (F.col("kinds") > max_segments).alias("crowded"))
    contents = _contents(docs, wanted, width).checkpoint()
    release(spark)
    partly = _by_suffix_arrays(contents, width, anchor).unionByName(_by_halves(contents, width, anchor)).checkpoint()
    release(spark)
    wholly = different.filter("copies > 1").select(
        "anchor", "segment", F.lit(0).alias("low"), (F.col("at.last") - F.col("at.first")).alias("high")
    )
    spans = rows.join(partly.unionByName(wholly), ["anchor", "segment"]).select(
        "row_key", "text_key", F.struct((F.col("first") + F.col("low")).alias("start"), (F.col("first") + F.col("high") + width).alias("end")).alias("span")
    )
    return spans.groupBy("row_key", "text_key").agg(F.collect_set("span").alias("spans"))


def merged_spans(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Sorted, with overlapping and touching ones made one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted((s["start"], s["end"]) for s in spans or []):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def remove_repeats(
    docs: DataFrame,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    width: int = WIDTH,
    anchor: int = ANCHOR,
    max_segments: int = MAX_SEGMENTS,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (binary), spans.

    A byte goes if it lies in a string of ``width`` bytes that also starts anywhere else, in the same text or
    another, overlaps included; strings are judged on the input, and none crosses texts. ``kept`` is the rest,
    joined; it may cut characters. A null counts as empty; texts shorter than ``width`` stay whole; each of
    two equal rows is the other's repeat; ids may be null or shared; an empty table gives no rows; further
    columns are not read.

    What moves: 40 bytes for every 185 bytes of text or so, the different segments of repeated anchors, and
    each text twice, to meet its segments and its spans. For an anchor with over ``max_segments`` different
    segments nothing is gathered but counts.
    """
    use_shared_folder(docs.sparkSession)
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    keyed = docs.select(F.col(id_column).cast("long").alias("doc_id"), text.alias("text"))
    # rows are told by two hashes, as an id may be null; equal rows have equal spans
    keyed = keyed.withColumn("text_key", F.xxhash64("text")).withColumn("row_key", F.xxhash64(F.lit("row"), "doc_id", "text"))
    spans = repeated_spans(keyed, width, anchor, max_segments)
    joined = keyed.join(spans, ["row_key", "text_key"], "left").select("doc_id", "text", "spans")

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = byte_column(batch.column(1))
            out = []
            for row, (doc, found) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())):
                body = data[offsets[row] : offsets[row + 1]].tobytes()
                cut = merged_spans(found)
                kept, at = [], 0
                for start, end in cut:
                    kept.append(body[at:start])
                    at = end
                rest = b"".join([*kept, body[at:]])
                spans = [{"start": a, "end": b} for a, b in cut]
                out.append((doc, len(body), len(body) - len(rest), len(cut), hashlib.sha256(rest).hexdigest(), rest, spans))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _OUT.types)], names=_OUT.names)

    return joined.mapInArrow(
        scan,
        "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<struct<start: long, end: long>>",
    )


_OUT = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_bytes", pa.int64()),
        ("n_removed", pa.int64()),
        ("n_spans", pa.int64()),
        ("kept_sha256", pa.string()),
        ("kept", pa.binary()),
        ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
    ]
)
