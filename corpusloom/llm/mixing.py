"""Mixing sources to target weights by balanced sampling with the cube method.

A document is taken a whole number of times, and once more with the probability that is left. Groups of documents of
one source move these probabilities along directions that keep the sums of tokens and of documents, until each is 0
or 1 but for two. What is left of all groups meets in fewer groups, until one small problem is left of each source.
"""

from __future__ import annotations

import random
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.batches import byte_column, use_shared_folder
from corpusloom.llm.words import _SPACES
from corpusloom.operators.ranking import spread_row_number

WEIGHTS = (3, 1, 2)
#: Share of all sizes that the sources' targets add up to, and the most of its own size that a source may be asked for.
SHARE = 1.5
MOST = 2.0
#: Documents of one flight, on average.
GROUP = 4096
#: Documents of each power of two of sizes that a group leaves for the last problem.
RESERVE = 6
_NEAR = 1e-9
_CHUNK = 4096


def word_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Number of runs of non-space bytes of each text."""
    spaced = _SPACES[data]
    before = np.concatenate([[True], spaced[:-1]]) if len(data) else spaced
    begins = offsets[:-1]
    before[begins[begins < len(data)]] = True
    starts = np.concatenate([[0], np.cumsum(~spaced & before)])
    return starts[offsets[1:]] - starts[offsets[:-1]]


def _sized(docs: DataFrame, id_column: str, text_column: str, source_column: str) -> DataFrame:
    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = byte_column(batch.column(2))
            sizes = np.empty(batch.num_rows, np.int64)
            first = 0
            while first < batch.num_rows:  # about 2 MB at a time
                last = max(int(np.searchsorted(offsets, offsets[first] + (2 << 20), side="right")) - 1, first + 1)
                cut = offsets[first : last + 1]
                sizes[first:last] = word_counts(data[cut[0] : cut[-1]], cut - cut[0])
                first = last
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes)], names=["doc_id", "source", "size"])

    chosen = docs.select(
        F.col(id_column).cast("long").alias("doc_id"),
        F.col(source_column).cast("string").alias("source"),
        F.col(text_column).cast("string").alias("text"),
    )
    return chosen.mapInArrow(count, "doc_id long, source string, size long")


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Adds number and target to (source, source_size): sources in order of code points, a null one last, have the
    weights in turn and share ``share`` of all sizes; no target exceeds ``most`` times its source's size, and what is
    above is shared by weight among those that are below.

    A source's target is its weight times one level, or its bound. The level is found in rounds, each one aggregation
    over the sources; it only rises, and ends where no further source reaches its bound.
    """
    named = spread_row_number(sources.filter("source IS NOT NULL").withColumn("all", F.lit(0)), "all", "source", "number", "n_named")
    named = named.select("source", "source_size", "number")
    nameless = sources.filter("source IS NULL").withColumn("number", F.lit(sources.filter("source IS NOT NULL").count()))
    numbered = named.unionByName(nameless)
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod("number", F.lit(len(weights))).cast("int"))
    numbered = numbered.withColumn("weight", weight).withColumn("bound", most * F.col("source_size")).checkpoint()
    level, capped = 0.0, -1
    while True:
        above = F.col("weight") * level > F.col("bound")
        found = numbered.agg(
            F.sum("source_size").alias("all"),
            F.sum(F.when(above, F.col("bound")).otherwise(0.0)).alias("held"),
            F.sum(F.when(above, 0.0).otherwise(F.col("weight"))).alias("open"),
            F.sum(above.cast("long")).alias("capped"),
        ).first()
        if not found["open"] or found["capped"] == capped:
            break
        capped, level = found["capped"], (share * found["all"] - found["held"]) / found["open"]
    return numbered.select("source", "source_size", "number", F.least(F.col("weight") * level, F.col("bound")).alias("target"))


def flight(chances: list[float], sizes: list[float], rng: random.Random) -> list[float]:
    """Chances moved to 0 or 1 but for two at most, by steps that keep their sum and the sum of chance times size.

    Three columns (1, size) have a direction in which both sums stand still: the cross product of the rows of ones and
    of sizes. A step goes along it, or against it, as far as the chances allow, with the probabilities that keep
    every expected chance as it was.
    """
    out = list(chances)
    window: list[int] = []
    at = 0
    while True:
        while len(window) < 3 and at < len(out):
            if _NEAR < out[at] < 1 - _NEAR:
                window.append(at)
            else:
                out[at] = float(round(out[at]))
            at += 1
        if len(window) < 3:
            return out
        a, b, c = (sizes[i] for i in window)
        way = (c - b, a - c, b - a) if not a == b == c else (1.0, -1.0, 0.0)
        ahead = min((1 - out[i]) / u if u > 0 else -out[i] / u for i, u in zip(window, way) if u)
        back = min(out[i] / u if u > 0 else (out[i] - 1) / u for i, u in zip(window, way) if u)
        step = ahead if rng.random() * (ahead + back) < back else -back
        for i, u in zip(window, way):
            out[i] += step * u
        for i in [i for i in window if not _NEAR < out[i] < 1 - _NEAR]:
            out[i] = float(round(out[i]))
            window.remove(i)


def landing(chances: list[float], sizes: list[float]) -> list[float]:
    """Chances rounded from the largest size down, each the way that brings the sum of sizes nearer to the expected one;
    then, as long as it comes nearer still, one is turned round, or two for each other."""
    out = list(chances)
    open_ones = sorted((i for i in range(len(out)) if 0 < out[i] < 1), key=lambda i: -sizes[i])
    excess = 0.0
    for i in open_ones:
        up = abs(excess + (1 - out[i]) * sizes[i]) < abs(excess - out[i] * sizes[i])
        excess += (float(up) - out[i]) * sizes[i]
        out[i] = float(up)
    while open_ones:
        turns = np.array([sizes[i] * (1 - 2 * out[i]) for i in open_ones])  # what turning each round adds
        pairs = turns[:, None] + turns[None, :]
        np.fill_diagonal(pairs, turns)
        best = np.unravel_index(np.abs(excess + pairs).argmin(), pairs.shape)
        if abs(excess + pairs[best]) > abs(excess) - _NEAR:
            break
        excess += pairs[best]
        for k in set(best):
            out[open_ones[k]] = 1 - out[open_ones[k]]
    return out


def settle(chances: list[float], sizes: list[float], last: bool, seed: str, reserve: int = RESERVE) -> list[float]:
    """New chances of one group, given in a fixed order. The first ``reserve`` of each power of two of sizes are
    left for the last problem, so that it can make up for a large document; the last one settles all."""
    chances = list(chances)
    kinds = [int(size).bit_length() for size in sizes]
    if not last:  # a group leaves at most a quarter, so that rounds end
        reserve = min(reserve, len(sizes) // 4 // len(set(kinds)))
    left: dict[int, int] = {}
    flying = []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        left[kinds[i]] = left.get(kinds[i], 0) + 1
        if left[kinds[i]] > reserve:
            flying.append(i)
    moved = flight([chances[i] for i in flying], [sizes[i] for i in flying], random.Random(seed))
    for i, chance in zip(flying, moved):
        chances[i] = chance
    return landing(chances, sizes) if last else chances


_UNIT = "number long, doc_id long, size long, copies long, wholly long, chance double"


def _flown(todo: DataFrame, group: int, seed: str) -> DataFrame:
    """One round: the units of each source dealt into groups, each with its flight, the only group of a source with its landing."""
    counts = todo.groupBy("number").agg(F.ceil(F.count("*") / F.lit(group)).cast("long").alias("groups"))
    dealt = todo.join(counts, "number").withColumn("deal", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size"), F.col("groups")))

    def place(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("size", "descending"), ("doc_id", "ascending")])
        sizes = [float(s) for s in rows["size"].to_pylist()]
        last = rows["groups"][0].as_py() == 1
        moved = settle(rows["chance"].to_pylist(), sizes, last, f"{seed}:{key[0].as_py()}:{key[1].as_py()}")
        return rows.select(["number", "doc_id", "size", "copies", "wholly"]).append_column("chance", pa.array(moved, pa.float64()))

    return dealt.groupBy("number", "deal").applyInArrow(place, _UNIT)


def _decided(units: DataFrame, group: int, seed: int) -> DataFrame:
    """Units (number, doc_id, size, copies, wholly, chance) with every chance 0 or 1, from rounds of flights."""
    done = units.filter("chance = 0 OR size = 0").withColumn("chance", F.lit(0.0))
    todo = units.filter("chance > 0 AND size > 0")
    turn = 0
    while not todo.isEmpty():
        found = _flown(todo, group, f"{seed}:{turn}").checkpoint()
        done = done.unionByName(found.filter("chance IN (0.0, 1.0)"))
        todo = found.filter("chance > 0 AND chance < 1")
        turn += 1
    return done


def mix_sources(
    docs: DataFrame,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
    group: int = GROUP,
    seed: int = 7,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size (words), source_size, target, times, taken.

    ``times`` says how often the mix takes the document, ``taken`` its words in the mix. The taken words and documents of a
    source are those its target asks for, but for the last problem of each source, whose documents are
    rounded so that the words come nearest. Null and empty texts have no words and are taken no times; a
    null source is a source, the last; ids may be null or shared, and of equal rows as many are taken as of others, which of
    them does not matter; an empty table gives no rows; further columns are not read. The same rows give the same mix.

    What moves is a row of 40 bytes for each document. A source with any share of the rows is dealt by document into
    groups of about ``group``, each of which leaves two documents and up to ``RESERVE`` for each power of two of sizes.
    """
    if group < 16:
        raise ValueError("a group holds 16 documents at least")
    use_shared_folder(docs.sparkSession)
    # equal rows are counted first, so that no group is filled by one document
    kinds = _sized(docs, id_column, text_column, source_column).groupBy("source", "doc_id", "size").agg(F.count("*").alias("copies")).checkpoint()
    sizes = kinds.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size")).checkpoint()
    targets = source_targets(sizes, weights, share, most)
    factor = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    targets = targets.withColumn("factor", factor).checkpoint()
    met = kinds.join(targets, kinds["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    # a fraction that is a whole number but for rounding is one, so that a source at its bound is taken whole
    whole = F.floor(F.col("factor") + _NEAR)
    part = F.greatest((F.col("factor") - whole) * F.col("copies"), F.lit(0.0))
    wholly = F.floor(part + _NEAR)
    units = met.select(
        "number", "doc_id", "size", "copies", wholly.alias("wholly"), F.greatest(part - wholly, F.lit(0.0)).alias("chance")
    )
    units = units.withColumn("chance", F.when(F.col("chance") < _NEAR, 0.0).otherwise(F.col("chance")))
    decided = _decided(units, group, seed)
    once_more = (F.col("wholly") + F.col("chance")).cast("long")  # so many of the equal rows are taken once more
    chunks = F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / _CHUNK)))
    spread = decided.select("number", "doc_id", "size", "copies", once_more.alias("more"), chunks.alias("chunk"))
    inside = F.sequence(F.col("chunk") * _CHUNK, F.least((F.col("chunk") + 1) * _CHUNK, F.col("copies")) - 1)
    rows = spread.withColumn("copy", F.explode(inside))
    times = (F.floor(F.col("factor") + _NEAR) + (F.col("copy") < F.col("more")).cast("long")).cast("int")
    rows = rows.join(targets, "number").withColumn("times", F.when(F.col("size") == 0, 0).otherwise(times))
    return rows.select(
        "doc_id", "source", "size", "source_size", "target", "times", (F.col("times") * F.col("size")).cast("long").alias("taken")
    )
