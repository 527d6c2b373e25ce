"""Near-duplicate documents: MinHash bands, sequential Bayesian verification, exact confirmation, components.

Documents with equal shingle sets are one node from the start. Nodes that share a band are candidates; a
candidate pair is compared signature batch by signature batch and dropped as soon as the posterior chance
that it reaches the threshold falls below ``MISS``; what is left is confirmed on the full sets.

A component needs only some of its links, so pairs are looked at in two steps. First every node meets the
first node of the band group it shares most bands with. What that leaves in different components is
then compared inside the band groups, where a link that is found joins two components at once, so that
a task reports fewer links than it has members, however alike they all are.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache
from math import lgamma

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.batches import giving_back, release, text_blocks, two_columns, use_shared_folder
from corpusloom.llm.words import _multipliers, hash_spans, hash_windows, mix, word_spans

SHINGLE_WORDS = 4
PERCENT = 80
#: Bands of rows: a pair at the threshold shares none with a chance of 3 in a million.
BANDS, ROWS = 24, 4
BATCH = 32
#: A pair is dropped when it reaches the threshold with a lower chance than this, given its matches so far.
MISS = 1e-6
#: Members of a band group that meet in one task.
TILE = 1024

_HASHES = BANDS * ROWS
_FACTORS = (_multipliers(2 * _HASHES) >> np.uint64(32)).astype(np.uint32)
_TIMES, _PLUS = (_FACTORS[:_HASHES] | np.uint32(1))[:, None], _FACTORS[_HASHES:][:, None]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the shingles of each text; words are ASCII-lowered runs of non-spaces."""
    starts, ends, texts = word_spans(data, offsets)
    words = hash_spans(data, starts, ends, lower=True)
    bounds = np.searchsorted(texts, np.arange(len(offsets)))
    windows = hash_windows(words, size)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(windows[a : b - size + 1]))
        elif b > a:  # the whole sequence; its length keeps it apart from other sequences
            out.append(mix(hash_windows(words[a:b], b - a) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """The smallest value of each of ``_HASHES`` permutations of the shingles."""
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    best = np.full(_HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(short), 512):
        np.minimum(best, (short[None, at : at + 512] * _TIMES + _PLUS).min(axis=1), out=best)
    return best


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band of each signature; the band's number is part of it."""
    parts = signatures.reshape(len(signatures), BANDS, ROWS).astype(np.uint64)
    weights = _multipliers(ROWS + 1)
    return mix((parts * weights[:ROWS]).sum(axis=2, dtype=np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64) * weights[ROWS])


@cache
def least_matches(percent: int = PERCENT, miss: float = MISS) -> list[int]:
    """For each number of compared hashes the fewest matches with which a pair stays.

    With a uniform prior the similarity given m matches of n follows Beta(m + 1, n - m + 1); its chance to
    exceed the threshold equals that of at most m successes in n + 1 trials at the threshold.
    """
    t = percent / 100
    out = []
    for n in range(_HASHES + 1):
        total, m = 0.0, -1
        while total < miss:
            m += 1
            log = lgamma(n + 2) - lgamma(m + 1) - lgamma(n + 2 - m) + m * np.log(t) + (n + 1 - m) * np.log(1 - t)
            total += float(np.exp(log))
        out.append(m)
    return out


def posterior_keeps(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs of signatures survive all batches, and their matches."""
    least = least_matches()
    live = np.arange(len(a))
    matches = np.zeros(len(a), np.int64)
    for at in range(0, _HASHES, BATCH):
        matches[live] += (a[live, at : at + BATCH] == b[live, at : at + BATCH]).sum(axis=1)
        live = live[matches[live] >= least[min(at + BATCH, _HASHES)]]
    return live, matches


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(len(column), _HASHES)


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, n, set_a, set_b, signature): the size of each text's set, a 128-bit key of it, its signature."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, "doc_id", "text"):
            rows = []
            for shingles in shingle_sets(block.data, block.offsets):
                a = int(shingles.sum(dtype=np.uint64)) if len(shingles) else 0
                b = int(mix(shingles).sum(dtype=np.uint64)) if len(shingles) else 0
                rows.append((len(shingles), a, b, signature(shingles).tobytes() if len(shingles) else None))
            n, a, b, s = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [
                    block.ids,
                    pa.array(n, pa.int64()),
                    pa.array(np.array(a, np.uint64).view(np.int64)),
                    pa.array(np.array(b, np.uint64).view(np.int64)),
                    pa.array(s, pa.binary()),
                ],
                names=["doc_id", "n", "set_a", "set_b", "signature"],
            )

    return docs.mapInArrow(giving_back(scan), "doc_id long, n long, set_a long, set_b long, signature binary")


def _bands(nodes: DataFrame) -> DataFrame:
    """(key, node) for every band of every node."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = band_keys(_signatures(batch.column(1))).view(np.int64)
                ids = np.repeat(batch.column(0).to_numpy(), BANDS)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(ids)], names=["key", "node"])

    return nodes.select("node", "signature").mapInArrow(scan, "key long, node long")


def _by_posterior(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) that survive the comparison of their signatures."""
    side = lambda name: nodes.select(F.col("node").alias(name), F.col("signature").alias(f"{name}_signature"))

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                live, _ = posterior_keeps(_signatures(batch.column(2)), _signatures(batch.column(3)))
                yield batch.select([0, 1]).take(pa.array(live))

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_signature", "b_signature").mapInArrow(scan, "a long, b long")


def _alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _shingles_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, shingles) of the texts concerned, made anew."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, "doc_id", "text"):
            sets = [s.tobytes() for s in shingle_sets(block.data, block.offsets)]
            yield pa.RecordBatch.from_arrays([block.ids, pa.array(sets, pa.binary())], names=["node", "shingles"])

    rows = docs.join(wanted.select(F.col("node").alias("doc_id")), "doc_id", "left_semi")
    return rows.select("doc_id", "text").mapInArrow(giving_back(scan), "node long, shingles binary").filter(F.length("shingles") > 0)


def _confirmed(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full shingle sets are similar enough."""
    sets = _shingles_of(docs, pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [
                _alike(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), percent)
                for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            ]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    side = lambda name: sets.select(F.col("node").alias(name), F.col("shingles").alias(f"{name}_shingles"))
    joined = pairs.join(side("b"), "b").join(side("a"), "a")
    return joined.select("a", "b", "a_shingles", "b_shingles").mapInArrow(compare, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes with a link: the smallest node that can be reached.

    Alternates two steps until nothing changes: every node links its larger neighbours to the smallest
    one, then its smaller ones. A node's smallest neighbour is a combined minimum, never a list.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct().checkpoint()

    def state():
        return edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    before = state()
    while True:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        smallest = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
        large = both.join(smallest, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        smallest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(smallest, "a")
        edges = (
            small.select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionAll(smallest.select("a", F.col("m").alias("b")))
            .filter("a != b")
            .distinct()
            .checkpoint()
        )
        now = state()
        if now == before:
            break
        before = now
    # at rest every node links to its component alone
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))


_TILE = ["key", "low", "high"]


def _open_members(bands: DataFrame, nodes: DataFrame, labels: DataFrame, tile: int) -> DataFrame:
    """(key, low, high, part, node, component): members of band groups that have a candidate in another component
    left after the comparison of their signatures.

    Only groups that hold two components or more are opened. A large one is dealt into tiles, each the
    meeting of two parts of it; pairs are formed inside a tile and never leave it.
    """
    placed = bands.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = (
        placed.groupBy("key")
        .agg(F.count("*").alias("members"), F.min("component").alias("first"), F.max("component").alias("last"))
        .filter("first != last")
        .select("key", F.ceil(F.col("members") / tile).cast("int").alias("parts"))
    )
    rows = (
        placed.join(mixed, "key")
        .withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("key", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "node", "component")
        .join(nodes, "node")
        .select(*_TILE, "part", "node", "component", "n", "signature")
    )

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_tiles(batches):
            members = Members(rows, _signatures(rows.column(7).chunk(0)), rows.column(6).to_numpy())
            wanted = np.zeros(len(rows), bool)
            for i, j, _ in members.candidates():
                wanted[i] = True
                wanted[j] = True
            yield from rows.select([*range(6)]).filter(pa.array(wanted)).to_batches()

    kinds = "key long, low int, high int, part int, node long, component long"
    return rows.repartition(*_TILE).sortWithinPartitions(*_TILE, "node").mapInArrow(giving_back(scan), kinds)


def _links_in_tiles(members: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Confirmed links (a, b) between components, enough of them to join all that are linked inside a tile."""
    sets = _shingles_of(docs, members.select("node").distinct())
    rows = members.join(sets, "node").select(*_TILE, "part", "node", "component", "shingles")

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_tiles(batches):
            sets = [np.frombuffer(s, np.uint64) for s in rows.column(6).to_pylist()]
            sizes = np.array([len(s) for s in sets])
            members = Members(rows, np.stack([signature(s) for s in sets]), sizes)
            links = []
            for i, j, matches in members.candidates():
                for k in j[np.argsort(-matches, kind="stable")].tolist():
                    if members.component[i] != members.component[k] and _alike(sets[i], sets[k], percent):
                        members.join(i, k)
                        links.append(sorted((int(members.node[i]), int(members.node[k]))))
            if links:
                a, b = zip(*links)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return rows.repartition(*_TILE).sortWithinPartitions(*_TILE, "node").mapInArrow(giving_back(scan), "a long, b long")


def _whole_tiles(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one tile after the other, of batches that are sorted by tile."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        tile = np.stack([batch.column(i).to_numpy() for i in range(3)])
        bounds = [0, *(np.flatnonzero((tile[:, 1:] != tile[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        if held and any(held[0].column(i)[0] != batch.column(i)[0] for i in range(3)):
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
        for start, end in zip(bounds[:-1], bounds[1:]):
            held.append(batch.slice(start, end - start))
            if end < batch.num_rows:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


class Members:
    """The members of one tile, and the candidate pairs among them."""

    def __init__(self, rows: pa.Table, signatures: np.ndarray, sizes: np.ndarray):
        key, low, high, part, node, component = (rows.column(i).to_numpy() for i in range(6))
        self.key, self.across = key[0], low[0] != high[0]
        self.part, self.node, self.component = part, node, component.copy()
        self.signatures, self.sizes = signatures, sizes
        self.keys = band_keys(signatures).view(np.int64)

    def join(self, i: int, j: int) -> None:
        self.component[self.component == self.component[j]] = self.component[i]

    def candidates(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(i, all j behind i, matches) in other components whose signatures survive. A pair that shares several
        bands is looked at in the group of the first."""
        for i in range(len(self.node) - 1):
            j = np.arange(i + 1, len(self.node))
            small, large = np.minimum(self.sizes[j], self.sizes[i]), np.maximum(self.sizes[j], self.sizes[i])
            fits = (self.component[j] != self.component[i]) & (100 * small >= PERCENT * large)
            if self.across:
                fits &= self.part[j] != self.part[i]
            j = j[fits]
            if not len(j):
                continue
            shared = self.keys[j] == self.keys[i]
            j = j[self.keys[i][shared.argmax(axis=1)] == self.key]
            if not len(j):
                continue
            live, matches = posterior_keeps(np.broadcast_to(self.signatures[i], (len(j), _HASHES)), self.signatures[j])
            if len(live):
                yield i, j[live], matches[live]


def near_duplicates(
    docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", percent: int = PERCENT, tile: int = TILE
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Two documents are linked if 100 * |both sets| >= percent * |either set| for their sets of 4-word shingles
    (a text of fewer words is one shingle). ``component_id`` is the smallest doc_id that can be reached.
    A text without words, or null, has no shingles and is linked with nothing. Repeated rows are rows
    with equal sets; an id that comes back with another text is judged text by text, and links of either
    text hold for the id. A row without id belongs to the component of an id with an equal set, if there is one, and is
    kept only otherwise. An empty table gives no rows; further columns are not read. ``percent`` is 80
    or more.

    A link at the threshold is missed with a chance of about 4 in a million (bands and posterior); no link
    that is reported is wrong. Cut lineage and shared intermediate tables are checkpoints.
    """
    if percent < PERCENT:
        raise ValueError(f"the bands are laid out for {PERCENT} percent or more")
    spark = docs.sparkSession
    use_shared_folder(spark)
    docs = two_columns(docs, id_column, text_column).withColumn("doc_id", F.col("doc_id").cast("long"))
    sketched = sketches(docs).checkpoint()
    rows = sketched.select("doc_id", "n", "set_a", "set_b")
    groups = rows.filter("n > 0").groupBy("set_a", "set_b").agg(F.min("doc_id").alias("node"))
    nodes = (
        sketched.join(groups.select("node", "set_a", "set_b"), ["set_a", "set_b"])
        .filter("doc_id = node")
        .select("node", "n", "signature")
        .checkpoint()
    )
    bands = _bands(nodes)
    shared = bands.groupBy("key").agg(F.count("*").alias("members"), F.min("node").alias("first")).filter("members > 1")
    bands = bands.join(shared, "key").select("key", "node", "first").checkpoint()
    release(spark)

    nearest = (
        bands.filter("first != node")
        .groupBy("first", "node")
        .count()
        .groupBy("node")
        .agg(F.max_by("first", F.struct("count", -F.col("first"))).alias("a"))
        .select("a", F.col("node").alias("b"))
    )
    labels = components(_confirmed(_by_posterior(nearest, nodes).checkpoint(), docs, percent))

    release(spark)
    members = _open_members(bands.select("key", "node"), nodes, labels, tile).checkpoint()
    release(spark)
    more = _links_in_tiles(members, docs, percent)
    old = labels.select(F.col("node").alias("a"), F.col("component").alias("b"))
    labels = components(old.unionAll(more))
    release(spark)

    named = groups.join(labels, "node", "left").select("set_a", "set_b", F.coalesce("component", "node").alias("component_id"))
    found = rows.join(named, ["set_a", "set_b"], "left")
    component = F.coalesce("component_id", "doc_id")
    return found.select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept")
    )
