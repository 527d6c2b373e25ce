"""BM25 top-k over posting lists cut into blocks of documents, each with a ceiling of its scores.

A list is what one term has in one block: its postings, and beside them the largest term frequency and the smallest
document length. Together these bound what the term can add to a score in the block, whatever k1 and b are. Most lists
have a posting or two, so a row of the index holds those of a term in the blocks of a segment as columns of numbers:
what is sorted, written and shuffled are these rows. A search reads the bounds alone first, scores the most promising blocks of every query, and then only those other
blocks whose ceiling reaches the k-th score found. Hits and scores are those of ``bm25_search``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.config import Settings, get_settings
from corpusloom.operators.batches import QueryBatch, as_batch
from corpusloom.operators.blocks import MAX_CELLS, PartialTopK, cuts, id_array, whole_runs
from corpusloom.operators.bm25 import (
    MAX_BLOCK_WEIGHTS,
    MAX_ENTRIES,
    SLICE_TOKENS,
    Bm25Index,
    _bucketed,
    _most_terms,
    _packed_weights,
    query_terms,
    query_weights,
)
from corpusloom.operators.bounds import MAX_BROADCAST_ROWS, hint_small
from corpusloom.operators.ranking import by_score, top_k
from corpusloom.session import release

BLOCK_DOCS = 64
#: Documents are blocked with others of about their length: so many classes for each doubling.
_CLASSES = 4
#: Lengths of a namespace are taken to fill about so many classes evenly.
_FILLED = 8
#: Documents of a segment, and of one task that cuts lists; postings of one task of a search.
_SEGMENT_DOCS = 1024
_TASK_DOCS = 4096
_TASK_POSTINGS = 1 << 18
_GROUP = ["query_id", "namespace"]
_BLOCK = ["namespace", "block"]
_SEGMENT = ["namespace", "segment"]
_BOUNDS = ["blocks", "n", "max_tf", "min_dl"]
_POSTINGS = ["doc_ids", "dls", "tfs"]
_SLACK = 1e-9


@dataclass(frozen=True)
class BlockMaxIndex:
    """``packed``: (namespace, segment, term, term_bucket, size, blocks, n, max_tf, min_dl, doc_ids, dls, tfs), the lists of a
    term in some blocks of a segment: four numbers for each list, and the ``size`` postings of all of them in their order.
    All lists of a block are in one segment."""

    packed: DataFrame
    frequencies: DataFrame
    means: DataFrame
    totals: DataFrame | None = None

    @property
    def lists(self) -> DataFrame:
        """(namespace, term, term_bucket, block, n, max_tf, min_dl, postings of doc_id, dl and tf)."""
        return _unpacked(self.packed)

    @classmethod
    def build(cls, chunks: DataFrame, block_docs: int = BLOCK_DOCS) -> BlockMaxIndex:
        index = Bm25Index.build(chunks)
        sizes = index.tokens.groupBy("namespace").count().agg(F.max("count"), F.sum("count")).first()
        largest, docs = (size or 0 for size in sizes)
        parts = max(1, -(-largest // (block_docs * _FILLED)))
        length = F.floor(_CLASSES * F.log2(F.col("dl") + 1)).cast("long")
        block = length * (1 << 32) + F.pmod(F.xxhash64("doc_id"), F.lit(parts))
        words = F.array_join("tokens", " ").alias("words")
        rows = index.tokens.select("doc_id", "namespace", "dl", words, block.alias("block"))
        segments = max(1, -(-largest // _SEGMENT_DOCS))
        rows = rows.withColumn("segment", F.pmod(F.xxhash64("block"), F.lit(segments)))
        whole = rows.repartition(max(1, -(-docs // _TASK_DOCS)), *_SEGMENT).sortWithinPartitions(*_SEGMENT, "block")
        doc_type = rows.schema["doc_id"].dataType.simpleString()
        packed = whole.mapInArrow(
            _cut_lists,
            "namespace string, segment long, term string, size long, blocks array<long>, n array<int>, max_tf array<int>, "
            f"min_dl array<int>, doc_ids array<{doc_type}>, dls array<int>, tfs array<int>",
        )
        return cls(_bucketed(packed), _bucketed(index.frequencies), index.means, index.totals)

    def write(self, path: str) -> None:
        """A file of each task that cuts lists, rows in the order of namespaces, buckets and terms, so that a search of some
        terms skips most of its pages. Postings are not shuffled for it."""
        ordered = self.packed.sortWithinPartitions("namespace", "term_bucket", "term", "segment")
        ordered.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/postings")
        Bm25Index(self.frequencies, self.means, totals=self.totals).write_figures(path, self.packed, F.sum("size"))
        release(self.packed.sparkSession)

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> BlockMaxIndex:
        stored = Bm25Index.read(spark, path)
        return cls(stored.postings, stored.frequencies, stored.means)

    def as_postings(self) -> Bm25Index:
        return Bm25Index(self.frequencies, self.means, postings=self.packed)


def _cut_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The packed lists of whole segments of documents (doc_id, namespace, dl, words, block, segment), in the order of blocks."""
    some = (batch.filter(pc.greater(batch.column(batch.schema.get_field_index("dl")), 0)) for batch in batches)
    for table, starts in whole_runs(some, _SEGMENT):
        for start, end in zip(starts, [*starts[1:], table.num_rows], strict=True):
            segment = table.slice(start, end - start)
            blocks, first = np.unique(segment.column("block").to_numpy(), return_index=True)
            ends = np.append(first[1:], end - start)
            lengths = np.add.reduceat(segment.column("dl").to_numpy(), first, dtype=np.int64)
            for at, to in cuts(lengths, SLICE_TOKENS):
                rows = segment.slice(first[at], ends[to - 1] - first[at]).combine_chunks()
                yield _packed(rows, blocks[at:to], np.repeat(np.arange(to - at), (ends - first)[at:to]))


def _packed(rows: pa.Table, blocks: np.ndarray, number: np.ndarray) -> pa.RecordBatch:
    """The packed lists of some whole blocks of a segment; ``number`` is the place of each row's block."""
    words = pc.list_flatten(pc.split_pattern(rows.column("words").combine_chunks(), " ")).dictionary_encode()
    terms, dl = words.dictionary, rows.column("dl").to_numpy()
    owner = np.repeat(np.arange(len(dl)), dl)
    pairs, tf = np.unique(words.indices.to_numpy().astype(np.int64) * len(dl) + owner, return_counts=True)
    code, doc = np.divmod(pairs, len(dl))
    lists = code * len(blocks) + number[doc]
    first = np.flatnonzero(np.append(True, lists[1:] != lists[:-1]))  # the first posting of each list
    code, block = code[first], blocks[number[doc[first]]]
    row = np.flatnonzero(np.append(True, code[1:] != code[:-1]))  # the first list of each term
    size = np.diff(np.append(first[row], len(doc)))

    def per_row(starts: np.ndarray, values: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)).astype(np.int32)), values)

    def numbers(values: np.ndarray) -> pa.Array:
        return pa.array(values.astype(np.int32))

    columns = {c: pa.repeat(rows.column(c)[0], len(row)) for c in _SEGMENT}
    columns |= {"term": terms.take(pa.array(code[row])), "size": pa.array(size), "blocks": per_row(row, pa.array(block))}
    columns["n"] = per_row(row, numbers(np.diff(np.append(first, len(doc)))))
    columns["max_tf"] = per_row(row, numbers(np.maximum.reduceat(tf, first)))
    columns["min_dl"] = per_row(row, numbers(np.minimum.reduceat(dl[doc], first)))
    columns["doc_ids"] = per_row(first[row], rows.column("doc_id").combine_chunks().take(pa.array(doc)))
    columns["dls"], columns["tfs"] = per_row(first[row], numbers(dl[doc])), per_row(first[row], numbers(tf))
    return pa.RecordBatch.from_pydict(columns)


def _unpacked(packed: DataFrame, postings: bool = True) -> DataFrame:
    """A row for each list of packed rows, with or without its postings."""
    doc_type = packed.schema["doc_ids"].dataType.elementType.simpleString()
    kept = ["namespace", "term", "term_bucket"]
    schema = "namespace string, term string, term_bucket int, block long, n long, max_tf int, min_dl int"
    schema += f", postings array<struct<doc_id: {doc_type}, dl: int, tf: int>>" if postings else ""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = _Lists.of(pa.Table.from_batches([batch]))
            own = pa.array(lists.row)
            columns = {c: batch.column(c).take(own) for c in kept}
            columns |= {"block": pa.array(lists.block), "n": pa.array(lists.n.astype(np.int64))}
            columns |= {"max_tf": pa.array(lists.max_tf), "min_dl": pa.array(lists.min_dl)}
            if postings:
                values = pa.StructArray.from_arrays([lists.doc_ids, pa.array(lists.dl), pa.array(lists.tf)], names=["doc_id", "dl", "tf"])
                ends = pa.array(np.append(lists.first, len(values)).astype(np.int32))
                columns["postings"] = pa.ListArray.from_arrays(ends, values)
            yield pa.RecordBatch.from_pydict(columns)

    return packed.select(*kept, *_BOUNDS, *(_POSTINGS if postings else [])).mapInArrow(unpack, schema)


@dataclass(frozen=True)
class _Lists:
    """Lists of packed rows: of each its row, block, bounds and first posting; the postings of all rows, if they were read."""

    row: np.ndarray
    block: np.ndarray
    n: np.ndarray
    max_tf: np.ndarray
    min_dl: np.ndarray
    first: np.ndarray
    doc_ids: pa.Array | None = None
    dl: np.ndarray | None = None
    tf: np.ndarray | None = None

    @classmethod
    def of(cls, rows: pa.Table) -> _Lists:
        flat = {c: pc.list_flatten(rows.column(c).combine_chunks()) for c in rows.column_names if c in {*_BOUNDS, *_POSTINGS}}
        block, n, max_tf, min_dl = (flat[c].to_numpy() for c in _BOUNDS)
        counts = pc.list_value_length(rows.column("blocks")).to_numpy()
        lists = cls(np.repeat(np.arange(rows.num_rows), counts), block, n, max_tf, min_dl, np.cumsum(n, dtype=np.int64) - n)
        if "doc_ids" in flat:
            lists = replace(lists, doc_ids=flat["doc_ids"], dl=flat["dls"].to_numpy(), tf=flat["tfs"].to_numpy())
        return lists

    def take(self, which: np.ndarray | slice) -> _Lists:
        return replace(self, **{c: getattr(self, c)[which] for c in ("row", "block", "n", "max_tf", "min_dl", "first")})

    def places(self) -> np.ndarray:
        """Where the postings of these lists are among those of all rows."""
        return np.repeat(self.first - np.cumsum(self.n) + self.n, self.n) + np.arange(int(self.n.sum()))


def _only(batches: Iterator[pa.RecordBatch], chosen: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Packed rows cut to the lists of the ``chosen`` blocks of each namespace."""
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        lists = _Lists.of(rows)
        names = rows.column("namespace").combine_chunks().dictionary_encode()
        space = names.indices.to_numpy()[lists.row]
        kept = np.zeros(len(space), bool)
        for code, name in enumerate(names.dictionary.to_pylist()):
            own = np.flatnonzero(space == code)
            kept[own] = np.isin(lists.block[own], chosen.get(name, ()))
        lists = lists.take(kept)
        places = pa.array(lists.places())
        counts = np.bincount(lists.row, minlength=len(batch))
        sizes = np.bincount(lists.row, lists.n, minlength=len(batch)).astype(np.int64)
        flat = {"blocks": lists.block, "n": lists.n, "max_tf": lists.max_tf, "min_dl": lists.min_dl}
        flat |= {"doc_ids": lists.doc_ids.take(places), "dls": lists.dl[lists.places()], "tfs": lists.tf[lists.places()]}
        columns = {c: rows.column(c).combine_chunks() for c in (*_SEGMENT, "term")}
        for name, values in flat.items():
            offsets = np.append(0, np.cumsum(sizes if name in _POSTINGS else counts)).astype(np.int32)
            columns[name] = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
        some = pa.array(counts > 0)
        yield pa.RecordBatch.from_pydict(columns).filter(some)


@dataclass(frozen=True)
class BlockMaxSearch:
    """The blocks that are scored first, those that still may hold a hit, and the hits.

    The ceilings and the leading hits, rows of numbers, are kept with the executors until ``release``.
    """

    first: DataFrame
    rest: DataFrame
    hits: DataFrame
    kept: tuple[DataFrame, ...]

    def release(self) -> None:
        for part in self.kept:
            part.unpersist()


def _saturation(tf: Column, dl: Column, settings: Settings) -> Column:
    k1, b = settings.bm25_k1, settings.bm25_b
    return tf / (tf + k1 * (1 - b + b * dl / F.col("avgdl")))


def _ceilings(lists: DataFrame, weights: DataFrame, keys: list[str], small: bool, settings: Settings) -> DataFrame:
    """(query_id, namespace, block, ceiling, matched): no document of the block scores above the ceiling, and at least
    ``matched`` have a term that counts for the query."""
    bounds = lists.select(*keys, "block", "n", "max_tf", "min_dl").join(hint_small(weights, small), keys)
    return (
        bounds.where("weight > 0")
        .groupBy(*_GROUP, "block")
        .agg(
            F.sum(F.col("weight") * _saturation(F.col("max_tf"), F.col("min_dl"), settings)).alias("ceiling"),
            F.max("n").alias("matched"),
        )
    )


def _promising(ceilings: DataFrame, k: int) -> DataFrame:
    """Blocks of the highest ceilings, as few as surely have ``k`` matches; never more than ``k``, as each block has one."""
    leading = top_k(ceilings, _GROUP, [F.col("ceiling").desc(), F.col("block")], k)
    before = W.partitionBy(*_GROUP).orderBy("rank").rowsBetween(W.unboundedPreceding, -1)
    counted = leading.withColumn("_before", F.coalesce(F.sum("matched").over(before), F.lit(0)))
    return counted.where(F.col("_before") < k).select(*_GROUP, "block")


def _scores(lists: DataFrame, weights: DataFrame, blocks: DataFrame, keys: list[str], small: bool, settings: Settings) -> DataFrame:
    """Exact scores of all documents in the given blocks of each query."""
    met = lists.select(*keys, "block", "postings").join(hint_small(weights, small), keys).join(blocks, [*_GROUP, "block"])
    postings = met.select(*_GROUP, "weight", "avgdl", F.inline("postings"))
    score = F.sum(F.col("weight") * _saturation(F.col("tf"), F.col("dl"), settings))
    return postings.groupBy(*_GROUP, "doc_id").agg(score.alias("score")).where("score > 0")


def _entries(code: np.ndarray, first: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row with a term the runs of its queries: row, and place among the entries of ``_packed_weights``."""
    repeats = length[code]
    entry = np.repeat(first[code] - np.cumsum(repeats) + repeats, repeats) + np.arange(int(repeats.sum()))
    return np.repeat(np.arange(len(code)), repeats), entry


@dataclass(frozen=True)
class _InTasks:
    """The steps of a search whose weights are shipped: tasks get whole blocks, their lists of the asked terms in order.

    A task works on (blocks x queries) and (documents x queries) of bounded size, so what it holds and what it sends
    on does not grow with the corpus.
    """

    query_ids: pa.Array
    weights: dict[str, tuple]
    k: int
    k1: float
    b: float

    def _parts(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, _Lists, np.ndarray, np.ndarray]]:
        """(namespace, lists of some whole blocks, number of each list's block, blocks). The lists have their term's place in
        the vocabulary as ``row``: every row has a term that is asked for."""
        for table, starts in whole_runs(batches, _SEGMENT):
            names = table.column("namespace").take(pa.array(starts)).to_pylist()
            for namespace, start, end in zip(names, starts, [*starts[1:], table.num_rows], strict=True):
                if namespace not in self.weights:
                    continue
                rows = table.slice(start, end - start)
                codes = pc.index_in(rows.column("term").combine_chunks(), self.weights[namespace][0]).to_numpy()
                lists = _Lists.of(rows)
                lists = replace(lists, row=codes[lists.row]).take(lists.block.argsort(kind="stable"))
                blocks, first = np.unique(lists.block, return_index=True)
                if not len(blocks):
                    continue
                ends = np.append(first[1:], len(lists.block))
                # no more documents than postings, and no more entries than postings x queries
                bound = max(1, min(MAX_CELLS, 8 * MAX_ENTRIES) // max(1, len(self.weights[namespace][2])))
                for at, to in cuts(np.add.reduceat(lists.n, first, dtype=np.int64), bound):
                    number = np.repeat(np.arange(to - at), (ends - first)[at:to])
                    yield namespace, lists.take(slice(first[at], ends[to - 1])), number, blocks[at:to]

    def _saturation(self, tf: np.ndarray, dl: np.ndarray, avgdl: float) -> np.ndarray:
        return tf / (tf + self.k1 * (1 - self.b + self.b * dl / avgdl))

    def _ceilings(self, namespace: str, lists: _Lists, number: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ceilings and matches of (blocks x queries), as ``_ceilings`` has them."""
        _, avgdl, slots, first, length, columns, values = self.weights[namespace]
        row, entry = _entries(lists.row, first, length)
        counts = values[entry] > 0
        row, entry = row[counts], entry[counts]
        cells = number[row] * len(slots) + columns[entry]
        shape = len(blocks), len(slots)
        ceilings = np.bincount(cells, self._saturation(lists.max_tf, lists.min_dl, avgdl)[row] * values[entry], minlength=shape[0] * shape[1])
        matched = np.zeros(shape[0] * shape[1], np.int64)
        np.maximum.at(matched, cells, lists.n[row])
        return ceilings.astype(np.float64).reshape(shape), matched.reshape(shape)

    def leading(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(query_id, namespace, block, ceiling, matched) that can be among the ``k`` highest ceilings."""
        best = PartialTopK(self.query_ids, self.k)
        for namespace, lists, number, blocks in self._parts(batches):
            slots = self.weights[namespace][2]
            ceilings, matched = self._ceilings(namespace, lists, number, blocks)
            at, column = np.nonzero(best.kept(namespace, slots, ceilings, positive_only=True))
            yield self._blocks(namespace, slots[column], blocks[at], ceilings[at, column], matched[at, column])

    def _blocks(self, namespace: str, slots: np.ndarray, blocks: np.ndarray, ceilings: np.ndarray, matched: np.ndarray) -> pa.RecordBatch:
        names = pa.array(np.full(len(slots), namespace, dtype=object), pa.string())
        return pa.RecordBatch.from_arrays(
            [self.query_ids.take(pa.array(slots)), names, pa.array(blocks), pa.array(ceilings), pa.array(matched)],
            names=["query_id", "namespace", "block", "ceiling", "matched"],
        )

    def _wanted(self, namespace: str, blocks: np.ndarray, known: dict[tuple[str, int], list[int]]) -> np.ndarray:
        """Mask of (blocks x queries): the pairs in ``known``, which has the slots of some blocks."""
        slots = self.weights[namespace][2]
        mask = np.zeros((len(blocks), len(slots)), bool)
        for i, block in enumerate(blocks.tolist()):
            if (namespace, block) in known:
                mask[i, np.searchsorted(slots, known[namespace, block])] = True
        return mask

    def _reached(self, namespace: str, lists: _Lists, number: np.ndarray, blocks: np.ndarray, known: dict, floors: dict[str, np.ndarray]):
        """Ceilings, matches and the mask of what is not ``known`` and can hold a hit above the floors."""
        ceilings, matched = self._ceilings(namespace, lists, number, blocks)
        floor = floors[namespace][self.weights[namespace][2]]
        mask = (ceilings > 0) & (ceilings * (1 + _SLACK) + 2 * _SLACK >= floor) & ~self._wanted(namespace, blocks, known)
        return ceilings, matched, mask

    def rest(self, batches: Iterator[pa.RecordBatch], known: dict, floors: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        """(query_id, namespace, block, ceiling, matched) of blocks that can hold a hit besides the known ones."""
        for namespace, lists, number, blocks in self._parts(batches):
            ceilings, matched, mask = self._reached(namespace, lists, number, blocks, known, floors)
            at, column = np.nonzero(mask)
            yield self._blocks(namespace, self.weights[namespace][2][column], blocks[at], ceilings[at, column], matched[at, column])

    def scores(self, batches: Iterator[pa.RecordBatch], known: dict, floors: dict[str, np.ndarray] | None = None) -> Iterator[pa.RecordBatch]:
        """Partial top-k rows of the known blocks; with floors, of the others that can hold a hit."""
        best = PartialTopK(self.query_ids, self.k)
        for namespace, lists, number, blocks in self._parts(batches):
            if floors is None:
                mask = self._wanted(namespace, blocks, known)
            else:
                mask = self._reached(namespace, lists, number, blocks, known, floors)[2]
            scored = np.flatnonzero(mask.any(axis=1)[number])
            if not len(scored):
                continue
            _, avgdl, slots, first, length, columns, values = self.weights[namespace]
            lists = lists.take(scored)
            code, owner, places = lists.row, np.repeat(np.arange(len(scored)), lists.n), lists.places()
            ids = lists.doc_ids.take(pa.array(places)).dictionary_encode(null_encoding="encode")
            tf, dl = lists.tf[places], lists.dl[places]
            order = pc.sort_indices(ids.dictionary, null_placement="at_start").to_numpy()
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            # a document is told by its id and block
            pairs, doc = np.unique(place[ids.indices.to_numpy()] * len(blocks) + number[scored][owner], return_inverse=True)
            saturation = self._saturation(tf, dl, avgdl)
            scores = np.zeros(len(pairs) * len(slots))
            for at, end in cuts(length[code[owner]], MAX_ENTRIES):
                row, entry = _entries(code[owner[at:end]], first, length)
                cells = doc[at:end][row] * len(slots) + columns[entry]
                scores += np.bincount(cells, saturation[at:end][row] * values[entry], minlength=len(scores))
            scores = np.where(mask[pairs % len(blocks)], scores.reshape(len(pairs), len(slots)), 0.0)
            doc_ids = ids.dictionary.take(pa.array(order[pairs // len(blocks)]))
            yield best.rows(namespace, slots, doc_ids, scores, positive_only=True)


def _search_in_tasks(stored: Bm25Index, weights: DataFrame, keys: list[str], batch: QueryBatch, k: int, settings: Settings) -> BlockMaxSearch:
    """The search of a batch whose weights, and so the blocks to score first, are few enough to ship."""
    spark = stored.postings.sparkSession
    found = weights.select("query_id", "namespace", "term", "weight", "avgdl").toArrow().to_pandas()
    ids = found["query_id"].drop_duplicates()
    query_type = weights.schema["query_id"].dataType
    packed = _packed_weights(found, pd.Series(range(len(ids)), index=ids.array))
    sent = spark.sparkContext.broadcast(_InTasks(id_array(ids.to_list(), query_type), packed, k, settings.bm25_k1, settings.bm25_b))

    terms = weights.select(*keys).distinct()
    lists = stored.postings.join(F.broadcast(terms), keys, "left_semi")
    total = stored.frequencies.join(F.broadcast(terms), keys, "left_semi").agg(F.sum("n")).first()[0] or 0
    parts = max(1, -(-total // _TASK_POSTINGS))

    def whole(rows: DataFrame, *columns: str) -> DataFrame:
        return rows.select(*_SEGMENT, "term", *columns).repartition(parts, *_SEGMENT).sortWithinPartitions(*_SEGMENT)

    block_type = f"query_id {query_type.simpleString()}, namespace string, block long, ceiling double, matched long"
    doc_type = stored.postings.schema["doc_ids"].dataType.elementType.simpleString()
    hit_type = f"query_id {query_type.simpleString()}, namespace string, doc_id {doc_type}, score double"
    order = [by_score("score"), F.col("doc_id")]

    bounds = whole(lists, *_BOUNDS)
    best = bounds.mapInArrow(lambda batches: sent.value.leading(batches), block_type)
    found = _promising(best, k)
    rows = found.toArrow()
    first = spark.createDataFrame(rows, found.schema)
    release(spark)  # the shuffled bounds
    slots = dict(zip(ids, range(len(ids)), strict=True))
    known: dict[tuple[str, int], list[int]] = {}
    for query_id, namespace, block in zip(*(rows.column(c).to_pylist() for c in (*_GROUP, "block")), strict=True):
        known.setdefault((namespace, block), []).append(slots[query_id])
    shipped = spark.sparkContext.broadcast(known)
    blocks = {namespace: np.array([block for name, block in known if name == namespace], np.int64) for namespace in packed}
    picked = spark.sparkContext.broadcast(blocks)
    whole_rows = lists.select(*_SEGMENT, "term", *_BOUNDS, *_POSTINGS)
    chosen = whole(whole_rows.mapInArrow(lambda batches: _only(batches, picked.value), whole_rows.schema), *_BOUNDS, *_POSTINGS)
    leading = top_k(chosen.mapInArrow(lambda batches: sent.value.scores(batches, shipped.value), hit_type), _GROUP, order, k)
    leading = leading.persist(StorageLevel.MEMORY_AND_DISK)
    # a k-th score is a floor; a query with fewer hits has none, and all its blocks are scored
    floors = {namespace: np.full(len(ids), -np.inf) for namespace in packed}
    for row in leading.where(F.col("rank") == k - 1).select(*_GROUP, "score").collect():
        floors[row["namespace"]][slots[row["query_id"]]] = row["score"]
    rest = bounds.mapInArrow(lambda batches: sent.value.rest(batches, shipped.value, floors), block_type).select(*_GROUP, "block")
    others = whole(lists, *_BOUNDS, *_POSTINGS).mapInArrow(lambda batches: sent.value.scores(batches, shipped.value, floors), hit_type)
    hits = top_k(leading.drop("rank").unionByName(others), _GROUP, order, k)
    return BlockMaxSearch(first, rest, hits, (leading,))


def block_max_search(
    index: BlockMaxIndex,
    queries: DataFrame | QueryBatch,
    k: int | None = None,
    settings: Settings | None = None,
) -> BlockMaxSearch:
    """``hits``: (query_id, namespace, doc_id, score, rank), the best ``k`` positive scores per namespace."""
    settings = settings or get_settings()
    k = settings.retriever_top_k if k is None else k
    batch = as_batch(queries)
    stored = index.as_postings()
    if batch.bounded and _most_terms(batch) <= MAX_BLOCK_WEIGHTS:
        stored = stored.pruned(_bucketed(query_terms(batch.df)))
    weights, rows = query_weights(stored, batch, settings)
    small = rows <= MAX_BROADCAST_ROWS
    keys = [c for c in ("namespace", "term", "term_bucket") if c in weights.columns]
    if batch.bounded and rows <= MAX_BLOCK_WEIGHTS:
        return _search_in_tasks(stored, weights, keys, batch, k, settings)
    asked = stored.postings
    if small:
        asked = asked.join(F.broadcast(weights.select(*keys).distinct()), keys, "left_semi")
    lists = _unpacked(asked)
    order = [by_score("score"), F.col("doc_id")]

    ceilings = _ceilings(_unpacked(asked, postings=False), weights, keys, small, settings).persist(StorageLevel.MEMORY_AND_DISK)
    first = _promising(ceilings, k)
    leading = top_k(_scores(lists, weights, first, keys, small, settings), _GROUP, order, k)
    leading = leading.persist(StorageLevel.MEMORY_AND_DISK)
    # a k-th score is a floor; a query with fewer hits has none, and all its blocks are scored
    floors = leading.where(F.col("rank") == k - 1).select(*_GROUP, F.col("score").alias("floor"))
    rest = ceilings.join(first, [*_GROUP, "block"], "left_anti").join(floors, _GROUP, "left")
    reached = F.col("floor").isNull() | (F.col("ceiling") * (1 + _SLACK) + 2 * _SLACK >= F.col("floor"))
    rest = rest.where(reached).select(*_GROUP, "block")
    others = _scores(lists, weights, rest, keys, small, settings)
    hits = top_k(leading.drop("rank").unionByName(others), _GROUP, order, k)
    return BlockMaxSearch(first, rest, hits, (ceilings, leading))
