"""BM25 over a namespaced chunk table, for a whole batch of queries in one plan.

The Okapi weighting with a floor for negative idf values (Robertson & Zaragoza 2009):

    raw(t)  = ln(N - n + 0.5) - ln(n + 0.5)
    idf(t)  = raw(t), or epsilon * mean(raw over the vocabulary) where raw(t) < 0
    score   = sum over query tokens of idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))

All statistics are per namespace. Two ways to score, with equal results:

* blocks: tasks score whole documents in place and pass on partial top-k rows. No corpus-sized
  data is shuffled. Used when the query weights, counted first, are few enough to ship.
* join: postings joined with query weights, sums per (query, document). Used above that bound and
  for a written, inverted index, where pruning leaves only the postings of the query terms.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.config import Settings, get_settings
from corpusloom.functions.text import term_counts, tokenize
from corpusloom.operators.batches import QueryBatch, as_batch
from corpusloom.operators.blocks import PartialTopK, by_namespace, cuts, id_array
from corpusloom.operators.bounds import MAX_BROADCAST_ROWS, count_up_to, hint_small
from corpusloom.operators.ranking import by_score, top_k

TERM_BUCKETS = 64
MAX_PUSHED_VALUES = 1000
MAX_BLOCK_WEIGHTS = 500_000
#: Tokens that are scored at a time; a longer document is a slice of its own.
SLICE_TOKENS = 1 << 18
#: (document, term, query) entries that are added up at a time; a document with more is taken alone.
MAX_ENTRIES = 1 << 19
_TOTALS = ""


def tokenised(chunks: DataFrame) -> DataFrame:
    """(doc_id, namespace, tokens, dl) of every chunk that has text."""
    return (
        chunks.where((F.col("text") != "") & F.col("namespace").isNotNull())
        .select("doc_id", "namespace", tokenize(F.col("text")).alias("tokens"))
        .withColumn("dl", F.size("tokens"))
    )


def term_frequencies(tokens: DataFrame) -> DataFrame:
    """(doc_id, namespace, dl, term, tf), counted row by row without a shuffle.

    The outer form of ``inline`` keeps the optimizer from copying the counting into a filter.
    """
    counted = tokens.select("doc_id", "namespace", "dl", term_counts(F.col("tokens")).alias("_terms"))
    return counted.select("doc_id", "namespace", "dl", F.inline_outer("_terms")).where(
        F.col("term").isNotNull()
    )


def term_statistics(tokens: DataFrame) -> DataFrame:
    """(namespace, term, n, total_dl) in one pass and one shuffle.

    ``n`` counts the chunks with the term. The empty term stands for the whole namespace: its
    ``n`` is the number of chunks and only its ``total_dl``, their token count, is not null.
    Both uses filter on the aggregated column, and nulls go before it: so no filter is pushed
    below the aggregation and every consumer reuses the same exchange.
    """
    terms = F.concat(F.array(F.lit(_TOTALS)), F.array_distinct("tokens"))
    return (
        tokens.select("namespace", "dl", F.explode_outer(terms).alias("term"))
        .where(F.col("term").isNotNull())
        .groupBy("namespace", "term")
        .agg(
            F.count("*").alias("n"),
            F.sum(F.when(F.col("term") == _TOTALS, F.col("dl"))).alias("total_dl"),
        )
    )


def namespace_stats(statistics: DataFrame) -> DataFrame:
    """(namespace, n_docs, avgdl); documents without any token count too."""
    return statistics.where(F.col("total_dl").isNotNull()).select(
        "namespace", F.col("n").alias("n_docs"), (F.col("total_dl") / F.col("n")).alias("avgdl")
    )


def document_frequencies(statistics: DataFrame) -> DataFrame:
    """(namespace, term, n): in how many chunks a term occurs."""
    return statistics.where(F.col("total_dl").isNull()).select("namespace", "term", "n")


def _raw_idf():
    return F.log(F.col("n_docs") - F.col("n") + 0.5) - F.log(F.col("n") + 0.5)


def mean_idf(frequencies: DataFrame, stats: DataFrame) -> DataFrame:
    """(namespace, n_docs, avgdl, mean_idf): raw idf averaged over the vocabulary.

    Terms with equal frequency share their idf, so the vocabulary is first folded to a histogram
    of frequencies; a namespace with most of the terms leaves few rows to add up.
    """
    histogram = frequencies.groupBy("namespace", "n").agg(F.count("*").alias("_terms"))
    return (
        histogram.join(stats, "namespace")
        .groupBy("namespace")
        .agg(
            F.first("n_docs").alias("n_docs"),
            F.first("avgdl").alias("avgdl"),
            (F.sum(_raw_idf() * F.col("_terms")) / F.sum("_terms")).alias("mean_idf"),
        )
    )


def _floored_idf(epsilon: float):
    return F.when(_raw_idf() < 0, epsilon * F.col("mean_idf")).otherwise(_raw_idf())


def with_means(terms: DataFrame, means: DataFrame) -> DataFrame:
    """Rows of (namespace, term, …) with the figures of their namespace.

    A few namespaces may hold all terms, so each row of figures is repeated for every salt and the terms are
    dealt by their hash; the side of the figures is the one that is hashed, never the vocabulary.
    """
    salted = means.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(TERM_BUCKETS - 1)))).hint("shuffle_hash")
    dealt = terms.withColumn("_salt", F.pmod(F.xxhash64("term"), F.lit(TERM_BUCKETS)).cast("int"))
    return dealt.join(salted, ["namespace", "_salt"]).drop("_salt")


def idf_table(frequencies: DataFrame, means: DataFrame, epsilon: float = 0.25) -> DataFrame:
    """(namespace, term, n, idf) with the floor applied."""
    return with_means(frequencies, means).select(
        "namespace", "term", "n", _floored_idf(epsilon).alias("idf")
    )


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, namespace, term, qtf); a repeated token counts as often as it occurs."""
    counted = queries.select(
        "query_id",
        F.array_distinct("namespaces").alias("_namespaces"),
        term_counts(tokenize(F.col("question"))).alias("_terms"),
    )
    return (
        counted.select("query_id", F.explode("_namespaces").alias("namespace"), "_terms")
        .select("query_id", "namespace", F.inline_outer("_terms"))
        .where(F.col("term").isNotNull())
        .withColumnRenamed("tf", "qtf")
    )


def _bucketed(df: DataFrame) -> DataFrame:
    return df.withColumn("term_bucket", F.pmod(F.xxhash64("term"), F.lit(TERM_BUCKETS)).cast("int"))


@dataclass(frozen=True)
class Bm25Index:
    """Tokens or postings, document frequencies and per-namespace figures; ``totals`` are what a written index has its figures from."""

    frequencies: DataFrame
    means: DataFrame
    tokens: DataFrame | None = None
    postings: DataFrame | None = None
    totals: DataFrame | None = None

    @classmethod
    def build(cls, chunks: DataFrame) -> Bm25Index:
        """A lazy index over a chunk table (doc_id, namespace, text)."""
        tokens = tokenised(chunks)
        statistics = term_statistics(tokens)
        frequencies = document_frequencies(statistics)
        means = mean_idf(frequencies, namespace_stats(statistics))
        totals = tokens.groupBy("namespace").agg(F.count("*").alias("n_docs"), (F.sum("dl") / F.count("*")).alias("avgdl"))
        return cls(frequencies, means, tokens=tokens, totals=totals)

    def term_rows(self) -> DataFrame:
        return self.postings if self.postings is not None else term_frequencies(self.tokens)

    def persist(self) -> Bm25Index:
        """Keep the index with the executors; a lost block is computed again from the chunks."""
        level = StorageLevel.MEMORY_AND_DISK
        kept = {
            name: part.persist(level) if part is not None else None
            for name, part in vars(self).items()
            if name != "totals"
        }
        return Bm25Index(**kept)

    def unpersist(self) -> None:
        for part in vars(self).values():
            if part is not None:
                part.unpersist()

    def write(self, path: str, salts: int = 8) -> None:
        """Store the index inverted: partitions by namespace and term bucket, files by term.

        A search opens only the buckets of its own terms (``pruned``). The salt spreads the postings of a frequent term over several files;
        adaptive execution splits what is still larger than its advisory size, so a task sorts no more of a larger corpus.
        """
        (
            _bucketed(self.term_rows())
            .withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
            .hint("rebalance", "namespace", "term_bucket", "_salt")
            .sortWithinPartitions("namespace", "term_bucket", "term")
            .drop("_salt")
            .write.partitionBy("namespace", "term_bucket")
            .mode("overwrite")
            .parquet(f"{path}/postings")
        )
        self.write_figures(path, _bucketed(self.term_rows()), F.count("*"))

    def write_figures(self, path: str, rows: DataFrame, documents: Column) -> None:
        """The document frequencies by term bucket, and the figures of namespaces.

        Frequencies are added up from the term column of the written ``rows``, ``documents`` counting the chunks of a
        term, so the words of the corpus are not counted a second time.
        """
        read = rows.sparkSession.read
        frequencies, means = _bucketed(self.frequencies), self.means
        if self.totals is not None:
            stored = read.schema(rows.schema).parquet(f"{path}/postings")
            frequencies = stored.groupBy("namespace", "term", "term_bucket").agg(documents.alias("n"))
        (
            frequencies.hint("rebalance", "term_bucket")
            .write.partitionBy("term_bucket")
            .mode("overwrite")
            .parquet(f"{path}/frequencies")
        )
        if self.totals is not None:
            means = mean_idf(read.schema(frequencies.schema).parquet(f"{path}/frequencies"), self.totals)
        means.write.mode("overwrite").parquet(f"{path}/means")

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Bm25Index:
        """Namespaces are partition folders and stay strings, whatever they look like."""

        def table(name: str) -> DataFrame:
            schema = spark.read.parquet(f"{path}/{name}").schema
            schema["namespace"].dataType = T.StringType()
            return spark.read.schema(schema).parquet(f"{path}/{name}")

        return cls(**{name: table(name) for name in ("frequencies", "means", "postings")})

    def pruned(self, terms: DataFrame) -> Bm25Index:
        """A written index cut to the partitions and terms that a bounded batch asks for.

        Literal filters prune the file listing and, files being sorted by term, row groups too; a
        join alone would open every partition.
        """
        asked = terms.select("namespace", "term", "term_bucket").distinct().collect()
        wanted = {name: {row[name] for row in asked} for name in ("namespace", "term_bucket", "term")}

        def cut(table: DataFrame) -> DataFrame:
            for name, values in wanted.items():
                if len(values) <= MAX_PUSHED_VALUES:
                    table = table.where(F.col(name).isin(*values)) if values else table.limit(0)
            return table

        return replace(self, frequencies=cut(self.frequencies), postings=cut(self.postings))

    def size(self, namespace: str) -> int:
        row = self.means.where(F.col("namespace") == namespace).select("n_docs").first()
        return row[0] if row else 0


def _most_terms(batch: QueryBatch) -> int:
    """An upper bound of the (query, namespace, term) rows, from lengths where that suffices.

    A text of n characters has at most (n + 1) / 2 words, so a bounded batch needs no job.
    """
    if batch.bounded:
        columns = (batch.rows.column(name).to_pylist() for name in ("question", "namespaces"))
        pairs = zip(*columns, strict=True)
        most = sum((len(question or "") + 1) // 2 * len(names or ()) for question, names in pairs)
        if most <= MAX_BLOCK_WEIGHTS:
            return most
    return count_up_to(query_terms(batch.df), MAX_BROADCAST_ROWS)


def query_weights(
    index: Bm25Index, batch: QueryBatch, settings: Settings
) -> tuple[DataFrame, int]:
    """(query_id, namespace, term, weight, avgdl) and an upper bound of its rows.

    Each query term meets at most one frequency row and one namespace row, so the number of query
    terms bounds both joins.
    """
    terms, rows = query_terms(batch.df), _most_terms(batch)
    keys = ["namespace", "term"]
    if "term_bucket" in index.frequencies.columns:
        terms, keys = _bucketed(terms), [*keys, "term_bucket"]
    weight = F.col("qtf") * _floored_idf(settings.bm25_epsilon) * (settings.bm25_k1 + 1)
    small = rows <= MAX_BROADCAST_ROWS
    known = index.frequencies.join(hint_small(terms, small), keys)
    weights = (index.means.join(hint_small(known, small), "namespace") if small else with_means(known, index.means)).select(
        "query_id", *keys, weight.alias("weight"), "avgdl"
    )
    return weights.where(F.col("weight") != 0), rows


def _block_scorer(sent: Broadcast, k: int, k1: float, b: float):
    """Arrow batches of (doc_id, namespace, dl, tokens) to partial top-k rows, in slices of bounded size.

    ``sent`` holds the query ids and per namespace: the query terms, avgdl, the query slots, and for each term
    code the run of (slot column, weight) entries that mention it.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, weights = sent.value
        best = PartialTopK(query_ids, k)
        for batch in batches:
            slices = (batch.slice(at, end - at) for at, end in cuts(batch.column("dl").to_numpy(), SLICE_TOKENS))
            for namespace, part in (found for rows in slices for found in by_namespace(rows, weights, len(query_ids))):
                vocabulary, avgdl, slots, first, length, columns, values = weights[namespace]
                tokens = part.column("tokens").combine_chunks()
                codes = pc.index_in(tokens.flatten(), vocabulary)
                codes = codes.fill_null(-1).to_numpy(zero_copy_only=False)
                dl = part.column("dl").to_numpy()
                owner = np.repeat(np.arange(part.num_rows), dl)
                known = codes >= 0
                pairs, tf = np.unique(
                    owner[known] * len(vocabulary) + codes[known], return_counts=True
                )
                doc, code = np.divmod(pairs, len(vocabulary))
                saturation = tf / (tf + k1 * (1 - b + b * dl[doc] / avgdl))

                entries = np.bincount(doc, length[code], minlength=part.num_rows).astype(np.int64)
                scores = np.empty((part.num_rows, len(slots)))
                for at, end in cuts(entries, MAX_ENTRIES):  # whole documents, so that no sum changes its order
                    own = slice(*np.searchsorted(doc, (at, end)))
                    repeats = length[code[own]]
                    entry = np.repeat(first[code[own]] - np.cumsum(repeats) + repeats, repeats)
                    entry += np.arange(len(entry))
                    cells = np.repeat(doc[own] - at, repeats) * len(slots) + columns[entry]
                    added = np.bincount(
                        cells,
                        np.repeat(saturation[own], repeats) * values[entry],
                        minlength=(end - at) * len(slots),
                    )
                    scores[at:end] = added.reshape(end - at, len(slots))
                doc_ids = part.column("doc_id").combine_chunks()
                yield best.rows(namespace, slots, doc_ids, scores, positive_only=True)

    return score


def _packed_weights(weights: pd.DataFrame, slot_of: pd.Series) -> dict[str, tuple]:
    """Per namespace what ``_block_scorer`` needs, from (query_id, namespace, term, weight, avgdl)."""
    weights = weights.assign(slot=weights["query_id"].map(slot_of)).sort_values(["namespace", "term"])
    packed = {}
    for namespace, part in weights.groupby("namespace", sort=False):
        new_term = part["term"].ne(part["term"].shift()).to_numpy()
        first = np.flatnonzero(new_term)
        slots, columns = np.unique(part["slot"].to_numpy(), return_inverse=True)
        packed[namespace] = (
            pa.array(part["term"].to_numpy()[first], pa.string()),
            float(part["avgdl"].iloc[0]),
            slots,
            first,
            np.diff(np.append(first, len(part))),
            columns,
            part["weight"].to_numpy(),
        )
    return packed


def _score_blocks(tokens: DataFrame, weights: DataFrame, k: int, settings: Settings) -> DataFrame:
    rows = weights.select("query_id", "namespace", "term", "weight", "avgdl").toArrow().to_pandas()
    ids = rows["query_id"].drop_duplicates()
    query_type = weights.schema["query_id"].dataType
    packed = _packed_weights(rows, pd.Series(range(len(ids)), index=ids.array))
    if len(packed) <= 1000:
        tokens = tokens.where(F.col("namespace").isin(*packed)) if packed else tokens.limit(0)
    doc_type = tokens.schema["doc_id"].dataType.simpleString()
    query_ids = id_array(ids.to_list(), query_type)
    return tokens.select("doc_id", "namespace", "dl", "tokens").mapInArrow(
        _block_scorer(tokens.sparkSession.sparkContext.broadcast((query_ids, packed)), k, settings.bm25_k1, settings.bm25_b),
        f"query_id {query_type.simpleString()}, namespace string, doc_id {doc_type}, score double",
    )


def _score_join(index: Bm25Index, weights: DataFrame, small: bool, settings: Settings) -> DataFrame:
    k1, b = settings.bm25_k1, settings.bm25_b
    keys = [c for c in ("namespace", "term", "term_bucket") if c in weights.columns]
    saturation = F.col("tf") / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return (
        index.term_rows()
        .join(hint_small(weights, small), keys)
        .groupBy("query_id", "namespace", "doc_id")
        .agg(F.sum(F.col("weight") * saturation).alias("score"))
        .where(F.col("score") > 0)
    )


def bm25_search(
    index: Bm25Index,
    queries: DataFrame | QueryBatch,
    k: int | None = None,
    settings: Settings | None = None,
) -> DataFrame:
    """(query_id, namespace, doc_id, score, rank): the best ``k`` positive scores per namespace.

    ``queries`` holds query_id, question and namespaces. Blank questions, questions without a word
    and empty namespaces yield no rows.
    """
    settings = settings or get_settings()
    k = settings.retriever_top_k if k is None else k
    batch = as_batch(queries)
    if index.postings is not None and batch.bounded and _most_terms(batch) <= MAX_BLOCK_WEIGHTS:
        index = index.pruned(_bucketed(query_terms(batch.df)))
    weights, rows = query_weights(index, batch, settings)
    if index.tokens is not None and batch.bounded and rows <= MAX_BLOCK_WEIGHTS:
        scored = _score_blocks(index.tokens, weights, k, settings)
    else:
        scored = _score_join(index, weights, rows <= MAX_BROADCAST_ROWS, settings)
    return top_k(scored, ["query_id", "namespace"], [by_score("score"), F.col("doc_id")], k)
