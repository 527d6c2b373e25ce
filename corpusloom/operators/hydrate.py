"""From ranked ids to full chunks, and from those to the client's view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.config import SNIPPET_CHARS
from corpusloom.operators.bounds import hint_small

#: 1 MB of bits: of a million ids about one other in twenty passes, of a hundred thousand one in two thousand.
FILTER_WORDS = 1 << 17


def _text_or(name: str, default: str = "") -> Column:
    return F.coalesce(F.nullif(F.col(name).cast("string"), F.lit("")), F.lit(default))


def _number_text(name: str) -> Column:
    """A number as text; 0 counts as missing."""
    return F.coalesce(F.nullif(F.col(name).cast("string"), F.lit("0")), F.lit(""))


def _bits(keys: list[str], words: int) -> list[Column]:
    """Two bits of a key, from the halves of its hash, in a table of ``words`` 64-bit words, a power of two."""
    key = F.xxhash64(*keys)
    return [half.bitwiseAND(F.lit(64 * words - 1)) for half in (key, F.shiftrightunsigned(key, 32))]


def key_filter(wanted: DataFrame, keys: list[str], words: int = FILTER_WORDS) -> Column:
    """A condition that every key of ``wanted`` meets, and few others: a bloom filter of fixed size, made by one
    aggregation and read where the other table is scanned. More keys than it was made for only let more rows through."""
    bits = wanted.select(F.explode(F.array(*_bits(keys, words))).alias("bit"))
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit").bitwiseAND(F.lit(63)).cast("int"))
    set_words = bits.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(mask).alias("mask"))
    every = wanted.sparkSession.range(words).withColumnRenamed("id", "word")
    dense = every.join(set_words, "word", "left").select(F.struct("word", F.coalesce("mask", F.lit(0).cast("long")).alias("mask")).alias("entry"))
    table = dense.agg(F.transform(F.array_sort(F.collect_list("entry")), lambda e: e["mask"])).scalar()
    tests = [
        F.call_function("shiftright", F.get(table, F.shiftright(bit, 6).cast("int")), bit.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1
        for bit in _bits(keys, words)
    ]
    return tests[0] & tests[1]


def hydrate(ranked: DataFrame, chunks: DataFrame, small: bool) -> DataFrame:
    """Payload columns and the metadata map for ranked ids; ids without a chunk are dropped.

    Texts move for hits only. ``small`` says that the ranked side is bounded (queries x top_k was checked): then the chunk
    table is joined where it lies. Otherwise the scan of the chunks keeps, by a filter of the ranked ids, the
    hits and few others, which are shuffled to meet them; ``ranked`` is read twice.
    """
    wanted = ranked.select("query_id", "namespace", "doc_id", "score", "rank")
    keys = ["namespace", "doc_id"]
    if not small:
        chunks = chunks.where(key_filter(wanted, keys))
    found = chunks.join(hint_small(wanted, small), keys)
    metadata = F.create_map(
        F.lit("heading_path"), _text_or("heading_path"),
        F.lit("language"), _text_or("language"),
        F.lit("commit_sha"), _text_or("commit_sha"),
        F.lit("start_line"), _number_text("start_line"),
        F.lit("end_line"), _number_text("end_line"),
    )
    return found.select(
        "query_id",
        "rank",
        "score",
        "doc_id",
        "namespace",
        _text_or("file_path").alias("path"),
        _text_or("symbol").alias("symbol"),
        _text_or("chunk_type", "doc").alias("chunk_type"),
        _text_or("text").alias("text"),
        metadata.alias("metadata"),
    )


def chunk_summary(hydrated: DataFrame, snippet_chars: int = SNIPPET_CHARS) -> DataFrame:
    """What a client sees of a chunk: a snippet and integer line numbers (or null)."""
    meta = F.col("metadata")
    return hydrated.select(
        "query_id",
        "rank",
        "namespace",
        F.col("path").alias("file_path"),
        "symbol",
        F.coalesce(meta["heading_path"], F.lit("")).alias("heading_path"),
        "score",
        F.substring("text", 1, snippet_chars).alias("snippet"),
        meta["start_line"].try_cast("int").alias("start_line"),
        meta["end_line"].try_cast("int").alias("end_line"),
        "chunk_type",
    )


def display_rows(hits: DataFrame, limit: int = 10) -> DataFrame:
    """The inspection table of a ranking: namespace, first 8 characters of the id, score."""
    return hits.where(F.col("rank") < limit).select(
        "query_id",
        "rank",
        F.col("namespace").alias("ns"),
        F.substring("doc_id", 1, 8).alias("doc_id"),
        "score",
    )


def chunk_title(namespace: Column, file_path: Column, heading_path: Column) -> Column:
    tail = F.when(heading_path != "", F.concat(file_path, F.lit(" > "), heading_path))
    return F.concat(F.lit("["), namespace, F.lit("] "), tail.otherwise(file_path))
