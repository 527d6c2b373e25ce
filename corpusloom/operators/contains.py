"""Which texts contain which of a set of passages, for sets of any size, in one pass over the texts per block."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PASSAGE_BYTES = 16 << 20


def containing(texts: DataFrame, passages: DataFrame, passage_bytes: int = PASSAGE_BYTES) -> DataFrame:
    """Rows of ``texts`` (with a ``text``) once for each passage (query_id, passage) in them, with its query_id.

    An automaton of all passages of a block walks through every text once. A block has about ``passage_bytes`` of
    passages and is sent to the tasks; more passages take more blocks, of the same plan. No text is
    shuffled or sent on. Null and empty passages are in no text.
    """
    spark = texts.sparkSession
    wanted = passages.where(F.length("passage") > 0).select("query_id", "passage")
    total = wanted.agg(F.coalesce(F.sum(F.octet_length("passage") + 16), F.lit(0))).first()[0]
    blocks = max(1, -(-total // passage_bytes))
    dealt = wanted.withColumn("_block", F.pmod(F.xxhash64("passage"), F.lit(blocks)))
    kept = [f for f in texts.schema.fields if f.name != "text"]
    schema = T.StructType([*kept, T.StructField("query_id", passages.schema["query_id"].dataType)])
    rows = texts.select(*[f.name for f in kept], "text")
    found = None
    for block in range(blocks):
        listed = dealt.where(F.col("_block") == block).select("query_id", "passage").toArrow()
        sent = spark.sparkContext.broadcast(listed)

        def scan(batches: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            of_passage: dict[str, list[int]] = {}
            for i, passage in enumerate(sent.value.column("passage").to_pylist()):
                of_passage.setdefault(passage, []).append(i)
            automaton = ahocorasick.Automaton()
            for passage in of_passage:
                automaton.add_word(passage, passage)
            if of_passage:
                automaton.make_automaton()
            for batch in batches if of_passage else ():
                row, query = [], []
                for i, text in enumerate(batch.column(len(kept))):
                    for passage in {p for _, p in automaton.iter(text.as_py() or "")}:
                        row += [i] * len(of_passage[passage])
                        query += of_passage[passage]
                ids = sent.value.column("query_id").combine_chunks().take(pa.array(query, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [*(c.take(pa.array(row, pa.int64())) for c in batch.columns[: len(kept)]), ids], names=[f.name for f in schema]
                )

        pairs = rows.mapInArrow(scan, schema)
        found = pairs if found is None else found.unionByName(pairs)
    return found
