"""The plans themselves: what is pushed down, cut early, broadcast or reused."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from conftest import SF
from corpusloom import workload as w
from corpusloom.workload import QUERIES
from corpusloom.workload_sql import SQL
from corpusloom.operators import bm25 as bm
from corpusloom.operators.blocks import PartialTopK, by_namespace
from corpusloom.operators.ranking import top_k
from corpusloom.sources.chunk_store import ChunkStore


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_top_k_is_cut_before_the_shuffle(spark):
    df = spark.range(100).withColumn("g", F.col("id") % 3)
    text = plan(top_k(df, ["g"], [F.col("id").desc()], 5))
    assert re.search(r"WindowGroupLimit.*Final[\s\S]*Exchange[\s\S]*WindowGroupLimit.*Partial", text)


def test_bm25_scoring_shuffles_hits_only(spark):
    corpus = spark.read.parquet(f"{SF}/documents.parquet").select(
        F.col("doc_id").cast("string").alias("doc_id"), F.col("lang").alias("namespace"), "text"
    )
    hits = bm.bm25_search(bm.Bm25Index.build(corpus), w.requests(spark, SF), 10)
    text = plan(hits)
    assert text.count("Exchange") == 1
    assert "In(lang" in text or "lang" in text.split("PushedFilters")[1]
    assert "ReadSchema: struct<doc_id:bigint,text:string,lang:string>" in text


def test_written_index_opens_only_the_buckets_of_its_terms(spark, tmp_path):
    bm.Bm25Index.build(w.chunks(spark, SF)).write(str(tmp_path))
    index = bm.Bm25Index.read(spark, str(tmp_path))
    query = spark.createDataFrame([(1, "the of", ["en"])], "query_id long, question string, namespaces array<string>")
    text = plan(bm.bm25_search(index, query, 5))
    scan = next(line for line in text.splitlines() if "FileScan" in line and "tf#" in line)
    assert re.search(r"PartitionFilters: \[[^\]]*term_bucket", scan) and re.search(r"PartitionFilters: .*namespace", scan)
    assert re.search(r"PushedFilters: .*(In|EqualTo)\(term", scan)


def test_statistics_are_computed_once(spark):
    index = bm.Bm25Index.build(w.chunks(spark, SF))
    means = index.means
    means.collect()
    text = plan(means)
    assert "ReusedExchange" in text


def test_hydration_does_not_move_texts(spark):
    text = plan(w.hybrid_search_hydrated(spark, SF))
    top = text[: text.index("FileScan")]
    assert "BroadcastHashJoin [namespace" in top and "SortMergeJoin" not in text


def test_store_opens_only_the_asked_namespace(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path))
    rows = [("1", "a", "f", "s", "t"), ("2", "b", "f", "s", "t")]
    schema = "doc_id string, namespace string, file_path string, commit_sha string, text string"
    store.upsert(spark.createDataFrame(rows, schema))
    text = plan(store.read("a").select("doc_id"))
    assert re.search(r"PartitionFilters: \[[^\]]*namespace[^\]]*= a", text)
    assert "text:string" not in text.split("ReadSchema")[1]


def test_partial_top_k_bounds_copies():
    import numpy as np
    import pyarrow as pa

    best = PartialTopK(pa.array(["q"]), 3)
    rng = np.random.default_rng(1)
    seen = []
    for part in range(4):
        ids = [f"{i:04d}" for i in range(part * 100, part * 100 + 100)]
        scores = np.where(rng.random(100) < 0.4, 1.0, rng.random(100))[:, None]
        out = best.rows("n", np.array([0]), pa.array(ids), scores)
        assert out.num_rows <= 3
        seen += list(zip(ids, scores[:, 0], strict=True))
        if part == 0:
            first = out.column("doc_id").to_pylist()
            assert first == [i for i, _ in sorted(seen, key=lambda p: (-p[1], p[0]))[:3]]


def test_by_namespace_splits_and_orders():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"namespace": list("babca"), "doc_id": ["5", "4", "1", "3", "2"]})
    parts = [(n, p.column("doc_id").to_pylist()) for n, p in by_namespace(batch, {"a", "b"}, 1)]
    assert parts == [("a", ["2", "4"]), ("b", ["1", "5"])]


def test_entry_and_oracle_names(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(SQL) == set(QUERIES)  # only training-data queries may go without SQL


@pytest.mark.parametrize("name", ["sync_plain", "event_parsing", "point_ids", "glob_filter", "token_costs"])
def test_registered_queries_equal_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    df = entry.queries()[name](spark, SF)
    result = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(repr, (tuple(r[c] for c in columns) for r in df.collect()))) == sorted(
        map(repr, result.fetchall())
    )
