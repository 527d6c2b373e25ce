import pytest
from pyspark.sql import functions as F

from corpusloom.functions.ids import cache_key
from corpusloom.operators.hydrate import hydrate, key_filter
from corpusloom.sources.embedding_cache import EmbeddingCache

TEXTS = "doc_id string, text string"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_last_stored_vector_of_a_key_counts_once(spark, tmp_path):
    cache = EmbeddingCache(spark, str(tmp_path), "org/model-a", buckets=4)
    keys = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "a")], TEXTS).select(cache_key(F.col("text"), "org/model-a").alias("cache_key"))
    for value in (1.0, 2.0):
        cache.store(keys.withColumn("vector", F.array(F.lit(value))))
    cache.store(keys.limit(1).withColumn("vector", F.array(F.lit(3.0))))
    cache.store(spark.createDataFrame([(None, [9.0])], "cache_key string, vector array<double>"))
    assert cache.read().count() == 2
    chunks = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "a"), ("4", None), ("5", "new")], TEXTS)
    got = {r.doc_id: r.embedding for r in cache.lookup(chunks).collect()}
    assert got == {"1": [3.0], "2": [2.0], "3": [3.0], "4": None, "5": None}
    again = EmbeddingCache(spark, str(tmp_path), "org/model-a", buckets=4)
    assert again.lookup(chunks).count() == 5 and EmbeddingCache(spark, str(tmp_path), "org/model-b", buckets=4).read().count() == 0


def test_null_texts_are_not_encoded(spark, tmp_path):
    cache = EmbeddingCache(spark, str(tmp_path), "org/model-c", buckets=4)

    @F.udf("array<float>")
    def strict(text):
        if text is None:
            raise ValueError("null text")
        return [float(len(text))]

    chunks = spark.createDataFrame([("1", "abc"), ("2", None), ("3", "")], TEXTS)
    assert {r.doc_id: r.embedding for r in cache.embed(chunks, strict).collect()} == {"1": [3.0], "2": None, "3": [0.0]}


def test_the_cache_is_not_shuffled(spark, tmp_path):
    cache = EmbeddingCache(spark, str(tmp_path), "org/model-d", buckets=8)
    chunks = spark.range(50).select(F.col("id").cast("string").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    cache.embed(chunks, lambda text: F.array(F.length(text).cast("float"))).count()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = cache.lookup(chunks)
        text = plan(found)
        assert text.count("Exchange") == 1 and "SelectedBucketsCount: 8 out of 8" in text
        assert found.where("embedding is null").count() == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


HITS = "query_id long, namespace string, doc_id string, score double, rank int"
FIELDS = ("file_path", "symbol", "chunk_type", "heading_path", "language", "commit_sha", "start_line", "end_line")


def corpus(spark, count):
    chunks = spark.range(count).select(F.concat(F.lit("d"), "id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("namespace"), F.repeat(F.lit("t"), 50).alias("text"))
    return chunks.select("*", *[F.lit(None).cast("string").alias(name) for name in FIELDS])


@pytest.mark.parametrize("words", [1 << 4, 1 << 12])
def test_filter_keeps_all_keys_and_few_others(spark, words):
    chunks = corpus(spark, 3000)
    wanted = chunks.where("pmod(hash(doc_id), 60) = 1").select("namespace", "doc_id")
    kept = chunks.where(key_filter(wanted, ["namespace", "doc_id"], words))
    assert kept.join(wanted, ["namespace", "doc_id"], "left_semi").count() == wanted.count()
    if words > 1000:
        assert kept.count() <= wanted.count() + 5
    assert chunks.where(key_filter(wanted.where("false"), ["namespace", "doc_id"], words)).count() == 0


def test_texts_move_for_hits_only(spark, tmp_path):
    """Five thousand questions: below the shuffle the scan is filtered, and the rows are those of the plain join."""
    corpus(spark, 4000).write.parquet(f"{tmp_path}/chunks")
    chunks = spark.read.parquet(f"{tmp_path}/chunks")
    ranked = spark.range(5000).select(
        F.col("id").alias("query_id"), F.lit("a").alias("namespace"), F.concat(F.lit("d"), F.col("id") % 40).alias("doc_id"), F.lit(0.5).alias("score"), F.lit(0).alias("rank")
    )
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = hydrate(ranked, chunks, small=False)
        lines = plan(found).splitlines()
        scan = next(i for i, line in enumerate(lines) if "FileScan" in line and ",text#" in line)
        at = max(i for i in range(scan) if "+- Filter (" in lines[i])
        assert "Subquery" in lines[at] and "Exchange hashpartitioning" in lines[at - 1]
        assert sorted(found.collect()) == sorted(hydrate(ranked, chunks, small=True).collect())
        assert found.count() == 2500
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
