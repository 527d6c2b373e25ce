"""What Python workers, which live on from task to task, hold of their executor's memory."""

import pickle

from pyspark import cloudpickle
from pyspark.sql import functions as F

from corpusloom.llm import batches, language, packing, tokenize


def test_a_text_travels_once(spark):
    docs = spark.createDataFrame([(1, "ein Text", "de"), (2, "a text", "en"), (3, None, "en")], "doc_id long, text string, lang string")
    net = language.fit(docs.withColumn("doc_id", F.lit(0)))
    assert net is not None
    found = language.classify(docs, net)
    sent = found._jdf.queryExecution().optimizedPlan().children().apply(0).output()
    assert [sent.apply(i).name() for i in range(sent.size())].count("text") == 1
    assert sent.size() == len(docs.columns) + 1  # the letters
    assert [r.text for r in found.orderBy("doc_id").collect()] == ["ein Text", "a text", None]
    # a text of another type is sent as a string beside it
    numbers = docs.withColumn("text", F.col("doc_id")).select("doc_id", "text", "lang")
    assert [(r.text, r._lang_pred) for r in language.classify(numbers, net).orderBy("doc_id").collect()] == [(i, "und") for i in (1, 2, 3)]


def test_another_operator_drops_the_word_tables():
    """The tables of packing stayed while the next run of the pipeline identified languages."""
    arrive = lambda scan: pickle.loads(cloudpickle.dumps(scan))  # noqa: E731  as in a worker
    tokenize.word_tokens(packing.TOKENIZER).ids(b"some words")
    assert list(arrive(batches.giving_back(iter, tokenize.KEPT))([1, 2])) == [1, 2]
    assert tokenize.KEPT in batches._KEPT
    assert list(arrive(batches.giving_back(iter))([1, 2])) == [1, 2]
    assert not batches._KEPT
    assert len(tokenize.word_tokens(packing.TOKENIZER).ids(b"some words")) >= 8
