import zlib

import numpy as np
import pytest

from corpusloom.llm import language, toxicity
from corpusloom.llm.queries import op3_subword_toxicity, op7_byte_network_language

SF = "/root/testdata/sf0.01"
ODD = [None, "", " \n", "12 34 !!", "é", "word " * 40_000, "dup of a text", "dup of a text"]
SCHEMA = "doc_id long, text string, lang string, score string, languages int"


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_languages_of_held_out_documents(spark, documents):
    rows = op7_byte_network_language(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(documents)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    out = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == documents[r.doc_id].lang for r in out]) > 0.95


def test_toxicity_of_held_out_documents(spark):
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = op3_subword_toxicity(spark, SF).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    assert all(r.predicted == int(r.score >= 0.3) for r in rows)
    out = [(r.predicted, toxic[r.doc_id]) for r in rows if r.held_out and r.doc_id in toxic]
    assert np.mean([p == t for p, t in out]) > 0.9


def odd(spark, lang="x"):
    return spark.createDataFrame([(i, t, lang if i % 2 else None, "s", 1) for i, t in enumerate(ODD)], SCHEMA)


def test_odd_texts_and_clashing_columns(spark):
    docs = odd(spark)
    rows = {r.doc_id: r for r in language.identify(docs, language.fit(docs)).collect()}
    assert [rows[i].lang_pred for i in range(len(ODD))] == ["und"] * 4 + ["x"] * 4
    labels = spark.createDataFrame([(i, i % 2, 3) for i in range(8)], "doc_id long, toxic int, text int")
    net = toxicity.fit(docs, labels, per_label=5)
    rows = {r.doc_id: r for r in toxicity.score(docs, net).collect()}
    assert len(rows) == len(ODD) and rows[0].score == rows[1].score == rows[2].score == 0
    assert rows[6].score == rows[7].score


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "ab", None, "s", 1)], SCHEMA)
    assert language.identify(docs, language.fit(docs)).collect()[0].lang_pred == "und"
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score(docs, toxicity.fit(docs, none)).collect()[0].score == 0
    empty = docs.filter("doc_id = 9")
    assert language.identify(empty, language.fit(docs)).collect() == []
    assert toxicity.score(empty, None).collect() == []


def test_windows_cover_whole_texts():
    texts = [b"", b"abc", bytes(range(1, 256)) * 3, b"x" * 512]
    offsets = np.cumsum([0] + [len(t) for t in texts])
    windows, rows = language.cut_windows(np.frombuffer(b"".join(texts), np.uint8), offsets, 256)
    assert rows.tolist() == [0, 1, 2, 2, 2, 3, 3]
    assert bytes(windows[1][:3]) == b"abc" and not windows[0].any() and not windows[1][3:].any()
    assert bytes(windows[4]) == texts[2][-256:]


def test_bags_equal_a_plain_reading():
    texts = [b"", b"Ab, ab C-d9 \xc3\xa9tait", b"  ", b"one two three one two three four", b"toolongword" * 3]
    offsets = np.cumsum([0] + [len(t) for t in texts])
    bags = toxicity.subword_bags(np.frombuffer(b"".join(texts), np.uint8), offsets, window=2)
    want, owners = [], []
    for i, text in enumerate(texts):
        words = text.translate(toxicity._WORD_BYTES).split()
        words = [w for k, w in enumerate(words) if k == 0 or w != words[k - 1]]
        for at in range(0, len(words), 2):
            padded = [b" " + w + b" " for w in words[at : at + 2]]
            want.append(sum(max(0, len(p) - n + 1) for p in padded for n in toxicity.GRAMS))
            owners.append(i)
    assert np.diff(bags.starts, append=len(bags.grams)).tolist() == want
    assert bags.texts.tolist() == owners


def test_misspellings_share_vectors():
    texts = ["you are an idiotic person here", "what a lovely and sunny day it is"] * 40
    data = "".join(texts).encode()
    offsets = np.cumsum([0] + [len(t) for t in texts])
    net = toxicity.train(np.frombuffer(data, np.uint8), offsets, np.array([1, 0] * 40), epochs=20)
    unseen = [b"she called him an idiotical", b"the sunnyish day was lovelyish"]
    bags = toxicity.subword_bags(np.frombuffer(b"".join(unseen), np.uint8), np.cumsum([0] + [len(t) for t in unseen]))
    odds = toxicity.window_odds(bags, net.evidence(), net.bias)
    assert odds[0] > 0 > odds[1]
