import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from corpusloom.llm import packing
from corpusloom.llm.packing import pack_documents, sum_of_squares
from corpusloom.llm.tokenize import WordTokens

SCHEMA = "doc_id long, text string, sequence_id string, group int"
TEXTS = [
    "", None, " \n\t", "a", "The idiot's don't, 12ab—«Über» ÉCOLE é É ﬁ", "<|endoftext|>x <|ENDOFTEXT|>",
    "x y z", "日本語 текст,*** 9.9%", "word " * 9000, "word " * 9000, "\x00\x1c a\x0b b", "'s 't n't,'s",
]


def load():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def direct(text):
    return load().encode(text or "", add_special_tokens=False).ids + [1]


@pytest.mark.parametrize("text", TEXTS)
def test_word_table_equals_the_tokenizer(text):
    got = np.frombuffer(WordTokens(load()).ids((text or "").encode()), "<u4").tolist()
    assert got == direct(text)[:-1]


def test_supplied_texts_tokenise_alike(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").limit(60).collect()
    table, tokenizer = WordTokens(load()), load()
    for row in rows:
        assert np.frombuffer(table.ids(row[0].encode()), "<u4").tolist() == tokenizer.encode(row[0], add_special_tokens=False).ids


def check(rows, texts):
    sequences, documents = {}, {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        documents.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at and length > 0
            at += length
        assert at <= 4096
    assert set(documents) == set(texts)
    for doc, pieces in documents.items():
        ids = direct(texts[doc])
        at = 0
        for k, (piece, start, length, crc) in enumerate(sorted(pieces)):
            assert (piece, start) == (k, at)
            assert crc == zlib.crc32(np.array(ids[at : at + length], "<u4").tobytes())
            assert length == 4096 or at + length == len(ids)
            at += length
        assert at == len(ids)
    return sequences


def test_pieces_round_trip(spark):
    docs = spark.createDataFrame([(i, t, "x", 7) for i, t in enumerate(TEXTS)], SCHEMA)
    check(pack_documents(docs, group_pieces=5).collect(), dict(enumerate(TEXTS)))


def test_empty_table(spark):
    assert pack_documents(spark.createDataFrame([], SCHEMA)).collect() == []


def test_supplied_documents_fill_their_sequences(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = pack_documents(docs).collect()
    used = len({r.sequence_id for r in rows})
    assert used <= np.ceil(sum(r.length for r in rows) / 4096) * 1.01


def test_rule_of_least_squares():
    """A plain reading of the rule: try every choice and count the squares."""
    rng = np.random.default_rng(5)
    sizes, capacity = rng.integers(1, 13, 300), 12
    bins, offsets = sum_of_squares(sizes, capacity)
    level = {}
    for size, bin_, offset in zip(sizes.tolist(), bins.tolist(), offsets.tolist()):
        def squares(choice):
            after = dict(level)
            after[choice] = after.get(choice, 0) + size
            gaps = np.bincount([capacity - v for v in after.values()], minlength=capacity + 1)
            return int((gaps[1:] ** 2).sum())

        options = [b for b, v in level.items() if v + size <= capacity] + [len(level)]
        assert squares(bin_) == min(map(squares, options))
        assert level.get(bin_, 0) == offset
        level[bin_] = offset + size


def test_groups_are_counted_in_pieces(spark, monkeypatch):
    seen = []
    place = packing.pack
    monkeypatch.setattr(packing, "pack", lambda pieces, groups, capacity: seen.append(groups) or place(pieces, groups, capacity))
    docs = spark.createDataFrame([(1, "some words of a long text " * 40)], "doc_id long, text string")
    rows = packing.pack_documents(docs, capacity=8, group_pieces=4).collect()
    assert seen == [-(-len(rows) // 4)] and seen[0] > 1


def test_rows_without_id_are_dealt_to_all_groups(spark):
    docs = spark.createDataFrame([(None, "the same text")] * 300 + [(i, "the same text") for i in range(100)], "doc_id long, text string")
    rows = packing.pack_documents(docs.repartition(8), capacity=64, group_pieces=40).collect()
    groups = {}
    for r in rows:
        groups[r.sequence_id % 10] = groups.get(r.sequence_id % 10, 0) + r.length
    assert len(rows) == 400 and len(groups) == 10 and max(groups.values()) < 3 * min(groups.values())


def test_word_cores_outlive_the_word_table(monkeypatch):
    from corpusloom.llm import tokenize

    monkeypatch.setattr(tokenize, "MAX_WORDS", 8)
    tokens = tokenize.word_tokens("word_bpe_49k.json")
    tokens.clear()
    tokens._cores.clear()
    first = tokens.ids(b"alpha. alpha, alpha! alpha? alpha; alpha: alpha) alpha] alpha}")
    assert tokens.ids(b"") == b"" and not tokens
    assert b"alpha" in tokens._cores
    assert tokens.ids(b"alpha. alpha, alpha! alpha? alpha; alpha: alpha) alpha] alpha}") == first
