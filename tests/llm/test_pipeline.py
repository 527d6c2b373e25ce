import random
import re
import zlib

import pytest
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))

from test_decontaminate import brute as hits
from test_neardup import brute as copies
from test_packing import check
from test_secrets import base

import corpus_pipeline

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows that each stage makes of those of the one before."""
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = [(90_000, "12 34 !!", "en", "s", 8), (90_001, None, None, "s", None), (90_002, "key token = \"0123456789abcdef\" end of it", "en", "s", 40)]
    docs = docs.unionAll(spark.createDataFrame([*extra, extra[2]], docs.schema))
    found = {"documents": docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        found[name] = docs.collect()
        if name != "pack":
            assert docs.columns == COLUMNS
    return found


def by_id(rows):
    return {r.doc_id: r.text for r in rows}


def test_language_rejects_texts_without_letters(stages):
    assert {r.doc_id for r in stages["documents"]} - {r.doc_id for r in stages["language_id"]} == {90_000, 90_001}


def test_one_of_each_group_stays(stages):
    want = {i for i, (_, _, kept) in copies(by_id(stages["language_id"])).items() if kept}
    got = [r.doc_id for r in stages["near_dedup"]]
    assert sorted(got) == sorted(want)


def test_passages_are_cut_and_the_rest_is_kept(spark, stages):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before, after = by_id(stages["near_dedup"]), by_id(stages["decontaminate"])
    for doc, text in before.items():
        n_words, n_hit, *_ = hits(text, items, 10)
        if n_hit:
            left = after.get(doc, "")
            assert hits(left, items, 10)[1] == 0
            assert hits(left, items, 10)[0] >= n_words - n_hit - 1
        else:
            assert after[doc] == text


def test_secrets_are_masked(stages):
    before, after = by_id(stages["decontaminate"]), by_id(stages["mask_secrets"])
    assert set(before) == set(after) and any("[SECRET]" in t for t in after.values())
    for doc, text in before.items():
        assert not base(after[doc])
        if not base(text) and not re.search(r"[A-Za-z0-9+/_-]{20}", text):
            assert after[doc] == text


def test_packed_pieces_give_back_the_texts(stages):
    assert all(r.n_chars == len(r.text) for r in stages["mask_secrets"])
    check(stages["pack"], by_id(stages["mask_secrets"]))


def test_run_is_the_stages_in_order(spark, stages):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in stages["pack"]} - {90_002}


def test_null_and_shared_ids_are_judged_row_by_row(spark):
    text = lambda seed: " ".join(f"{seed}{i}" for i in range(60))
    near = lambda seed: text(seed) + " more"
    rows = [(None, text("a")), (None, text("b")), (None, near("b")), (None, text("b")), (5, text("c")), (None, near("c"))]
    rows += [(7, text("d")), (7, near("d")), (8, text("e")), (8, near("c")), (9, text("e") + " end")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], spark.read.parquet(f"{SF}/documents.parquet").schema)
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()), key=str)
    assert len(got) == len(set(got)) == 5
    assert {(None, text("a")), (5, text("c")), (8, text("e"))} < set(got)
    assert len({(None, text("b")), (None, near("b"))} & set(got)) == 1
    assert len({(7, text("d")), (7, near("d"))} & set(got)) == 1


def test_unlabelled_documents_stay(spark):
    docs = spark.createDataFrame(
        [(1, "words of a text", None, "s", 15), (2, "12 34", None, "s", 5), (None, "h\u00e9", None, "s", 2), (4, None, None, "s", None)],
        spark.read.parquet(f"{SF}/documents.parquet").schema,
    )
    assert {(r.doc_id, r.text) for r in corpus_pipeline.language_id(spark, docs, SF).collect()} == {(1, "words of a text"), (None, "h\u00e9")}


def test_texts_without_language_go(spark):
    """A network of two languages rejects what it finds equally unlike both; labelled texts stay."""
    rows = [(i, "the cat and the dog sat on the mat with that " * 3, "en", "s", 0) for i in range(60)]
    rows += [(100 + i, "der hund und die katze sitzen auf dem dach und " * 3, "de", "s", 0) for i in range(60)]
    docs = spark.createDataFrame(rows, spark.read.parquet(f"{SF}/documents.parquet").schema)
    assert corpus_pipeline.language_id(spark, docs, SF).count() == 120
    net = corpus_pipeline.language.fit(docs)
    flat = corpus_pipeline.language.ByteNetwork(net.languages, net.embedding, net.filters, net.bias, 0 * net.dense, 0 * net.offset)
    fit = corpus_pipeline.language.fit
    corpus_pipeline.language.fit = lambda docs: flat  # its best share is an even one
    try:
        assert corpus_pipeline.language_id(spark, docs, SF).count() == 0
    finally:
        corpus_pipeline.language.fit = fit


CLASHING = ["_text", "_letters", "_lang_pred", "_lang_score", "_row", "component_id", "_spans", "_base", "_candidates", "_n_words", "_items", "others", "best", "kept", "c0"]


@pytest.mark.parametrize("count", [0, 40])
def test_clashing_columns_and_empty_tables(spark, count):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(count)
    for name in CLASHING:
        docs = docs.selectExpr("*", f"concat('{name}', doc_id) AS `{name}`")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        rows = out.collect()
        if name != "pack":
            assert out.columns == docs.columns
            assert all(r[c] == f"{c}{r.doc_id}" for r in rows for c in CLASHING)
        assert bool(rows) == bool(count)


WORDS = {
    "en": "the of and to in that was his with as had for she they this have from which one were would there been what will when who out".split(),
    "de": "der die und den von das nicht ist mit sich des auf eine auch werden wird dem haben nach einer durch wurde zwischen über können schon".split(),
}


def test_texts_of_no_learned_language_go_and_the_others_get_theirs(spark):
    """Garbage and other scripts go, labelled or not; a text without a label gets the language that is identified."""
    rng = random.Random(4)
    prose = lambda lang: " ".join(rng.choice(WORDS[lang]) for _ in range(rng.randrange(8, 60))).capitalize() + "."
    rows = [(i, prose(lang), lang) for i, lang in enumerate(["en", "de"] * 150)]
    rows += [(1000 + i, prose(lang), None) for i, lang in enumerate(["en", "de"] * 20)]
    letters = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    none = ["Все люди рождаются свободными и равными в своем достоинстве и правах. " * 4, "すべての人間は、生まれながらにして自由であり、" * 6]
    none += [" ".join(letters(rng.randrange(3, 9)) for _ in range(50)), "".join(rng.choices("0123456789abcdef", k=400))]
    rows += [(2000 + i, text, None) for i, text in enumerate(none)]
    rows += [(next(i for i in range(3000, 4000) if zlib.crc32(b"%d" % i) % 3 == 1), none[2][::-1], "en")]  # one that is not learned
    docs = spark.createDataFrame([(i, t, x, "s", len(t)) for i, t, x in rows], spark.read.parquet(f"{SF}/documents.parquet").schema)
    got = {r.doc_id: r for r in corpus_pipeline.language_id(spark, docs, SF).collect()}
    assert sorted(got) == [i for i, _, _ in rows if i < 2000]
    assert all(got[i].lang == x and got[i].text == t for i, t, x in rows[:300])
    assert [got[1000 + i].lang for i in range(40)] == ["en", "de"] * 20
