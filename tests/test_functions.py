import fnmatch
import hashlib
import random
import re
import struct
import uuid

import pytest
from pyspark.sql import functions as F

from corpusloom import workload
from corpusloom.functions import ids, sse, text, vectors
from corpusloom.functions.globs import matches_any_glob


def column(spark, values, make, kind="string"):
    df = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}")
    return [r[0] for r in df.select("i", make(F.col("v")).alias("out")).orderBy("i").select("out").collect()]


def test_tokenize(spark):
    cases = ["Hello, World!", "register_hook", "nn.Conv2d x", "", "?! ...", "Straße ÉTÉ ñandú_2 中文 ٣"]
    assert column(spark, cases, text.tokenize) == [
        [w.lower() for w in re.findall(r"\w+", case)] for case in cases
    ]


def test_term_counts(spark):
    got = column(spark, ["b a b c b a", "", "x"], lambda c: text.term_counts(text.tokenize(c)))
    assert [[tuple(p) for p in row] for row in got] == [[("a", 2), ("b", 3), ("c", 1)], [], [("x", 1)]]


def test_split_lines(spark):
    rng = random.Random(1)
    alphabet = ["a", " ", "\n", "\r", "\r\n", "\x0b", "\x0c", "\x1c", "\x85", " ", " "]
    cases = ["", "\n", "a\n", "a\n\n"] + ["".join(rng.choices(alphabet, k=12)) for _ in range(200)]
    assert column(spark, cases, text.split_lines) == [case.splitlines() for case in cases]


def test_strip(spark):
    cases = ["  a b ", "　x\x1f", "\x85 y\t", "", " \t", "\xa0q\xa0"]
    assert column(spark, cases, text.strip) == [case.strip() for case in cases]


@pytest.mark.parametrize(
    ("raw", "clean"),
    [
        (":func:`run`", "run"),
        (":py:meth:`A.b`", "A.b"),
        (":class:`~pkg.mod.Thing`", "pkg.mod.Thing"),
        (":ref:`the label <target-x>`", "the label"),
        (":doc:` Guide  <a/b> `", "Guide"),
        (":ref:`~odd <t>`", "~odd"),
        (":ref:`<only-target>`", "<only-target>"),
        (":kbd:`a<b`", "a<b"),
        ("x :mod:`os` y :envvar:`HOME`.", "x os y HOME."),
        (":unknown:`X`", ":unknown:`X`"),
        (":class:`open end", ":class:`open end"),
        (":class:``", ":class:``"),
        ("``plain`` *em* `one`", "``plain`` *em* `one`"),
    ],
)
def test_clean_roles(spark, raw, clean):
    assert column(spark, [raw, clean], text.clean_roles) == [clean, clean]


def test_suffix_and_stem(spark):
    paths = ["a/b.py", "x.tar.gz", ".md", "d.x/README", "a/.hidden.rst", "A.PY"]
    assert column(spark, paths, text.suffix) == [".py", ".gz", "", "", ".rst", ".PY"]
    assert column(spark, paths, text.stem) == ["b", "x.tar", ".md", "README", ".hidden", "A"]


def test_decode_utf8(spark):
    cases = [b"ok\r\nx\ry", b"\xff\xfeA", b"\xe2\x82", "é".encode()]
    expected = [c.decode("utf-8", "replace").replace("\r\n", "\n").replace("\r", "\n") for c in cases]
    assert column(spark, [bytearray(c) for c in cases], text.decode_utf8, "binary") == expected


def _glob(path, pattern):
    def walk(parts, pats):
        if not pats:
            return not parts
        if pats[0] == "**":
            return any(walk(parts[i:], pats[1:]) for i in range(len(parts) + 1))
        return bool(parts) and fnmatch.fnmatchcase(parts[0], pats[0]) and walk(parts[1:], pats[1:])

    return walk(path.split("/"), pattern.split("/"))


def test_globs_match_brute_force(spark):
    rng = random.Random(7)
    names = ["a", "b.py", "ab", "c.lock", "A", "x+y", "n[1]", "-"]
    patterns = ["**", "a/**", "**/a/**", "*.lock", "a/b?py", "**/*.py", "a/**/b.py", "[ab]*", "[!a]*", "**/ab",
                "a", "x+y", "a.b", "[a-c].lock", "**/**", "n[[]1]", "[", "*"]
    paths = ["/".join(rng.choices(names, k=rng.randint(1, 4))) for _ in range(120)]
    for pattern in patterns:
        got = column(spark, paths, lambda c, p=pattern: matches_any_glob(c, [p]))
        assert got == [_glob(path, pattern) for path in paths], pattern
    assert not any(column(spark, paths, lambda c: matches_any_glob(c, [])))
    both = column(spark, paths, lambda c: matches_any_glob(c, ["*.lock", "a/**"]))
    assert both == [_glob(p, "*.lock") or _glob(p, "a/**") for p in paths]


def test_uuid5_and_cache_key(spark):
    names = ["x", "ns|a/b.py|f|1-2", "é"] + [str(i) for i in range(50)]
    assert column(spark, names, ids.uuid5_oid) == [str(uuid.uuid5(uuid.NAMESPACE_OID, n)) for n in names]
    key = "embed:bge-base-en-v1.5:" + hashlib.sha256(b"x").hexdigest()
    assert column(spark, ["x"], lambda c: ids.cache_key(c, "BAAI/bge-base-en-v1.5")) == [key]


def test_mock_embedding(spark):
    for dim in (3, 8, 20):
        got = column(spark, ["", "abc", "é"], lambda c, d=dim: vectors.mock_embedding(c, d))
        for value, vector in zip(["", "abc", "é"], got, strict=True):
            words = struct.unpack("<8i", hashlib.sha256(value.encode()).digest())
            expected = [words[i % 8] / 2**31 for i in range(dim)]
            assert vector == pytest.approx(expected, abs=1e-7)


def test_sse_fields(spark):
    lines = ["event: token", "data:  two", "data", ":comment", "", "a:b:c"]
    got = column(spark, lines, sse.parse_field)
    assert [tuple(r) if r else None for r in got] == [
        ("event", "token"), ("data", " two"), ("data", ""), None, None, ("a", "b:c"),
    ]


def test_sse_stream(spark):
    body = (
        'event: retrieved\ndata: {"chunks": []}\n\n: ping\n\nevent: token\ndata: one\ndata: more\n\n'
        "event: token\ndata:  x\n\nevent: done\ndata: \n\nevent: token\ndata: late\n\n"
    )
    df = spark.createDataFrame([(1, body)], "id int, body string")
    got = [tuple(r) for r in sse.stream_events(df, "id").orderBy("seq").collect()]
    assert [(e, d) for _, _, e, d in got][:4] == [
        ("retrieved", '{"chunks": []}'), ("token", "one\nmore"), ("token", " x"), ("done", ""),
    ]
    assert tuple(sse.answer_text(df, "id").first()) == (1, '{"chunks": []}', "one\nmore x")


def test_all_roles_are_put_into_whole_texts_and_taken_out(spark):
    sf = "/root/testdata/sf0.001"
    texts = {str(r.doc_id): r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = workload.clean_all_roles(spark, sf).collect()
    assert {r.doc_id: r.text for r in rows} == texts and any("\n" in t for t in texts.values())
    for r in rows:
        assert r.marked == any(w.isalpha() for line in texts[r.doc_id].split("\n") for w in line.split(" "))
