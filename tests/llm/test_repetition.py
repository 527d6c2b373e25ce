import random
import re

from corpusloom.llm.repetition import repetition_rules

SCHEMA = "doc_id long, text string, n_words int, kept string"


def covered(words, size):
    """Positions in windows of ``size`` words that occur twice or more."""
    seen, marked = {}, set()
    for at in range(len(words) - size + 1):
        seen.setdefault(tuple(words[at : at + size]), []).append(at)
    for places in seen.values():
        if len(places) > 1:
            for at in places:
                marked.update(range(at, at + size))
    return marked


def brute(text, min_repeat, percent, longest_allowed):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    repeat = len(covered(words, 3))
    longest = 0
    while len(covered(words, longest + 1)) and longest < len(words):
        longest += 1
    cover = len(covered(words, min_repeat))
    failed = len(words) < 50 or 100 * repeat > 50 * len(words)
    kept = not failed and 100 * cover <= percent * len(words) and longest <= longest_allowed
    base = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), repeat)
    return (*base, failed, kept, cover, longest if longest >= 3 else 0)


def texts():
    rng = random.Random(9)
    word = lambda: rng.choice(["a", "b", "ç", "dd", "#*", "日本"])
    rows = [None, "", " \n\t", "a", "a a a a", "x\x0by\x0cz\x85q r", "l\n\nl\n l\nl", "w " * 500]
    rows += ["".join(word() + rng.choice("  \n") for _ in range(rng.randint(0, 160))) for _ in range(40)]
    base = [f"w{i}" for i in range(400)]
    rows += [" ".join(base[:200] + base[50:65] + base[200:]), " ".join(base[:300] + base[:120]), " ".join(base + base[10:130])]
    return rows + rows[-2:]


def compare(spark, rows, **options):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(rows)], SCHEMA).repartition(3)
    got = {r.doc_id: tuple(r)[1:] for r in repetition_rules(docs, **options).collect()}
    limits = {"min_repeat": 8, "max_covered_percent": 30, "max_longest": 100} | options
    assert got == {i: brute(t, limits["min_repeat"], limits["max_covered_percent"], limits["max_longest"]) for i, t in enumerate(rows)}


def test_equals_brute_force(spark):
    compare(spark, texts())
    compare(spark, texts(), min_repeat=4, max_covered_percent=5, max_longest=14)


def test_supplied_documents(spark):
    compare(spark, [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()])


def test_empty_table(spark):
    assert repetition_rules(spark.createDataFrame([], SCHEMA)).collect() == []
