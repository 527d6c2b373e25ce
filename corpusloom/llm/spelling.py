"""Grouping of spelling variants with a dictionary of pairs of trie nodes.

The words form a trie and, read backwards, another; the nodes of both are numbered. A word is then a row of pairs
(prefix node, suffix node). Two words that differ in one replaced letter share the pair around it; a word that lacks one
letter of another has the pair that the other has around that letter. So neighbours meet on two whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.batches import release, use_shared_folder

#: Letters of a word, and every how many hashed runs one letter is left out.
LETTERS = r"[A-Za-zÀ-ÿ]"
SLIPS = 199
MIN_LETTERS = 6
MIN_COUNT = 5
#: A form is at least so many times as frequent as its variant.
FACTOR = 5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Numbers given in one partition: 2**40 nodes or words in each of 2**23 partitions.
_PART_BITS = 40


def word_counts(
    docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", slips: int = SLIPS, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT
) -> DataFrame:
    """(word, n): runs of letters, A-Z lowered, with their occurrences. Of a run whose hash with the document's id is
    divisible by ``slips`` one letter is left out; a null id counts as empty. Runs shorter than a word never make one."""
    text = F.col(text_column).cast("string")
    pattern = F.lit(f"({LETTERS}{{{min_letters},}})")
    runs = docs.select(F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("doc"), F.explode(F.regexp_extract_all(text, pattern, F.lit(1))).alias("run"))
    runs = runs.withColumn("run", F.when(F.col("run").rlike("[A-Z]"), F.translate("run", _UPPER, _LOWER)).otherwise(F.col("run")))
    hashed = runs.select("run", F.crc32(F.concat_ws(":", "doc", "run").cast("binary")).alias("hash"))
    at = (F.col("hash") % F.length("run")).cast("int")
    slipped = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(F.col("hash") % slips == 0, slipped).otherwise(F.col("run"))
    words = hashed.select(word.alias("word")).filter(F.length("word") >= min_letters)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count)


def _shared(a: str, b: str) -> int:
    """Length of the common prefix."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while low < high:
        middle = (low + high + 1) // 2
        if a[:middle] == b[:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def _paths(words: Iterable[str], part: int) -> Iterator[list[int]]:
    """The trie nodes of each of the sorted words, from the root down. New nodes get the next numbers of this part; what
    a word shares with the one before is copied. The first word's nodes are all new."""
    following = part << _PART_BITS
    before, path = None, []
    for word in words:
        shared = -1 if before is None else _shared(before, word)
        fresh = len(word) - shared
        path = path[: shared + 1] + list(range(following, following + fresh))
        following += fresh
        before = word
        yield path


def trie_nodes(words: DataFrame, key: str) -> DataFrame:
    """Adds ``number``, which grows in the order of ``key``, and ``path``: the numbers of the trie nodes of each prefix of
    ``key``, the empty one first. ``key`` is never null or repeated.

    The words are sorted into ranges, and each range numbers its own nodes. Those that a range's first word shares with words
    of earlier ranges are then named by the earlier number: the driver keeps the path of the last word of each range, a list of
    one word for each range.
    """
    columns = words.columns
    ranged = words.repartitionByRange(key).sortWithinPartitions(key).checkpoint()
    place = columns.index(key)

    def edges(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        first = last = None
        path: list[int] = []

        def keys() -> Iterator[str]:
            nonlocal first, last
            for batch in batches:
                for word in batch.column(place).to_pylist():
                    first = word if first is None else first
                    last = word
                    yield word

        for path in _paths(keys(), part):
            pass
        if first is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array([part]), pa.array([first]), pa.array([last]), pa.array([path], pa.list_(pa.int64()))], names=["part", "first", "last", "path"]
            )

    # what the first word of a range shares with the last of the range before it: its earlier numbers
    known: dict[int, list[int]] = {}
    stack: list[int] = []
    before = ""
    for edge in sorted(ranged.mapInArrow(edges, "part long, first string, last string, path array<long>").collect(), key=lambda e: e.part):
        shared = _shared(before, edge.first) + 1 if stack else 0
        known[edge.part] = stack[:shared]
        inner = _shared(edge.first, edge.last) + 1  # these nodes of the last word are the first word's
        path = list(edge.path)
        path[: min(inner, shared)] = stack[: min(inner, shared)]
        stack, before = path, edge.last

    def numbered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        earlier = known.get(part, [])
        number = part << _PART_BITS
        again = {(part << _PART_BITS) + depth: node for depth, node in enumerate(earlier)}
        held: list[pa.RecordBatch] = []

        def keys() -> Iterator[str]:
            for batch in batches:
                held.append(batch)
                yield from batch.column(place).to_pylist()

        paths = _paths(keys(), part)
        done = False
        while not done:
            found: list[list[int]] = []
            letters = 0
            while letters < 1 << 20:
                path = next(paths, None)
                if path is None:
                    done = True
                    break
                found.append([again.get(node, node) for node in path[: len(earlier)]] + path[len(earlier) :])
                letters += len(path)
            taken = 0
            while taken < len(found):
                batch = held[0].slice(0, len(found) - taken)
                held[0] = held[0].slice(batch.num_rows)
                if not held[0].num_rows:
                    held.pop(0)
                numbers = pa.array(range(number, number + batch.num_rows), pa.int64())
                number += batch.num_rows
                path_column = pa.array(found[taken : taken + batch.num_rows], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*batch.columns, numbers, path_column], names=[*columns, "number", "path"])
                taken += batch.num_rows

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in words.schema]
    return ranged.mapInArrow(numbered, ", ".join([*fields, "number long", "path array<long>"]))


def near_words(words: DataFrame, factor: int = FACTOR) -> DataFrame:
    """Adds n_near, form, form_n and root to (word, n); ``word`` is never null or repeated.

    Two words are near if they differ by one inserted, deleted or replaced code point. A form is the near word of
    largest n, of equal ones the first in code-point order, if its n is ``factor`` times the word's; the root is where forms lead.

    Nothing is paired off. A pair of nodes belongs to one whole word, and around a letter to one word for each letter
    there is, so the members of a pair are few, whatever the table's size: they are counted, and each takes the
    best of the others. Of equal letters in a row only the last counts as left out, so each neighbour counts once.
    """
    use_shared_folder(words.sparkSession)
    forward = trie_nodes(words.select("word", "n"), "word").checkpoint()
    backward = trie_nodes(forward.select(F.reverse("word").alias("backwards"), F.col("number").alias("word_number")), "backwards")
    # letters are cut before the join, so that they are not cut again for each place
    letters = F.regexp_extract_all("word", F.lit("(?s)(.)"), F.lit(1))
    spelled = forward.select("number", "n", "path", F.length("word").alias("size"), letters.alias("letters"))
    both = spelled.join(backward.select(F.col("word_number").alias("number"), F.col("path").alias("back")), "number")

    def pair(at, right, whole: bool):
        """The nodes before a place and from there on (the word itself), or from the next place on (a gap)."""
        last = F.lit(False) if whole else ~F.get("letters", at).eqNullSafe(F.get("letters", at + 1))
        return F.struct(F.get("path", at).alias("left"), F.get("back", right).alias("right"), F.lit(whole).alias("whole"), last.alias("last"))

    wholes = F.transform(F.sequence(F.lit(0), "size"), lambda at: pair(at, F.col("size") - at, True))
    gaps = F.transform(F.sequence(F.lit(1), "size"), lambda at: pair(at - 1, F.col("size") - at, False))
    pairs = both.filter("size > 0").select("number", "n", F.explode(F.concat(wholes, gaps)).alias("pair")).select("number", "n", "pair.*")
    member = F.struct("n", (-F.col("number")).alias("order"), "whole", "last")
    met = pairs.groupBy("left", "right").agg(F.collect_list(member).alias("members")).filter("size(members) > 1")
    each = met.select("members", F.explode("members").alias("own"))
    others = F.filter(
        "members",
        lambda m: (m["order"] != F.col("own.order")) & ((~m["whole"] & ~F.col("own.whole")) | (m["whole"] & F.col("own.last")) | (F.col("own.whole") & m["last"])),
    )
    near = each.select((-F.col("own.order")).alias("number"), others.alias("others")).filter("size(others) > 0")
    best = F.array_max(F.transform("others", lambda m: F.struct(m["n"].alias("n"), m["order"].alias("order"))))
    found = near.select("number", F.size("others").alias("count"), best.alias("best"))
    found = found.groupBy("number").agg(F.sum("count").alias("n_near"), F.max("best").alias("best")).checkpoint()
    release(words.sparkSession)
    named = forward.select("number", "word", "n").join(found, "number", "left")
    good = F.col("best.n") >= factor * F.col("n")
    named = named.select(
        "number", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(good, -F.col("best.order")).alias("form_number"), F.when(good, F.col("best.n")).alias("form_n"),
    ).checkpoint()
    roots = _roots(named.filter("form_number IS NOT NULL").select("number", F.col("form_number").alias("root")))
    texts = named.select(F.col("number").alias("root"), F.col("word").alias("root_word"))
    forms = named.select(F.col("number").alias("form_number"), F.col("word").alias("form"))
    changed = named.filter("form_number IS NOT NULL").join(forms, "form_number").join(roots, "number").join(texts, "root")
    plain = named.filter("form_number IS NULL").select("word", F.lit(None).cast("string").alias("form"), F.col("word").alias("root"), "n", "n_near", "form_n")
    return changed.select("word", "form", F.col("root_word").alias("root"), "n", "n_near", "form_n").unionByName(plain)


def _roots(links: DataFrame) -> DataFrame:
    """Where (number, root) lead, each round following twice as far. Frequencies grow by the factor with every link,
    so the longest chain, and with it the number of rounds, is bounded by the logarithm of the largest count."""
    while True:
        onward = links.select(F.col("number").alias("root"), F.col("root").alias("beyond"))
        step = links.join(onward, "root", "left")
        links = step.select("number", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")).checkpoint()
        if links.filter("moved").isEmpty():
            return links.select("number", "root")


def spelling_variants(
    docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", slips: int = SLIPS, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT, factor: int = FACTOR
) -> DataFrame:
    """One row per word of the whole texts: word, form, root, n, n_near, form_n; see ``word_counts`` and ``near_words``.

    Null and empty texts have no words; equal rows count each; a null id is an empty one; a text without spaces is one long word;
    an empty table gives no rows; further columns are not read. Words move once as text, and otherwise as numbers: a
    word of m letters makes 2 m + 1 rows of pairs.
    """
    use_shared_folder(docs.sparkSession)
    words = word_counts(docs, id_column=id_column, text_column=text_column, slips=slips, min_letters=min_letters, min_count=min_count)
    return near_words(words, factor)
