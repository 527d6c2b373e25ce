"""Secrets in texts, with DataFrame functions alone: fixed patterns, and a battery of randomness tests.

A run of token characters is a candidate if it holds digits and letters as its encoding does. Three tests ask
whether its symbols look drawn at random from the alphabet of that encoding: chi-squared uniformity, runs
above and below the middle, and correlation of neighbours. Candidates that look like text or numbering are
rejected at a controlled rate of false rejections in each class of lengths; what is left is reported.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.batches import apart

# Fixed values of the base rules.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_VALUE, ACCESS_LENGTH, HEX_LENGTH = 8, 16, 32

KINDS = ("assign", "access", "hex", "random")
MIN_CANDIDATE = 20
#: Share of wrongly rejected candidates that is allowed in each class of lengths.
FALSE_DISCOVERIES = 0.05
MASK = "[SECRET]"

_DIGITS, _LOWER, _UPPER = string.digits, string.ascii_lowercase, string.ascii_uppercase
#: Alphabets from the smallest on: a candidate is tested against the first that holds it.
_ENCODINGS = (
    (r"^(?=.*[0-9])(?=.*[a-f])[0-9a-f]+$", _DIGITS + "abcdef"),
    (r"^(?=.*[0-9])(?=.*[A-F])[0-9A-F]+$", _DIGITS + "ABCDEF"),
    (r"^(?=.*[2-7])(?=.*[A-Z])[A-Z2-7]+$", _UPPER + "234567"),
    (r"^(?=.*[0-9])(?=.*[a-z])[0-9a-z]+$", _DIGITS + _LOWER),
    (r"^(?=.*[0-9])(?=.*[A-Z])[0-9A-Z]+$", _DIGITS + _UPPER),
    (r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[0-9A-Za-z]+$", _UPPER + _LOWER + _DIGITS),
    (r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[0-9A-Za-z+/]+$", _UPPER + _LOWER + _DIGITS + "+/"),
    (r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[0-9A-Za-z_-]+$", _UPPER + _LOWER + _DIGITS + "-_"),
)
_CANDIDATE = rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{MIN_CANDIDATE},}}"
#: Parts of a run that no encoding holds, from the longest kind on.
_PARTS = tuple(rf"[A-Za-z0-9{more}]{{{MIN_CANDIDATE},}}" for more in ("+/", "_-", ""))
_BINS, _BINS_PER_DECADE = 2000, 20
_FOUND = "array<struct<start:int,end:int,found:string>>"


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches with their places: array of (start, end, found), in code points.

    The pieces between matches and the matches themselves, laid end to end, are the text.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    lengths = F.arrays_zip(
        F.transform(F.split(text, pattern, -1), F.length).alias("gap"), F.transform(found, F.length).alias("size"), found.alias("found")
    )
    # the piece behind the last match has no match beside it
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_FOUND).alias("spans"))
    walked = F.aggregate(
        F.filter(lengths, lambda m: m["found"].isNotNull()),
        start,
        lambda done, m: F.struct(
            (done["at"] + m["gap"] + m["size"]).alias("at"),
            F.array_append(
                done["spans"],
                F.struct(
                    (done["at"] + m["gap"]).alias("start"), (done["at"] + m["gap"] + m["size"]).alias("end"), m["found"].alias("found")
                ),
            ).alias("spans"),
        ),
    )
    return F.when(text.rlike(pattern), walked["spans"]).otherwise(start["spans"])


def _plain(spans: Column, kind: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end")))


def base_spans(text: Column) -> Column:
    """Matches of the fixed patterns: array of (start, kind, end), by start, then kind."""
    value = ASSIGN.index("([A-Za-z0-9+/_.=-]+)")
    behind = rf"^{ASSIGN[:value]}"
    assign = F.filter(matches(text, ASSIGN), lambda s: F.length(F.regexp_replace(s["found"], behind, "")) >= ASSIGN_VALUE)
    # a match is a whole run, so those long enough are found directly
    access = matches(text, rf"AKIA[A-Z0-9]{{{ACCESS_LENGTH - 4},}}")
    hexes = matches(text, rf"(?<![0-9a-f])[0-9a-f]{{{HEX_LENGTH},}}")
    return F.array_sort(F.concat(_plain(assign, 0), _plain(access, 1), _plain(hexes, 2)))


#: Chebyshev coefficients of the complementary error function, relative error below 1.2e-7.
_ERFC = (
    -1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277,
)


def _upper_tail(z: Column) -> Column:
    """Chance that a standard normal value exceeds z, never under 1e-100."""
    x = F.abs(z) * 0.7071067811865476
    t = 1 / (1 + 0.5 * x)
    series = F.lit(0.0)
    for coefficient in reversed(_ERFC):
        series = coefficient + t * series
    tail = F.greatest(t * F.exp(series - x * x) / 2, F.lit(1e-100))
    return F.when(z >= 0, tail).otherwise(1 - tail)


def _walk(values: Column, size: Column) -> Column:
    """Counts of one pass over the symbols of a candidate: high ones, runs, sums, and products of neighbours."""
    return F.aggregate(
        values,
        F.struct(
            F.lit(-1).alias("last"),
            F.lit(0).alias("high"),
            F.lit(0).alias("runs"),
            F.lit(0.0).alias("sum"),
            F.lit(0.0).alias("squares"),
            F.lit(0.0).alias("products"),
        ),
        lambda s, v: F.struct(
            v.alias("last"),
            (s["high"] + (2 * v >= size).cast("int")).alias("high"),
            (s["runs"] + ((s["last"] < 0) | ((2 * v >= size) != (2 * s["last"] >= size))).cast("int")).alias("runs"),
            (s["sum"] + v).alias("sum"),
            (s["squares"] + v * v).alias("squares"),
            (s["products"] + F.when(s["last"] < 0, 0).otherwise(v * s["last"])).alias("products"),
        ),
    )


def _equal_pairs(values: Column) -> Column:
    """The sum of the squared counts of the symbols: in sorted order a run of r adds 1 + 3 + 5 + ... = r squared."""
    return F.aggregate(
        F.array_sort(values),
        F.struct(F.lit(-1).alias("last"), F.lit(0).alias("run"), F.lit(0).alias("squares")),
        lambda s, v: F.struct(
            v.alias("last"),
            F.when(v == s["last"], s["run"] + 1).otherwise(1).alias("run"),
            (s["squares"] + F.when(v == s["last"], 2 * s["run"] + 1).otherwise(1)).alias("squares"),
        ),
    )["squares"]


def _battery(c: Column) -> Column:
    """The combined p-value of three tests of randomness: thrice the smallest, at most 1."""
    n, size, walk = c["n"], c["size"], c["walk"]
    free = size - 1
    chi = F.greatest(size * c["squares"] / n - n, F.lit(0.0)) / free
    spread = 2 / (9 * free)
    uneven = _upper_tail((F.pow(chi, F.lit(1 / 3)) - (1 - spread)) / F.sqrt(spread))
    high = walk["high"].cast("double")
    both = 2 * high * (n - high)
    runs_z = (walk["runs"] - both / n - 1) / F.sqrt(both * (both - n) / (n * n * (n - 1)))
    runs = F.when(both > n, F.least(F.lit(1.0), 2 * _upper_tail(F.abs(runs_z)))).otherwise(1e-100)
    # the circle of neighbours, closed from the last symbol to the first
    around = walk["products"] + walk["last"] * c["values"][0]
    variance = n * walk["squares"] - walk["sum"] * walk["sum"]
    correlation = (n * around - walk["sum"] * walk["sum"]) / variance
    serial_z = (correlation + 1 / (n - 1)) * F.sqrt(n)
    serial = F.when(variance > 0, F.least(F.lit(1.0), 2 * _upper_tail(F.abs(serial_z)))).otherwise(1e-100)
    return F.least(F.lit(1.0), 3 * F.least(uneven, runs, serial))


def _piece(start: Column, end: Column, run: Column) -> Column:
    found = run["found"].substr(start - run["start"] + 1, end - start)
    return F.struct(start.alias("start"), end.alias("end"), found.alias("found"))


def _beside(runs: Column, base: Column) -> Column:
    """What the base spans leave of the runs."""

    def parts(run: Column) -> Column:
        walked = F.aggregate(
            F.filter(base, lambda b: (b["start"] < run["end"]) & (run["start"] < b["end"])),
            F.struct(run["start"].alias("at"), F.array().cast(_FOUND).alias("parts")),
            lambda done, b: F.struct(
                F.greatest(done["at"], b["end"]).alias("at"),
                F.when(b["start"] - done["at"] >= MIN_CANDIDATE, F.array_append(done["parts"], _piece(done["at"], b["start"], run)))
                .otherwise(done["parts"])
                .alias("parts"),
            ),
            lambda done: F.when(
                run["end"] - done["at"] >= MIN_CANDIDATE, F.array_append(done["parts"], _piece(done["at"], run["end"], run))
            ).otherwise(done["parts"]),
        )
        return walked

    return F.when(F.size(base) == 0, runs).otherwise(F.flatten(F.transform(runs, parts)))


def _split(runs: Column, alphabet) -> Column:
    """Runs that an encoding holds, and of the others the parts between signs that do not go together."""

    def parts(run: Column) -> Column:
        inside = F.array_distinct(F.concat(*[matches(run["found"], p) for p in _PARTS]))
        moved = F.transform(inside, lambda s: F.struct((run["start"] + s["start"]).alias("start"), (run["start"] + s["end"]).alias("end"), s["found"]))
        return F.when(alphabet(run).isNull() & run["found"].rlike("[0-9]"), moved.cast(_FOUND)).otherwise(F.array(run).cast(_FOUND))

    return F.flatten(F.transform(runs, parts))


def _candidates(text: Column, base: Column | None = None) -> Column:
    """Tested candidates: array of (start, end, class, bin). The bin is the p-value on a logarithmic scale, rounded
    to the larger p-value; a class holds lengths up to a power of the square root of two.

    Candidates are the runs of token characters, or what base spans leave of them. A run that fits no encoding is
    split where '+' or '/' meet '_' or '-'; parts may lie inside others. Each step is an array of its own, so that nothing is computed twice within a candidate.
    """
    alphabet = lambda s: F.coalesce(*[F.when(s["found"].rlike(p), F.lit(a)) for p, a in _ENCODINGS])
    runs = matches(text, _CANDIDATE)
    if base is not None:
        runs = _beside(runs, base)
    found = F.transform(
        _split(runs, alphabet),
        lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["found"].alias("found"), alphabet(s).alias("alphabet")),
    )
    symbols = F.transform(
        F.filter(found, lambda s: s["alphabet"].isNotNull()),
        lambda s: F.struct(
            s["start"].alias("start"),
            s["end"].alias("end"),
            F.length(s["alphabet"]).cast("double").alias("size"),
            # the split has an empty piece behind the last symbol
            F.transform(F.slice(F.split(s["found"], "(?!^)"), 1, s["end"] - s["start"]), lambda c: F.instr(s["alphabet"], c) - 1).alias(
                "values"
            ),
        ),
    )
    counted = F.transform(
        symbols,
        lambda s: F.struct(
            s["start"].alias("start"),
            s["end"].alias("end"),
            s["size"].alias("size"),
            s["values"].alias("values"),
            (s["end"] - s["start"]).cast("double").alias("n"),
            _walk(s["values"], s["size"]).alias("walk"),
            _equal_pairs(s["values"]).alias("squares"),
        ),
    )
    tested = F.transform(
        counted, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["n"].alias("n"), _battery(s).alias("p"))
    )
    return F.transform(
        tested,
        lambda s: F.struct(
            s["start"].alias("start"),
            s["end"].alias("end"),
            F.least(F.lit(40), F.floor(2 * F.log2(s["n"]))).cast("int").alias("class"),
            F.least(F.lit(_BINS), F.floor(-_BINS_PER_DECADE * F.log10(s["p"]))).cast("int").alias("bin"),
        ),
    )


def rejection_bins(tested: DataFrame, rate: float = FALSE_DISCOVERIES) -> dict[int, int]:
    """For each class of lengths the bin from which on candidates count as not random, by the step-up rule over
    all candidates of the class. The counts per class and bin, at most 40 times 2,001 rows, are all that is moved."""
    counts = (
        tested.select(F.explode("candidates").alias("c"))
        .groupBy(F.col("c.class").alias("class"), F.col("c.bin").alias("bin"))
        .count()
        .collect()
    )
    by_class: dict[int, dict[int, int]] = {}
    for row in counts:
        by_class.setdefault(row["class"], {})[row["bin"]] = row["count"]
    limits = {}
    for class_, bins in by_class.items():
        total, below = sum(bins.values()), 0
        for bin_ in sorted(bins, reverse=True):  # from the smallest p-value
            below += bins[bin_]
            if 10 ** (-bin_ / _BINS_PER_DECADE) <= rate * below / total:
                limits[class_] = bin_
    return limits


def secret_spans(
    docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", rate: float = FALSE_DISCOVERIES
) -> DataFrame:
    """``docs`` with a column ``_spans``: array of (start, kind, end) of all secrets, by start, then kind.

    Kinds are numbered as in ``KINDS``; places are code points, ends exclusive. Random candidates
    are looked for in what the base spans leave of a run; of those inside one another the longest is added. All columns of ``docs`` stay as they are. Null and empty texts have no
    spans; repeated rows have each their own; an empty table gives no rows. The texts are read twice,
    once for the counts of p-values and once for the answer, and never shuffled.
    """
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    with_base = docs.withColumn("_base", base_spans(text))
    limits = rejection_bins(with_base.select(_candidates(text, F.col("_base")).alias("candidates")), rate)
    bound = lambda c: F.coalesce(*[F.when(c["class"] == k, F.lit(v)) for k, v in sorted(limits.items())], F.lit(_BINS + 1))
    added = with_base.withColumn("_candidates", _candidates(text, F.col("_base")))
    added = added.withColumn("_candidates", F.filter("_candidates", lambda c: c["bin"] < bound(c)))
    inside = lambda c, o: (o["start"] <= c["start"]) & (c["end"] <= o["end"]) & (c["end"] - c["start"] < o["end"] - o["start"])
    outer = F.filter("_candidates", lambda c: ~F.exists("_candidates", lambda o: inside(c, o)))
    return added.withColumn("_spans", F.array_sort(F.concat("_base", _plain(outer, 3)))).drop("_candidates")


def _written(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")


def secret_digest(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random for every row of ``docs``."""
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    found = secret_spans(rows)
    count = lambda kind: F.size(F.filter("_spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_written(F.col("_base")), 256).alias("base_sha256"),
        _written(F.col("_spans")).alias("spans"),
        count(3).alias("n_random"),
    )


def mask_secrets(docs: DataFrame, *, text_column: str = "text", mask: str = MASK) -> DataFrame:
    """``docs`` with every secret in the text replaced by ``mask``; overlapping spans become one. Null and empty texts
    stay, and so do all other columns, whatever their names; repeated rows are each masked; an empty table gives no rows."""
    packed, back = apart(docs, text_column)
    found = secret_spans(packed)
    text = F.col("text")
    walked = F.aggregate(
        "_spans",
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda done, s: F.struct(
            F.greatest(done["at"], s["end"]).alias("at"),
            F.when(s["start"] < done["at"], done["out"])
            .otherwise(F.concat(done["out"], text.substr(done["at"] + 1, s["start"] - done["at"]), F.lit(mask)))
            .alias("out"),
        ),
    )
    clean = F.concat(walked["out"], text.substr(walked["at"] + 1, F.length(text)))
    return back(found.withColumn("text", F.when(F.size("_spans") > 0, clean).otherwise(text)))
