"""Text functions as Column expressions: each works on one row, so none of them shuffles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: a token is a run of letters, digits and underscores in any script.
TOKEN_PATTERN = r"[\p{L}\p{N}_]+"

# Fixed value: the characters Python's str.strip() and re's \s treat as white space.
SPACE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
NON_SPACE = r"[^\s\x0b\x1c-\x1f\x85\p{Z}]"

# Fixed value: the line boundaries of Python's str.splitlines().
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\x{2028}\x{2029}]"

# The cross-reference roles whose markup is removed before indexing.
ROLES = (
    "ref", "class", "mod", "func", "meth", "attr", "exc", "obj", "data", "const", "doc", "term",
    "envvar", "option", "file", "samp", "guilabel", "kbd", "menuselection",
)

# Three alternatives inside the backticks: `label <target>`, `~dotted.name`, anything else.
ROLE_PATTERN = (
    r":(?:py:)?(?:" + "|".join(ROLES) + r"):`"
    rf"(?:{SPACE}*([^`<]*[^`<\s\x0b\x1c-\x1f\x85\p{{Z}}]){SPACE}*<[^`]*>{SPACE}*"
    r"|~([^`]*)|([^`~][^`]*))`"
)


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` (a one-element ``transform``)."""
    return F.transform(F.array(value), body)[0]


def tokenize(text: Column) -> Column:
    """Lower-cased word tokens, in order, with repeats."""
    found = F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(0))
    return F.transform(found, lambda token: F.lower(token))


def term_counts(tokens: Column) -> Column:
    """``array<struct<term, tf>>`` of one token list.

    Sorting and measuring the runs stays inside the row; the usual explode + groupBy would
    shuffle every (document, term) pair of the corpus.
    """

    def count(s: Column) -> Column:
        last = F.size(s) - 1
        run_ends = F.filter(
            F.sequence(F.lit(0), last),
            lambda i: (i == last) | (F.get(s, i) != F.get(s, i + 1)),
        )
        return let(
            run_ends,
            lambda ends: F.transform(
                ends,
                lambda end, i: F.struct(
                    F.get(s, end).alias("term"),
                    (end - F.coalesce(F.get(ends, i - 1), F.lit(-1))).alias("tf"),
                ),
            ),
        )

    empty = F.array().cast("array<struct<term:string,tf:int>>")
    return F.when(F.size(tokens) > 0, let(F.sort_array(tokens), count)).otherwise(empty)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, f"{SPACE}+$", "")


def is_blank(text: Column) -> Column:
    return ~text.rlike(NON_SPACE)


def split_lines(text: Column) -> Column:
    """Lines of a text; a trailing line break does not open another line."""
    return let(
        F.split(text, LINE_BREAK, -1),
        lambda parts: F.when(
            F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)
        ).otherwise(parts),
    )


def universal_newlines(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")


def decode_utf8(content: Column) -> Column:
    """Bytes to text: malformed sequences become U+FFFD, line ends become ``\\n``."""
    return universal_newlines(F.make_valid_utf8(content.cast("string")))


def clean_roles(text: Column) -> Column:
    """Replace ``:role:`label <target>``` by its label and drop one leading ``~``."""
    return F.regexp_replace(text, ROLE_PATTERN, "$1$2$3")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    """The part from the last dot of the file name; a dotfile has none."""
    return F.regexp_extract(path, r"[^/](\.[^./]+)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]+$", "")


def has_suffix(path: Column, suffixes) -> Column:
    return suffix(path).isin(*suffixes)
