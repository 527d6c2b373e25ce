"""Path globs, compiled on the driver to one regular expression for ``rlike``."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

_ANY_DEPTH = "**"
_NEVER = r"(?!)"


def _segment_regex(segment: str) -> str:
    """One path segment: ``*``, ``?`` and ``[seq]`` never cross a slash."""
    pieces = []
    for token in re.findall(r"\[!?\]?[^\]]*\]|.", segment, flags=re.S):
        if token == "*":
            pieces.append("[^/]*")
        elif token == "?":
            pieces.append("[^/]")
        elif len(token) > 2 and token[0] == "[":
            negated = token[1] == "!"
            members = re.sub(r"([\\\[\]^&~|])", r"\\\1", token[2 if negated else 1 : -1])
            pieces.append(f"(?!/)[{'^' if negated else ''}{members}]")
        else:
            pieces.append(re.sub(r"([^\w/])", r"\\\1", token) if token.isascii() else token)
    return "".join(pieces)


def glob_regex(pattern: str) -> str:
    """``**`` stands for zero or more whole segments; the whole path has to match."""
    segments = pattern.split("/")
    if all(segment == _ANY_DEPTH for segment in segments):
        return r"[\s\S]*"
    regex, need_slash = "", False
    for position, segment in enumerate(segments):
        last = position == len(segments) - 1
        if segment != _ANY_DEPTH:
            regex += ("/" if need_slash else "") + _segment_regex(segment)
            need_slash = True
        elif last:
            regex += r"(?:/[\s\S]*)?"
        elif need_slash:
            regex += "(?:/[^/]*)*"
        else:
            regex += "(?:[^/]*/)*"
    return regex


def any_glob_regex(patterns: Iterable[str]) -> str:
    alternatives = [f"(?:{glob_regex(pattern)})" for pattern in patterns]
    return rf"\A(?:{'|'.join(alternatives)})\z" if alternatives else _NEVER


def matches_any_glob(path: Column, patterns: Iterable[str]) -> Column:
    patterns = list(patterns)
    return path.rlike(any_glob_regex(patterns)) if patterns else F.lit(False)
