"""Main text of web pages by union-free wrappers, inferred per host from aligned token streams."""

from __future__ import annotations

import html
import json
import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.batches import use_shared_folder

#: Wrappers of a host are first inferred in so many parts, by a hash of the token stream, then aligned with each other.
PARTS = 16
#: A container other than article or main is the region if it holds this share of the host's free text.
REGION_SHARE = 0.9

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|select|svg|iframe|object)\b.*?(?:</\1\s*>|\Z)"
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<[!?][^>]*>""",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS = frozenset(
    "address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html li main nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
_CONTAINERS = frozenset("article body center div main section table tbody td tr".split())
_DROPPED = frozenset("head nav header footer aside form button dialog menu label title".split())
#: Parts of class names and ids that mark what is not the article.
_DROPPED_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|consent|cookies?|disqus|footer|header|masthead|menu\w*|modal|nav\w*"
    r"|newsletter|notices?|popup|promo\w*|related|respond|share|sharing|sidebar\w*|social|sponsor\w*|subscribe|toolbar|widget)(?:$|[\s_-])",
    re.I,
)
#: Numbers of classes and ids that stand for a page; single digits stand for places, such as columns.
_NUMBERS = re.compile(r"\d{2,}")
_DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu".split())
#: Opening one of these ends an open paragraph; elements end their own kind.
_ENDS_PARAGRAPH = _BLOCKS - {"br", "html", "head", "body", "title", "summary"}
_ENDS_ITSELF = {"li": "li", "tr": "tr", "td": "td", "th": "td", "dt": "dd", "dd": "dt", "p": "p"}


def events(page: str) -> Iterator[tuple[str, str, str]]:
    """("open", tag, attributes), ("close", tag, "") and ("text", raw text, "") of a page, in order.

    Comments, declarations and the contents of scripts, styles and the like are left out.
    """
    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            yield "text", page[at : m.start()], ""
        at = m.end()
        if m[3]:
            tag = m[3].lower()
            if m[2]:
                yield "close", tag, ""
            else:
                yield "open", tag, m[4]
    if at < len(page):
        rest = page[at:]
        cut = re.search(r"<[a-zA-Z/!][^>]*\Z", rest)  # a tag that was cut off
        yield "text", rest[: cut.start()] if cut else rest, ""


@dataclass
class Element:
    tag: str
    key: str
    dropped: bool


def element(tag: str, attributes: str) -> Element:
    """An element's key is its tag with class and id, numbers in them made alike, as they tell pages and not places;
    whether its contents are kept follows from these and its role."""
    found = {m[1].lower(): (m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(attributes)} if attributes else {}
    names = " ".join(filter(None, (found.get("class"), found.get("id"))))
    dropped = tag in _DROPPED or found.get("role", "").lower() in _DROPPED_ROLES
    dropped |= bool(names) and tag not in ("html", "body", "article", "main") and bool(_DROPPED_NAMES.search(names))
    key = tag + "".join("." + c for c in found.get("class", "").split()) + ("#" + found["id"] if found.get("id") else "")
    key = _NUMBERS.sub("0", key)
    if found.get("role", "").lower() == "main":
        key = "main"
    return Element(tag, key.replace(" ", ""), dropped)


def walk(page: str) -> Iterator[tuple[str, list[Element], str]]:
    """Events with the open elements around them. Missing end tags are made up: ("open" | "close" | "text", stack, text)."""
    stack: list[Element] = []

    def pop(to: int) -> Iterator[tuple[str, list[Element], str]]:
        while len(stack) > to:
            yield "close", stack, ""
            stack.pop()

    for kind, value, attributes in events(page):
        if kind == "text":
            yield "text", stack, value
            continue
        if kind == "open":
            for i in range(len(stack) - 1, -1, -1):
                open_tag = stack[i].tag
                if (open_tag == "p" and value in _ENDS_PARAGRAPH) or _ENDS_ITSELF.get(value) == open_tag or (value == open_tag == "dd"):
                    yield from pop(i)
                    break
                if open_tag in _CONTAINERS or open_tag in ("ul", "ol", "dl"):
                    break
            stack.append(element(value, attributes))
            yield "open", stack, ""
            if value in _VOID or attributes.rstrip().endswith("/"):
                yield from pop(len(stack) - 1)
        elif value in _VOID:
            continue
        else:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag == value:
                    yield from pop(i)
                    break
    yield from pop(0)


@dataclass
class Token:
    """A symbol of a wrapper: a tag or a text slot, alone or in an optional or a repeated group."""

    symbol: str
    mass: int = 0
    optional: bool = False
    repeated: bool = False

    def plus(self, other: Token) -> Token:
        return Token(self.symbol, self.mass + other.mass, self.optional or other.optional, self.repeated or other.repeated)


@dataclass
class Wrapper:
    tokens: list[Token] = field(default_factory=list)

    def symbols(self) -> list[str]:
        return [t.symbol for t in self.tokens]

    def append(self, token: Token, longest: int = 64) -> None:
        """Add a token; if the end now repeats the group before it, keep the group once, as repeated."""
        self.tokens.append(token)
        if not token.symbol.startswith("</"):
            return
        for size in range(2, longest):
            if 2 * size > len(self.tokens):
                return
            a, b = self.tokens[-2 * size : -size], self.tokens[-size:]
            if a[-1].symbol == token.symbol and [t.symbol for t in a] == [t.symbol for t in b]:
                self.tokens[-2 * size :] = [Token(x.symbol, x.mass + y.mass, x.optional or y.optional, True) for x, y in zip(a, b)]
                return
            if b[0].symbol == "<" + token.symbol[2:]:
                return  # the element just closed is whole and has no equal neighbour

    def dump(self) -> str:
        return json.dumps([[t.symbol, t.mass, int(t.optional), int(t.repeated)] for t in self.tokens])

    @staticmethod
    def load(text: str) -> Wrapper:
        return Wrapper([Token(s, m, bool(o), bool(r)) for s, m, o, r in json.loads(text)])

    def pattern(self) -> str:
        """The expression, for reading: groups in brackets with ? or +, text slots as #."""
        out, i = [], 0
        while i < len(self.tokens):
            flags = (self.tokens[i].optional, self.tokens[i].repeated)
            j = i
            while j < len(self.tokens) and (self.tokens[j].optional, self.tokens[j].repeated) == flags:
                j += 1
            body = "".join(t.symbol for t in self.tokens[i:j])
            mark = "*" if all(flags) else "?" if flags[0] else "+" if flags[1] else ""
            out.append(f"({body}){mark}" if mark else body)
            i = j
        return "".join(out)


def page_wrapper(page: str) -> Wrapper:
    """The token stream of a page's containers, blocks and text, with neighbouring equal groups folded."""
    wrapper = Wrapper()
    for kind, stack, text in walk(page):
        if kind == "text":
            size = len(text) - text.count(" ")
            if not size or text.isspace():
                continue
            if wrapper.tokens and wrapper.tokens[-1].symbol == "#":
                wrapper.tokens[-1].mass += size
            else:
                wrapper.append(Token("#", size))
        elif stack[-1].tag in _BLOCKS and stack[-1].tag not in _VOID:
            wrapper.append(Token(f"</{stack[-1].key}>" if kind == "close" else f"<{stack[-1].key}>"))
    return wrapper


def align(a: Wrapper, b: Wrapper) -> Wrapper:
    """One wrapper for the pages of both.

    Where the streams agree, so does the result. A stretch that only one of them has is a repetition if it
    equals what stands before it, and that becomes a repeated group; otherwise it becomes optional.
    """
    if a.symbols() == b.symbols():
        return Wrapper([x.plus(y) for x, y in zip(a.tokens, b.tokens)])
    out: list[Token] = []

    def only(stretch: list[Token]) -> None:
        if not stretch:
            return
        before = out[-len(stretch) :]
        if [t.symbol for t in before] == [t.symbol for t in stretch]:
            out[-len(stretch) :] = [Token(x.symbol, x.mass + y.mass, x.optional, True) for x, y in zip(before, stretch)]
        else:
            out.extend(Token(t.symbol, t.mass, True, t.repeated) for t in stretch)

    for what, i, j, k, m in SequenceMatcher(None, a.symbols(), b.symbols(), autojunk=False).get_opcodes():
        if what == "equal":
            out.extend(x.plus(y) for x, y in zip(a.tokens[i:j], b.tokens[k:m]))
        else:
            only(a.tokens[i:j])
            only(b.tokens[k:m])
    return Wrapper(out)


def region(wrapper: Wrapper) -> str:
    """Key of the element that holds the host's main text: the first article or main with text in it, else the
    innermost container with nearly all text that no menu, header or the like encloses; "" for the body."""
    masses: dict[str, int] = {}
    depths: dict[str, int] = {}
    stack: list[tuple[str, bool]] = []
    total = 0
    for token in wrapper.tokens:
        if token.symbol == "#":
            if not any(dropped for _, dropped in stack):
                total += token.mass
                for depth, (key, _) in enumerate(stack):
                    masses[key] = masses.get(key, 0) + token.mass
                    depths.setdefault(key, depth)
        elif token.symbol.startswith("</"):
            if stack and any(token.symbol[2:-1] == key for key, _ in stack):
                while stack.pop()[0] != token.symbol[2:-1]:
                    pass
        else:
            key = token.symbol[1:-1]
            tag = re.split(r"[.#]", key, maxsplit=1)[0]
            names = re.sub(r"[.#]", " ", key[len(tag) :])
            stack.append((key, tag in _DROPPED or (tag not in ("html", "body", "article", "main") and bool(_DROPPED_NAMES.search(names)))))
    tag_of = lambda key: re.split(r"[.#]", key, maxsplit=1)[0]
    max_mass = lambda keys: sum(masses[k] for k in keys if depths[k] == min(depths[o] for o in keys))
    for wanted in ("article", "main"):
        found = [k for k in masses if tag_of(k) == wanted and 2 * masses[k] >= total]
        if found:
            return min(found, key=lambda k: (depths[k], -masses[k], k))
        alike = [k for k in masses if tag_of(k) == wanted]
        if 2 * max_mass(alike) >= total > 0:
            return min(alike, key=lambda k: (-masses[k], depths[k], k))  # one of several templates of the host
    large = [k for k in masses if tag_of(k) in ("div", "section", "td") and masses[k] >= REGION_SHARE * total]
    return max(large, key=lambda k: (depths[k], k)) if large else ""


def extract(page: str, key: str) -> str:
    """Blocks of the page's region, one to a line: character references decoded, white space made one space.

    The region is every outermost element with the key; in a page of another template, without it, every outermost
    article or main, if that is what the key's element is; else the whole body.
    """
    tag = re.split(r"[.#]", key, maxsplit=1)[0]
    for attempt in [*([key] if key else []), *([tag] if tag in ("article", "main") and tag != key else []), ""]:
        by_tag = attempt == tag != key
        blocks: list[str] = []
        parts: list[str] = []
        seen = not attempt

        def flush() -> None:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                blocks.append(text)
            parts.clear()

        dropped = 0  # open elements whose contents do not count
        depth = 0  # open elements with the key
        for kind, stack, text in walk(page):
            if kind == "text":
                if not dropped and (depth or not attempt):
                    parts.append(text)
                continue
            top = stack[-1]
            if top.tag in _BLOCKS:
                flush()
            step = 1 if kind == "open" else -1
            dropped += step * top.dropped
            if attempt and (top.tag if by_tag else top.key) == attempt:
                depth += step
                seen = True
        flush()
        if seen:
            return "\n".join(blocks)
    return ""


_STREAMS = "host string, stream string, wrapper string"


def _streams(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each host and token stream of a batch, with the text masses of its pages added up."""
    for batch in batches:
        found: dict[tuple[str, str], Wrapper] = {}
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            wrapper = page_wrapper(page or "")
            at = (host, " ".join(wrapper.symbols()))
            found[at] = align(found[at], wrapper) if at in found else wrapper
        if found:
            hosts, streams = zip(*found)
            yield pa.RecordBatch.from_arrays(
                [pa.array(hosts), pa.array(streams), pa.array([w.dump() for w in found.values()])], names=["host", "stream", "wrapper"]
            )


def _aligned(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that are sorted by all columns but the last, a wrapper: one row for each, with their wrappers aligned."""
    last, wrapper = None, None
    for batch in batches:
        names = batch.schema.names
        types = [batch.schema.field(n).type for n in names]

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip([*last, wrapper.dump()], types)], names=names)

        columns = [c.to_pylist() for c in batch.columns]
        for *group, text in zip(*columns):
            if group == last:
                wrapper = align(wrapper, Wrapper.load(text))
            else:
                if wrapper is not None:
                    yield row()
                last, wrapper = group, Wrapper.load(text)
    if wrapper is not None:
        yield row()


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper) from all pages (host, html).

    Equal token streams become one where they are read, and again per host; what is left, the different streams of
    a host, is aligned in ``PARTS`` parts and then across the parts. Rows are streamed in order: a task holds
    one wrapper at a time, however many pages a host has.
    """
    streams = pages.select("host", "html").mapInArrow(_streams, _STREAMS)
    kinds = streams.repartition("host", "stream").sortWithinPartitions("host", "stream").mapInArrow(_aligned, _STREAMS)
    parts = kinds.select("host", F.pmod(F.xxhash64("stream"), F.lit(PARTS)).alias("part"), "wrapper")
    some = parts.repartition("host", "part").sortWithinPartitions("host", "part").mapInArrow(_aligned, "host string, part long, wrapper string")
    return some.select("host", "wrapper").repartition("host").sortWithinPartitions("host").mapInArrow(_aligned, "host string, wrapper string")


def _regions(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [region(Wrapper.load(w)) for w in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.string())], names=["host", "region"])


def _texts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [extract(p or "", r or "") for p, r in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def main_text(
    pages: DataFrame, *, id_column: str = "page_id", url_column: str = "url", html_column: str = "html"
) -> DataFrame:
    """One row per page: page_id, url, text, n_chars.

    The wrapper of the page's host says which element holds the article; of that, all blocks are kept but menus,
    headers, footers, asides, notices, adverts, forms and comments. A null or empty page has an empty text. Pages
    without a host form one group; repeated rows are each answered; an empty table gives no rows; further
    columns are not read. The table of regions, one short row per host, is written to the shared folder, so that
    Spark knows its size and broadcasts it only if it is small.
    """
    folder = use_shared_folder(pages.sparkSession)
    read = pages.select(
        F.col(id_column).alias("page_id"),
        F.col(url_column).cast("string").alias("url"),
        F.col(html_column).cast("string").alias("html"),
        F.lower(F.coalesce(F.regexp_extract(F.col(url_column).cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit(""))).alias("host"),
    )
    path = f"{folder.rstrip('/')}/regions-{uuid.uuid4().hex}"
    infer_wrappers(read).mapInArrow(_regions, "host string, region string").write.parquet(path)
    regions = pages.sparkSession.read.schema("host string, region string").parquet(path)
    kind = read.schema["page_id"].dataType.simpleString()
    found = read.join(regions, "host", "left").select("page_id", "url", "html", "region")
    return found.mapInArrow(_texts, f"page_id {kind}, url string, text string").withColumn("n_chars", F.length("text").cast("long"))
