"""Main text of HTML pages by equivalence classes of page tokens.

1. Each page becomes tokens: opening tags with the path of the elements around
   them, and text with its path: pieces outside a main element, whole blocks
   inside one, so that no sentence loses a part. A page's count of a token is one
   entry of the token's occurrence vector over the pages of its host. Pages with
   the same text count once: copies of an article are no support.
2. Tokens of a host are summed up in Spark: the pages that have them, and a
   commutative hash of the vector. Equal hashes mean equal vectors, so grouping
   by (hash, pages) gives the equivalence classes. A class is valid with two or
   more tokens, each word of a text being one, and pages enough. A class is
   nested in the nearest valid class around it; where its tokens lie in several,
   each part has to be valid alone. The template of a host is these classes.
3. The stretches between template tokens are slots. Slots inside an article or
   main element hold the main text where the page has text in one; else all slots
   do; in either case without text of the template. As a check, menus, headers,
   footers, sidebars, notices, adverts, forms, scripts, styles and reader comments
   are known by element or by a whole word of class, id or role. Such a word on
   an element around a main element counts for nothing, unless main text was read
   before it and the word names comments, adverts or related pages.

Text inside a main element needs `main_pages` different pages to count as the
template's: fewer articles may well share a line. Hosts of any size are one
aggregate with map-side combine; templates join by broadcast while they are few,
else by a shuffle.

Defined results: null html counts as empty and has empty text; a null url is a
host of its own; repeated rows get a row each; an empty table gives no row.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, frozen, join_hot, text_or_empty

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|iframe|svg|title|select|button)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong "
    "sub sup time tt u var wbr".split())
_OPTIONAL_END = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "option": {"option"}}
_CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol "
    "p pre section table ul".split())
_NEVER = frozenset("head nav footer aside form dialog menu object audio video canvas".split())
_MAIN = frozenset(("article", "main"))
#: What a class, id or role is made of where it names something other than main text: all parts of the word are of these, one of the first two at least.
_OTHERS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion promoted related recommend "
    "recommended recommendations comment comments disqus respond replies reply".split())
_FRAME = frozenset(
    "banner banners nav navbar navigation navi menu menus menubar breadcrumb breadcrumbs sidebar sidebars side widget widgets footer "
    "footnav cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe subscription signup login "
        "share shares sharing social pagination pager toolbar masthead skip search".split())
_NEUTRAL = frozenset(
    "main top bottom left right primary secondary site page global container wrapper wrap box block blocks bar list lists item items "
    "section area inner outer content row col column group button buttons link links icon icons form slot unit header posts articles "
        "stories".split())
_NONE, _AROUND, _FOREIGN, _NEVER_TEXT = range(4)


@lru_cache(65_536)
def _hint(marks: str) -> int:
    """_FOREIGN or _AROUND where a whole word of the marks says so."""
    found = _NONE
    for word in marks.lower().split():
        parts = [p for p in re.split(r"[_-]+", word) if p]
        if all(p in _OTHERS or p in _FRAME or p in _NEUTRAL or p.isdigit() for p in parts):
            found = max([found, *(_FOREIGN if p in _OTHERS else _AROUND if p in _FRAME else _NONE for p in parts)])
    return found


def _marks(attributes: str) -> str:
    return " ".join(next(filter(None, a[1:]), "") for a in _ATTRIBUTE.findall(attributes))


def _level(tag: str, marks: str, in_main: bool) -> int:
    """How firmly an element's text is dropped; a form may hold the whole page."""
    if tag in _NEVER or tag == "header" and not in_main:
        return _AROUND if tag == "form" else _NEVER_TEXT
    return _hint(marks) if marks and tag not in _MAIN and tag not in ("body", "html") else _NONE


def _tag_key(path: str, value: str) -> str:
    return f"<{path}>{value}"


def parse(page: str) -> Iterator[tuple[str, str, str, bool, bool, str]]:
    """(kind, path, value, dropped, in main, tag token around it): kind is "tag" for an opening tag, "text" for text, "cut" where a block ends.

    A path is a hash of the element's tag and marks and of the path around it.
    """
    stack: list[tuple[str, str, int, bool, str]] = []  # tag, path, level, main, tag token
    at = 0
    read = False  # text of a main element

    def top() -> tuple[str, str, int, bool, str]:
        return stack[-1] if stack else ("", "", _NONE, False, "")

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            _, path, level, main, up = top()
            read = read or main and not level and not page[at : m.start()].isspace()
            yield "text", path, page[at : m.start()], level > 0, main, up
        at = m.end()
        name = m.group(3)
        if name is None:
            continue
        tag, closing = name.lower(), bool(m.group(2))
        if tag in _INLINE:
            _, path, level, main, up = top()
            if tag == "br":
                yield "text", path, " ", level > 0, main, up
            elif not closing:
                yield "tag", path, tag, level > 0, main, up
                foreign = "=" in m.group(4) and _hint(_marks(m.group(4))) == _FOREIGN  # an advert inside a line
                if tag not in _VOID and (foreign or stack and stack[-1][0] in _INLINE):
                    stack.append((tag, path, _FOREIGN if foreign else level, main, up))
            else:
                open_ = [k for k, x in enumerate(stack) if x[0] == tag]
                if open_ and all(x[0] in _INLINE for x in stack[open_[-1] :]):
                    del stack[open_[-1] :]
            continue
        yield "cut", "", "", False, False, ""
        if closing:
            names = [x[0] for x in stack]
            if tag in names:
                del stack[len(names) - 1 - names[::-1].index(tag) :]
            continue
        if tag in _CLOSES_P:
            names = [x[0] for x in stack]
            if "p" in names:
                del stack[len(names) - 1 - names[::-1].index("p") :]
        ends = _OPTIONAL_END.get(tag)
        while ends and stack and stack[-1][0] in ends:
            stack.pop()
        marks = _marks(m.group(4)) if "=" in m.group(4) else ""
        _, path, level, main, up = top()
        own = f"{tag}.{marks}" if marks else tag
        yield "tag", path, own, level > 0, main, up
        if tag not in _VOID:
            if tag in _MAIN and (level == _AROUND or level == _FOREIGN and not read):
                level = _NONE
            stack.append((tag, xxhash.xxh64_hexdigest(f"{path}/{own}"), max(level, _level(tag, marks, main)),
                main or tag in _MAIN and not level, _tag_key(path, own)))
    if at < len(page):
        _, path, level, main, up = top()
        yield "text", path, page[at:], level > 0, main, up
    yield "cut", "", "", False, False, ""


def _long(x: str) -> int:
    return xxhash.xxh64_intdigest(x) - 2**63


def host_of(url_col: str):
    return F.lower(F.regexp_extract(F.coalesce(F.col(url_col).cast("string"), F.lit("")),
        r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))


#: The low bits of a token: text, of several words, inside a main element.
_TEXT, _WORDS, _INSIDE = 1, 2, 4


def _tag_token(key: str) -> int:
    return _long(key) & ~7


def _text_token(path: str, text: str, main: bool) -> int:
    return _long(f"#{path}#{text}") & ~7 | _TEXT | _WORDS * (" " in text) | _INSIDE * main


def _one_line(pieces: list[str]) -> str:
    return " ".join("".join(pieces).split())


def _units(html: str) -> Iterator[tuple[str, str, list, bool, str]]:
    """(kind, path, pieces, in main, tag token around it): "tag" for an opening tag, "block" for the text between two ends of blocks, dropped text left out."""
    part: list[str] = []
    where = ("", False, "")
    for what, path, value, gone, main, up in parse(html):
        if what == "tag":
            yield "tag", path, [value], main, up
        elif what == "text" and not gone:
            part.append(value)
            where = (path, main, up)
        elif what == "cut" and part:
            yield "block", where[0], part, *where[1:]
            part = []


def _counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row a page: a hash of its text, one of the whole page, and its tokens with their counts and the tokens around them."""
    for frame in frames:
        out = []
        for host, html in zip(frame["host"], frame["__html"]):
            own: Counter = Counter()
            around: dict[int, int] = {}
            texts: tuple[list, list] = [], []
            for what, path, pieces, main, up in _units(html):
                if what == "tag":
                    found = [_tag_token(_tag_key(path, pieces[0]))]
                else:
                    line = _one_line(pieces)
                    if not line:
                        continue
                    texts[main].append(line)
                    found = [_text_token(path, line, True)] if main else [_text_token(path, x,
                        False) for x in (" ".join(p.split()) for p in pieces) if x]
                for token in found:
                    own[token] += 1
                    around[token] = _tag_token(up) if up else 0
            out.append((host, _long("\n".join(texts[1] or texts[0])), _long(html), list(own), list(own.values()), [around[t] for t in own]))
        yield pd.DataFrame(out, columns=["host", "key", "page", "token", "n", "up"])


def nested(tokens: list[tuple[int, int, tuple]]) -> list[int]:
    """The tokens of the valid classes among a host's frequent (token, token around it, vector): classes by vector, parted by the nearest class around them."""

    def size(group: list[int]) -> int:
        return sum(2 if t & _WORDS else 1 for t in group)

    up = {t: u for t, u, _ in tokens}
    classes: dict[tuple, list[int]] = defaultdict(list)
    for t, _, vector in tokens:
        classes[vector].append(t)
    of = {t: vector for vector, group in classes.items() if size(group) > 1 for t in group}
    parts: dict[tuple, list[int]] = defaultdict(list)
    for t, vector in of.items():
        seen, u = {t}, up[t]
        while u in up and u not in seen and of.get(u, vector) == vector:
            seen.add(u)
            u = up[u]
        parts[vector, of.get(u) if u not in seen else None].append(t)
    return [t for group in parts.values() if size(group) > 1 for t in group]


def _template_texts(main_pages: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = []
            for rows in frame["tokens"]:
                pages = {r["token"]: r["pages"] for r in rows}
                kept = nested([(r["token"], r["up"], (r["v0"], r["v1"], r["pages"])) for r in rows])
                texts.append(sorted(t for t in kept if t & _TEXT and (not t & _INSIDE or pages[t] >= main_pages)))
            yield pd.DataFrame({"host": frame["host"], "texts": texts})

    return run


def templates(pages: DataFrame, support: float = 0.5, least_pages: int = 3, main_pages: int = 8) -> DataFrame:
    """(host, text tokens) of the valid classes of each host; pages with the same text are one page."""
    each = pages.mapInPandas(_counted, "host string, key long, page long, token array<long>, n array<int>, up array<long>")
    texts = each.groupBy("host", "key").agg(F.min_by(F.struct("token", "n", "up"), "page").alias("p"))
    # counted by "p", so that both uses share one exchange and pages are parsed once
    counts = texts.groupBy("host").agg(F.count("p").alias("of"))
    rows = texts.select("host", "key", F.explode(F.arrays_zip("p.token", "p.n", "p.up")).alias("t")).select("host",
        F.col("t.token").alias("token"), F.col("t.up").alias("up"), F.xxhash64("key", "t.n").alias("vector"))
    # the vector hash is added up in two halves of 32 bits, which cannot overflow a long
    low, high = F.col("vector").bitwiseAND(2**32 - 1), F.shiftrightunsigned("vector", 32)
    tokens = rows.groupBy("host", "token").agg(F.count("*").alias("pages"), F.sum(low).alias("v0"), F.sum(high).alias("v1"),
        F.min("up").alias("up"))
    frequent = tokens.filter(F.col("pages") >= least_pages).join(counts, "host").filter(F.col("pages") >= support * F.col("of"))
    hosts = frequent.groupBy("host").agg(F.collect_list(F.struct("token", "up", "v0", "v1", "pages")).alias("tokens"))
    return hosts.mapInPandas(_template_texts(main_pages), "host string, texts array<long>")


def _blocks(html: str, template_text: frozenset) -> list[str]:
    main_blocks, other = [], []
    for what, path, pieces, main, _ in _units(html):
        if what == "tag":
            continue
        if template_text and main:
            pieces = [] if _text_token(path, _one_line(pieces), True) in template_text else pieces
        elif template_text:
            pieces = [x for x in pieces if _text_token(path, " ".join(x.split()), False) not in template_text]
        text = " ".join(html_lib.unescape("".join(pieces)).split())
        if text:
            (main_blocks if main else other).append(text)
    return main_blocks or other


def main_text_udf(rows: int = 200):
    """A column function of (html, template texts of its host)."""

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for htmls, texts in batches:
            out: list[str] = []
            for at in range(0, len(htmls), rows):
                for html, known in zip(htmls.slice(at, rows).to_pylist(), texts.slice(at, rows).to_pylist()):
                    out.append("\n".join(_blocks(html, frozenset(known or ()))))
            yield pa.array(out, type=pa.string())

    return F.arrow_udf(run, "string")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", support: float = 0.5,
    broadcast_hosts: int = 20_000, broadcast_tokens: int = 2_000_000) -> DataFrame:
    """page_id, url, text and n_chars of every page; Python sees html and template alone."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
        host_of(url_col).alias("host"), text_or_empty(html_col).alias("__html"))
    with arrow_rows(pages.sparkSession, 1000):
        found = frozen(templates(rows.select("host", "__html"), support))
    size = found.agg(F.count("*"), F.coalesce(F.sum(F.size("texts")), F.lit(0))).first()
    few = size[0] <= broadcast_hosts and size[1] <= broadcast_tokens
    joined = rows.join(F.broadcast(found), "host", "left") if few else join_hot(rows, found, "host", "left")
    return joined.select("page_id", "url", main_text_udf()("__html", "texts").alias("text")).withColumn("n_chars",
        F.length("text").cast("long"))
