"""Main text of web pages by differencing each page with its nearest neighbour on the same host.

Pages are ordered by host and URL path, so the page with the longest common path is next to a page.
Both are cut into text lines, one per block element, and aligned by a longest common
subsequence. Lines that both share are the host's template and are deleted.

Two things differencing cannot know come from the markup, as the menus, adverts and footers of
many hosts change from page to page, while copied or quoted articles are alike: lines in elements
that are never an article (``nav``, ``footer``, ``aside``, forms, elements named as adverts, notices or
comments) are deleted even if no neighbour has them; prose in an element marked as the article stays
even if a neighbour has it too, so there only shared lines that are nothing but links go. On pages that
mark no article, every shared line goes, unless nothing would be left: then the neighbour is a copy, and
the neighbour on the other side is taken, or else nothing is deleted.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postgrain.llm.shared import bucket_of, picked, shuffle_partitions, slices

# --- lines of a page ----------------------------------------------------------------------------

#: Fixed by the HTML standard: elements that start and end a block, that have no end tag, and whose content is no text.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody "
    "tfoot thead tr ul caption".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
#: Elements that are ended by the next one of their kind, or by the next block.
ENDED_BY_NEXT = frozenset("p li dt dd option tr td th thead tbody tfoot".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements, roles and name parts that are no article text.
CHROME_TAGS = frozenset("nav footer aside noscript template svg math canvas select datalist button object audio video dialog "
                        "menu search map head label input".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form "
                         "status tooltip".split())
CHROME_PARTS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adslot adbox sponsor sponsored sponsors promo promos "
    "promotion banner cookie cookies consent gdpr notice notices notification notifications popup modal overlay toast newsletter "
    "subscribe subscription signup paywall sidebar sidebars sidenav menu menus submenu nav navbar navigation breadcrumb "
    "breadcrumbs pagination pager topbar toolbar footer masthead comment comments commentlist disqus respond replies related "
    "recommended recommendations share sharing social skip search login copyright disclaimer".split())
CHROME_NAMES = frozenset("widget widgets side tags meta byline".split())
#: Parts that say what an element goes with, not what it is: ``has-sidebar``.
ABOUT = frozenset("has with no without is not".split())
ARTICLE_NAME = re.compile(
    r"(?:article|post|entry|story|main|page|blog|news)[-_]?(?:body|content|contents|text|main)|content|main|article|post|story|text", re.I)

_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)((?:[^\"'>]++|\"[^\"]*+\"|'[^']*+')*+)>")
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
_ENDS = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I) for name in RAW}
_NONE, _FORM, _HEADER, _CHROME = range(4)


@dataclass(slots=True)
class Line:
    text: str
    chrome: bool
    rank: int  # 3 within an article, 2 within the main part, 1 within an element named so, else 0
    heading: bool
    links_only: bool


@lru_cache(maxsize=4096)
def _kind(tag: str, attributes: str) -> tuple[int, int]:
    """(why its text is none of the article's, rank) of an element by itself."""
    chrome = _CHROME if tag in CHROME_TAGS else _FORM if tag == "form" else _HEADER if tag == "header" else _NONE
    rank = {"article": 3, "main": 2}.get(tag, 0)
    if not attributes or attributes.isspace() or tag in ("html", "body"):
        return chrome, rank
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), next((v for v in values if v), "")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or (
                name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
            chrome = _CHROME
        elif name == "role":
            role = value.lower().strip()
            chrome = _CHROME if role in CHROME_ROLES else chrome
            rank = max(rank, {"main": 2, "article": 3}.get(role, 0))
        elif name == "itemprop" and value.lower() == "articlebody":
            rank = 3
        elif name in ("class", "id"):
            for one in value.split():
                parts = {p.lower() for p in _PART.findall(one)}
                if parts & ABOUT:
                    continue
                if parts & CHROME_PARTS or one.lower() in CHROME_NAMES:
                    chrome = _CHROME
                elif "header" in parts and chrome == _NONE:
                    chrome = _HEADER
                elif rank == 0 and ARTICLE_NAME.fullmatch(one):
                    rank = 1
    return chrome, rank


class _Reader:
    """Lines of a page, from its tags and the text between them."""

    def __init__(self):
        self.lines: list[Line] = []
        self.open: list[tuple[str, int, int]] = []  # tag, why not article text, rank
        self.count: Counter = Counter()
        self.parts: list[str] = []
        self.links = self.plain = False  # whether the line has text within links, and outside
        self.heading = ""

    def text(self, raw: str) -> None:
        if raw:
            self.parts.append(html.unescape(raw) if "&" in raw else raw)
            if not raw.isspace():
                if self.count["a"]:
                    self.links = True
                else:
                    self.plain = True

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                _, why, rank = self.open[-1] if self.open else ("", _NONE, 0)
                # a header within an article keeps its headings
                chrome = why in (_FORM, _CHROME) or why == _HEADER and not (rank and self.heading)
                self.lines.append(Line(text, chrome, rank, self.heading == "h1", self.links and not self.plain))
            self.parts.clear()
        self.links = self.plain = False

    def start(self, tag: str, attributes: str) -> None:
        if tag in BLOCKS:
            self.flush()
            self.heading = ""
            self.end_paragraph()
        if tag in ENDED_BY_NEXT and self.count[tag] and self.open[-1][0] == tag:
            self.pop()
        if tag in ("br", "td", "th"):
            self.parts.append(" ")
        if tag in VOID:
            return
        if tag in HEADINGS:
            self.heading = tag
        _, why, rank = self.open[-1] if self.open else ("", _NONE, 0)
        own, mark = (_kind if len(attributes) < 500 else _kind.__wrapped__)(tag, attributes)
        if mark and why == _FORM:  # some pages are one form
            why = _NONE
        self.open.append((tag, max(why, own), max(rank, mark)))
        self.count[tag] += 1

    def end_paragraph(self) -> None:
        """A paragraph cannot hold a block: it ends there, with what is open in it."""
        if self.count["p"]:
            for k in range(len(self.open) - 1, -1, -1):
                tag = self.open[k][0]
                if tag == "p":
                    while len(self.open) > k:
                        self.pop()
                if tag in BLOCKS:
                    return

    def end(self, tag: str) -> None:
        if tag in BLOCKS:
            self.flush()
        if tag in HEADINGS:
            self.heading = ""
        if self.count[tag]:
            while self.pop() != tag:
                pass

    def pop(self) -> str:
        tag = self.open.pop()[0]
        self.count[tag] -= 1
        return tag


def lines_of(page: str | None) -> list[Line]:
    """The text lines of a page in order: a line per block, white space made one blank, references decoded."""
    reader, page, at = _Reader(), page or "", 0
    while at < len(page):
        mark = page.find("<", at)
        if mark < 0:
            mark = len(page)
        reader.text(page[at:mark])
        found = _TAG.match(page, mark)
        if found:
            at, tag = found.end(), found[2].lower()
            if found[1]:
                reader.end(tag)
            elif tag in RAW:
                close = _ENDS[tag].search(page, at)
                at = close.start() if close else len(page)
            else:
                reader.start(tag, found[3])
        elif page.startswith("<!--", mark):
            close = page.find("-->", mark + 4)
            at = close + 3 if close >= 0 else len(page)
        elif page[mark + 1:mark + 2] in ("!", "?") or re.match(r"</?[A-Za-z]", page[mark:mark + 3]):
            close = page.find(">", mark)  # a declaration, or a tag with an odd quote
            at = close + 1 if close >= 0 else len(page)
        else:
            reader.text(page[mark:mark + 1])
            at = mark + 1
    reader.flush()
    return reader.lines


# --- alignment ----------------------------------------------------------------------------------

_BITS = 1 << 27  # the alignment keeps at most so many bits of its table


def _lengths(a: list, b: list) -> int:
    """Bit j is clear where the common subsequence of ``a`` and ``b[:j + 1]`` is longer than that of ``b[:j]``."""
    places: dict = {}
    for j, y in enumerate(b):
        places[y] = places.get(y, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full
    for x in a:
        hit = row & places.get(x, 0)
        row = (row + hit | row - hit) & full
    return row


def _steps(row: int, size: int) -> list[int]:
    """How many of the first 0, 1, ..., ``size`` bits are clear."""
    return list(accumulate((bit == "0" for bit in reversed(f"{row:0{size}b}")), initial=0))


def common(a: list, b: list) -> list[int]:
    """Places in ``a`` of a longest common subsequence of ``a`` and ``b``."""
    start, stop = 0, 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    while stop < min(len(a), len(b)) - start and a[-1 - stop] == b[-1 - stop]:
        stop += 1
    inner = range(start, len(a) - stop)
    ours, theirs = {a[k] for k in inner}, set(b[start:len(b) - stop])
    places = [k for k in inner if a[k] in theirs]
    middle = _middle([a[k] for k in places], [y for y in b[start:len(b) - stop] if y in ours])
    return [*range(start), *(places[k] for k in middle), *range(len(a) - stop, len(a))]


def _middle(a: list, b: list) -> list[int]:
    if not a or not b:
        return []
    if len(a) == 1:
        return [0] if a[0] in b else []
    if len(a) * len(b) > _BITS:  # halves, each with the part of the other list that suits it best
        half = len(a) // 2
        heads = _steps(_lengths(a[:half], b), len(b))
        tails = _steps(_lengths(a[half:][::-1], b[::-1]), len(b))[::-1]
        cut = max(range(len(b) + 1), key=lambda j: heads[j] + tails[j])
        return _middle(a[:half], b[:cut]) + [half + k for k in _middle(a[half:], b[cut:])]
    places: dict = {}
    for j, y in enumerate(b):
        places[y] = places.get(y, 0) | 1 << j
    full = (1 << len(b)) - 1
    rows = [full]
    for x in a:
        hit = rows[-1] & places.get(x, 0)
        rows.append((rows[-1] + hit | rows[-1] - hit) & full)
    out, j = [], len(b)
    for k in range(len(a) - 1, -1, -1):
        mask = (1 << j) - 1
        if (~rows[k + 1] & mask).bit_count() > (~rows[k] & mask).bit_count():
            out.append(k)  # matched with its last place among the first j
            j = (places[a[k]] & mask).bit_length() - 1
    return out[::-1]


# --- main text ----------------------------------------------------------------------------------


def main_lines(lines: list[Line]) -> tuple[list[int], bool]:
    """Places of the lines that may be article text, and whether the page marks its article."""
    kept = [k for k, line in enumerate(lines) if not line.chrome]
    best = max((lines[k].rank for k in kept), default=0)
    if not best:
        return kept, False
    return [k for k in kept if lines[k].rank == best or lines[k].heading and lines[k].rank >= min(best, 2)], True


def difference(lines: list[Line], neighbours: list[list[Line]]) -> list[str]:
    """The main text's lines; ``neighbours``: the lines of the pages on both sides, nearest first."""
    kept, marked = main_lines(lines)
    texts = [line.text for line in lines]
    for other in neighbours:
        shared = set(common(texts, [line.text for line in other]))
        if marked:
            return [texts[k] for k in kept if not (k in shared and lines[k].links_only)]
        rest = [texts[k] for k in kept if k not in shared]
        if rest:
            return rest
    return [texts[k] for k in kept]


# --- pages in the order of their URLs -----------------------------------------------------------

_URL = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """The host with its port, lowered; empty for a text that is no absolute URL, or null."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 2)


def _cuts(keys: DataFrame, buckets: int, sample: int = 64) -> list[str]:
    """At most ``buckets - 1`` rising keys that cut the rows into parts of about equal size.

    About ``sample`` keys a bucket are drawn by their hash: they only place rows, and change no result.
    """
    total = keys.count()
    share = min(1.0, sample * buckets / max(total, 1))
    drawn = keys.where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < int(share * (1 << 30))).select("key").collect()
    drawn = sorted((r.key for r in drawn), key=lambda k: k.encode())
    return sorted({drawn[len(drawn) * i // buckets] for i in range(1, buckets)}, key=lambda k: k.encode()) if drawn else []


_RESULT = "page_id long, url string, text string, n_chars long"
_KINDS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def main_texts(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages`` (page_id, url, html).

    ``text`` holds the lines of the main text joined by line breaks, ``n_chars`` its code points. A page's
    neighbours are those before and after it by host, path, URL and page_id; of the two on its host, the one that shares
    more leading path segments is the nearest, else the one before. Rows are dealt by ranges of that
    order, a range also gets the rows next to it, and a task holds three pages at a time.

    Null html: an empty text. Pages whose URL is null or has no host, or that are alone on their host, have no
    neighbour: they keep all lines that the markup does not rule out. Pages of one URL are each other's
    neighbours; repeated rows are all returned, and as copies delete nothing from one another. Other columns
    are ignored; an empty table gives an empty result.
    """
    spark = pages.sparkSession
    rows = picked(pages, "page_id", "url", "html").select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    number = F.coalesce(F.lpad(F.hex("page_id"), 16, "0"), F.lit(""))
    rows = rows.withColumn("key", F.concat_ws("\x01", host, path, F.coalesce("url", F.lit("")), number))
    cuts = _cuts(rows.select("key"), shuffle_partitions(spark))
    placed = rows.withColumn("bucket", bucket_of(F.col("key"), cuts))
    edges = placed.groupBy("bucket").agg(F.min("key").alias("low"), F.max("key").alias("high")).orderBy("bucket").collect()
    guests: dict[str, list[int]] = {}  # the keys at the edges of a range go to the ranges next to it
    for one, two in zip(edges, edges[1:], strict=False):
        guests.setdefault(one.high, []).append(two.bucket)
        guests.setdefault(two.low, []).append(one.bucket)
    hosts = spark.createDataFrame(list(guests.items()), "key string, also array<int>")  # two rows a range at most
    dealt = placed.join(F.broadcast(hosts), "key", "left").withColumn(
        "at", F.explode(F.concat(F.array("bucket"), F.coalesce("also", F.array().cast("array<int>")))))
    dealt = dealt.select("page_id", "url", "html", "key", F.xxhash64("html").alias("digest"),
                         (F.col("at") != F.col("bucket")).alias("guest"), "at")
    dealt = dealt.repartitionById(len(cuts) + 1, F.col("at")).sortWithinPartitions("key", "digest")
    return dealt.select("page_id", "url", "html", "key", "guest").mapInArrow(_extract, _RESULT)


@dataclass(slots=True)
class _Page:
    page_id: int | None
    url: str | None
    guest: bool
    host: str
    path: list[str]
    lines: list[Line]


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[_Page]:
    for batch in slices(batches, "html"):
        for row in batch.to_pylist():
            host, path = row["key"].split("\x01")[:2]
            yield _Page(row["page_id"], row["url"], row["guest"], host, path.split("/"), lines_of(row["html"]))


def _nearness(page: _Page, other: _Page) -> int:
    """Equal leading path segments."""
    same = 0
    for a, b in zip(page.path, other.path, strict=False):
        if a != b:
            break
        same += 1
    return same


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out, size = [], 0

    def written():
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _KINDS, strict=True)], schema=_KINDS)

    before, page = None, None
    for after in _chain(_pages(batches)):
        if page is not None and not page.guest:
            near = [o for o in (before, after) if o is not None and page.host and o.host == page.host]
            near.sort(key=lambda o: -_nearness(page, o))
            text = "\n".join(difference(page.lines, [o.lines for o in near]))
            out.append((page.page_id, page.url, text, len(text)))
            size += len(text)
            if size > 1 << 20:
                yield written()
                out, size = [], 0
        before, page = page, after
    if out:
        yield written()


def _chain(pages: Iterator[_Page]) -> Iterator[_Page | None]:
    yield from pages
    yield None
