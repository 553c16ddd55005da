"""The main text of web pages by differencing each page with its nearest neighbour.

A page is cut into blocks, and every block is a line of the comparison.  Within
each host, every URL path is paired with the path beside it in sorted order that
shares the longer prefix, and the lines of the two pages are aligned by their
longest common subsequence.  Shared lines are template and go.

Elements break the ties that two pages leave.  Lines in an ``article`` or
``main`` are aligned like all others but stay, as articles quote the same lines;
lines that differ from page to page go where their elements say that they are
menus, headers, footers, sidebars, notices, adverts, forms or comments: by names, by a list whose entries each have an author and a date, or,
for a content element, by text that is mostly links.  Lines outside of content
elements stay where these are cards beside a story or hold the minor part of the
text, or where there are none: see ``kept_lines``.

A page is parsed once; only hashes and sizes of its lines are compared.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import binary_views, materialize, prepare, utf8
from tessella.llm.urls import url_host, url_path

_MARKUP = re.compile(r"<(?:(?P<close>/?)(?P<name>[a-zA-Z][\w:-]*)|(?P<comment>!--)|[!?/])")
_TAG_END = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"(?<![\w:-])([\w:-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACE = re.compile(r"\s+")
_DIGITS = re.compile(r"\d+")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
#: Elements whose content is not markup; an end tag of the same name ends them.
_RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
#: Elements that hold no article text wherever they stand, and those that hold none unless the page stands in them.
DROPPED = frozenset("nav footer aside button input label head dialog menu audio video noscript template svg object canvas math select option datalist".split())
WRAPPERS = frozenset(("form",))
#: Elements that end a block where they begin and end.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
#: Elements that the next one of their kind ends.
_SIBLINGS = frozenset("li dt dd tr td th option".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTENT_ELEMENTS = frozenset(("article", "main"))
#: Class and id names made of these words, and of words that may stand beside them, mark what is not the article.
MARKS = frozenset(
    "ad ads adbox adsense advert adverts advertisement advertising banner banners breadcrumb breadcrumbs comment commentlist comments consent cookie cookies copyright "
    "disclaimer disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter newsletters notice notices overlay pager pagination popup popups promo "
    "promos promotion promotions related replies reply respond search share sharing sidebar sidebars signup skip social sponsor sponsored sponsors subscribe subscription "
    "tags teaser teasers toolbar topbar widget widgets".split()
)
#: Names that mark a content element as a card beside the story, and names of lists that are comments if their entries repeat.
CARDS, TALKS = frozenset("card cards preview previews tile tiles".split()), frozenset("discussion discussions feedback responses reviews talkback thread threads".split())
BESIDE_MARKS = frozenset(
    "area article articles aside bar block bottom box button buttons card col community container content cta footer form global google group icon icons inline inner item items left legal link links list "
    "main module more news outer page panel policy post posts primary reader readers right row secondary section site slot sticky stories story text thread threads title top unit user users visitor visitors wrap wrapper zone".split()
)
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Bytes of the rows of one alignment, and of kept line numbers that are broadcast at most.
ROW_BYTES, MAX_BROADCAST_BYTES = 32 << 20, 16 << 20
#: Depth of inline elements that a new paragraph looks through.
_INLINE = 64

#: Names of elements that say who wrote an entry of a list, and when.
_AUTHORS, _DATES = frozenset("author byline commenter user username nickname".split()), frozenset("date time timestamp datetime posted published".split())

#: Kinds of lines: marked as not the article; outside of content elements; paragraphs in a form outside of them.
#: From ``CONTENT`` on: in the first, second ... content element, two kinds each: plain, and marked or in a marked element.
MARKED, LOOSE, FORMED, CONTENT = range(4)


def _is_mark(name: str) -> bool:
    """Whether a class or id name is of marking words alone; ``search-page`` or ``with-sidebar`` say something of the page."""
    own = [w.lower() for w in _WORDS.findall(name)]
    return any(w in MARKS for w in own) and own[-1] != "page" and all(w in MARKS or w in BESIDE_MARKS or w.isdigit() for w in own)


class _Tag(NamedTuple):
    """What the attributes of a tag say."""

    marked: bool = False
    hidden: bool = False
    main: bool = False  #: the role of a content element
    talk: bool = False  #: a list that may be of comments
    author: bool = False
    date: bool = False
    look: str = ""  #: its classes without numbers: entries of a list look alike


def _attributes(name: str, rest: str) -> _Tag:
    marked = hidden = main = talk = author = date = False
    look = ""
    for attribute, *values in _ATTRIBUTE.findall(rest):
        attribute, value = attribute.lower(), "".join(values)
        if attribute == "class" or attribute == "id" and name not in _PROSE:
            names = value.split()
            marked = marked or any(map(_is_mark, names))
            if attribute == "class":
                words = {w.lower() for x in names for w in _WORDS.findall(x)}
                marked = marked or name in CONTENT_ELEMENTS and bool(words & CARDS)
                talk, author, date = talk or bool(words & TALKS), author or bool(words & _AUTHORS), date or bool(words & _DATES)
                look = " ".join(sorted(_DIGITS.sub("", x) for x in names))
        elif attribute == "role":
            marked, main = marked or value.lower() in ROLES, main or value.lower() == "main"
        elif attribute == "hidden" or attribute == "aria-hidden" and value.lower() == "true" or attribute == "style" and "display:none" in value.replace(" ", "").lower():
            hidden = True
    return _Tag(marked, hidden, main, talk, author, date, look)


class _Page:
    """A page's text and where its tags end, in time linear in its length."""

    def __init__(self, text: str):
        self.text, self.lower, self.last, self.unpaired = text, text.lower(), {}, set()

    def tag_end(self, at: int) -> int:
        """The place after the ``>`` of the tag whose attributes begin at ``at``; -1 if there is none.  A quote that nothing closes is a plain character."""
        while m := _TAG_END.search(self.text, at):
            if (quote := m[0]) == ">":
                return m.end()
            at = m.end()
            if self.text[m.start() - 1] in "= " and quote not in self.unpaired:
                close = self.text.find(quote, at)
                if close < 0:
                    self.unpaired.add(quote)
                else:
                    at = close + 1
        return -1

    def closes(self, name: str, at: int) -> bool:
        """Whether an end tag of ``name`` follows ``at``."""
        if name not in self.last:
            self.last[name] = self.lower.rfind(f"</{name}")
        return self.last[name] >= at


class _Element(NamedTuple):
    """What an open element says of the text in it."""

    name: str = ""
    dropped: bool = False  #: no article text wherever it stands
    skipped: bool = False  #: an inline element that is dropped: its text is no line of its own
    marked: bool = False
    content: int = 0  #: number of the outermost content element, from 1
    form: bool = False
    prose: bool = False
    list: _List | None = None  #: what its entries have been so far, if it is a block
    entry: _List | None = None  #: the list that it is an entry of
    look: str = ""


class _List:
    """The lines of an element's entries, by their looks, and how many of these name an author and a date."""

    __slots__ = ("first", "talk", "lines", "signed", "author", "date")

    def __init__(self, first: int, talk: bool):
        self.first, self.talk, self.lines, self.signed, self.author, self.date = first, talk, None, None, False, False

    def close_entry(self, look: str, first: int, end: int) -> None:
        if look:
            if self.lines is None:
                self.lines, self.signed = {}, Counter()
            self.lines.setdefault(look, []).append((first, end))
            self.signed[look] += self.author and self.date
        self.author = self.date = False

    def comments(self, end: int) -> list[tuple[int, int]]:
        """The lines that are comments: of entries that look alike and are all signed; all, if the list says that it is talk and has entries that look alike."""
        alike = {look: own for look, own in (self.lines or {}).items() if len(own) > 1}
        if self.talk and alike:
            return [(self.first, end)]
        return [lines for look, own in alike.items() if self.signed[look] == len(own) for lines in own]


def blocks(page: str) -> list[tuple[int, str]]:
    """The blocks of a page in order: their kind and their text, with white space and character references resolved."""
    out: list[tuple[int, str]] = []
    stack: list[_Element] = []
    open_names: Counter = Counter()
    parts: list[str] = []
    held, elements, at, now = _Page(page), 0, 0, _Element()
    linked: Counter = Counter()  # characters of each content element, all (n) and in links (-n)

    def flush() -> None:
        if parts:
            text = _SPACE.sub(" ", entities.unescape("".join(parts))).strip()
            parts.clear()
            if text:
                if now.dropped or now.marked and not now.content:
                    kind = MARKED
                elif now.content:
                    kind = CONTENT + 2 * (now.content - 1) + (now.marked or now.form)
                else:
                    kind = LOOSE if not now.form else FORMED if now.prose else MARKED
                out.append((kind, text))

    def cut(depth: int) -> None:
        nonlocal now
        while len(stack) > depth:
            gone = stack.pop()
            open_names[gone.name] -= 1
            if gone.list is not None:
                for first, end in gone.list.comments(len(out)):
                    out[first:end] = [(MARKED, text) for _, text in out[first:end]]
                if gone.entry is not None:
                    gone.entry.close_entry(gone.look, gone.list.first, len(out))
        now = stack[-1] if stack else _Element()

    def said(text: str) -> None:
        parts.append(text)
        if now.content:
            size = len(text.strip())
            linked[now.content] += size
            if open_names["a"] > 0:
                linked[-now.content] += size

    def signs(tag: _Tag, name: str) -> None:
        """An author or a date, in the nearest entry of each list around it."""
        if tag.author or tag.date or name == "time":
            for element in stack[-_INLINE:]:
                if element.entry is not None:
                    element.entry.author |= tag.author
                    element.entry.date |= tag.date or name == "time"

    while m := _MARKUP.search(page, at):
        if m.start() > at and not now.skipped:
            said(page[at : m.start()])
        name = (m["name"] or "").lower()
        if not name:
            end = page.find("-->" if m["comment"] else ">", m.end())
            at = len(page) if end < 0 else end + (3 if m["comment"] else 1)
            continue
        end = held.tag_end(m.end())
        if end < 0:  # no tag, but text with a less-than sign
            at = m.start()
            break
        rest, at = page[m.end() : end - 1], end
        if name == "br":
            parts.append(" ")
            continue
        inline = name not in BLOCKS
        if m["close"]:
            if not inline:
                flush()
            if open_names[name]:
                depth = len(stack) - 1
                while stack[depth].name != name:
                    depth -= 1
                cut(depth)
            continue
        if name in _RAW:
            if held.closes(name, at):
                at = held.lower.index(f"</{name}", at)
            elif name in ("script", "style"):
                at = len(page)
            continue
        if not inline:
            flush()
            if name == "body" or now.name == "head":
                cut(0)
            depth, least = len(stack) - 1, max(0, len(stack) - _INLINE)
            while depth >= least and stack[depth].name not in BLOCKS:
                depth -= 1
            if depth >= least and (stack[depth].name == "p" or stack[depth].name == name and name in _SIBLINGS):
                cut(depth)
        if name in _VOID or rest.endswith("/") and name not in CONTENT_ELEMENTS and (inline or not held.closes(name, at)):
            continue
        tag = _attributes(name, rest) if rest.strip() and name not in ("html", "body") else _Tag()
        drops = tag.hidden or name in DROPPED or name == "header" and not now.content
        if inline:
            signs(tag, name)
            skips = drops or tag.marked or now.skipped and open_names[name]
            if (skips or name == "a") and held.closes(name, at):
                stack.append(now._replace(name=name, skipped=now.skipped or bool(skips), list=None, entry=None))
                open_names[name] += 1
                now = stack[-1]
            continue
        is_content = (name in CONTENT_ELEMENTS or tag.main) and not now.content
        elements += is_content
        inner = bool(now.content) and (tag.marked or name in WRAPPERS)
        above = now.list
        stack.append(_Element(
            name, now.dropped or drops or inner, now.skipped, now.marked or tag.marked, now.content or (elements if is_content else 0), now.form or name in WRAPPERS, now.prose or name in _PROSE,
            _List(len(out), tag.talk), above, f"{name} {tag.look}" if (tag.look or name in _SIBLINGS) and (name not in CONTENT_ELEMENTS or above and above.talk) and name not in _PROSE else "",
        ))
        signs(tag, name)
        open_names[name] += 1
        now = stack[-1]
    if at < len(page) and not now.skipped:
        said(page[at:])
    flush()
    cut(0)
    cards = {n for n in linked if n > 0 and 2 * linked[-n] > linked[n]}
    is_card = lambda kind: kind >= CONTENT and (kind - CONTENT) // 2 + 1 in cards
    return [(kind + (kind % 2 == CONTENT % 2) if is_card(kind) else kind, text) for kind, text in out]


def kept_lines(kinds: list[int], sizes: list[int], gone: set[int]) -> list[int]:
    """The numbers of the lines of the main text, from their kinds and sizes and the numbers of those that the neighbour shares.

    A marked content element that holds more than all else that may stay is the
    article in a marked wrapper, and so are paragraphs of a form that do.  Lines
    outside of content elements stay where they hold more than twice the text of
    the largest of these; if there are several, these are then cards and go.
    """
    total: Counter = Counter()
    for i, (kind, size) in enumerate(zip(kinds, sizes)):
        total[kind] += size if kind >= CONTENT or i not in gone else 0
    plain = {k for k in total if k >= CONTENT and k % 2 == CONTENT % 2}
    inside, outside = set(plain), {LOOSE}
    main = max((k for k in total if k >= CONTENT and k not in plain), key=lambda k: (total[k], -k), default=None)
    if main is not None and 2 * total[main] > sum(total[k] for k in total if k >= CONTENT) + total[LOOSE]:
        inside.add(main)
    if total[FORMED] > total[LOOSE] + sum(total[k] for k in inside):
        outside.add(FORMED)
    if sum(total[k] for k in outside) <= 2 * max((total[k] for k in inside), default=0):
        outside = set()
    elif len(inside) > 1:
        inside = set()
    return [i for i, kind in enumerate(kinds) if kind in inside or kind in outside and i not in gone]


def _lcs(a: list[int], b: list[int]) -> list[int]:
    """Places in ``a`` of a longest common subsequence with ``b``, by bit-parallel rows."""
    rows = _rows(a, b)
    length = lambda i, j: j - (rows[i] & ((1 << j) - 1)).bit_count()
    i, j, out = len(a), len(b), []
    while i and j:
        n = length(i, j)
        if length(i - 1, j) == n:
            i -= 1
        elif length(i, j - 1) == n:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append(i)
    return out[::-1]


def _rows(a: list[int], b: list[int], last: bool = False) -> list[int]:
    """The bit vector of each row (or of the last one); a place of ``b`` where the length grows has a 0."""
    masks: dict[int, int] = {}
    for j, x in enumerate(b):
        masks[x] = masks.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    rows = [full]
    for x in a:
        v = rows[-1]
        hit = v & masks.get(x, 0)
        rows.append(((v + hit) | (v - hit)) & full)
        if last:
            del rows[0]
    return rows


def _lengths(a: list[int], b: list[int]) -> list[int]:
    """The length of the longest common subsequence of ``a`` with each prefix of ``b``."""
    row, out = bin(_rows(a, b, last=True)[0] | 1 << len(b))[:2:-1], [0]
    for bit in row:
        out.append(out[-1] + (bit == "0"))
    return out


def shared(a: list[int], b: list[int]) -> list[int]:
    """Places in ``a`` of a longest common subsequence with ``b``.

    Common ends go first, and lines that the other page does not have.  Where
    the rows would take over ``ROW_BYTES``, ``a`` is halved and ``b`` cut where the
    two halves reach the longest sum.
    """
    low = 0
    while low < min(len(a), len(b)) and a[low] == b[low]:
        low += 1
    high = 0
    while high < min(len(a), len(b)) - low and a[-1 - high] == b[-1 - high]:
        high += 1
    in_a, in_b = set(a[low : len(a) - high]), set(b[low : len(b) - high])
    places = [i for i in range(low, len(a) - high) if a[i] in in_b]
    left, right = [a[i] for i in places], [x for x in b[low : len(b) - high] if x in in_a]
    if len(left) < 2 or len(left) * len(right) // 8 <= ROW_BYTES:
        middle = _lcs(left, right)
    else:
        half = len(left) // 2
        sums = [x + y for x, y in zip(_lengths(left[:half], right), reversed(_lengths(left[:half - 1 : -1], right[::-1])))]
        split = sums.index(max(sums))
        middle = shared(left[:half], right[:split]) + [half + i for i in shared(left[half:], right[split:])]
    return [*range(low), *(places[i] for i in middle), *range(len(a) - high, len(a))]


def line_hashes(lines: list[str]) -> list[int]:
    return [xxhash.xxh3_64_intdigest(x.encode("utf-8", "replace")) - (1 << 63) for x in lines]


def _beside(paths: DataFrame) -> DataFrame:
    """``paths`` (host, path, lines; distinct host and path) with ``other``, the lines of the nearest path of the host.

    The path before and the path after are looked at; one with the same lines is
    a copy and no neighbour.
    The paths are sorted over ranges; the rows at the ends of a range are shown
    to the ranges beside it, so no host has to fit in one task.
    """
    ranged = materialize(paths.repartitionByRange("host", "path").withColumn("part", F.spark_partition_id()), "ranged")
    row = F.struct("host", "path", "lines")
    ends = ranged.groupBy("part").agg(F.min(row).alias("low"), F.max(row).alias("high"))
    by_part = Window.orderBy("part")
    ends = ends.withColumn("before", F.lag("high").over(by_part)).withColumn("after", F.lead("low").over(by_part))
    guests = ends.select("part", F.explode(F.array("before", "after")).alias("row")).where("row is not null").select("row.*", "part", F.lit(True).alias("guest"))
    in_order = Window.partitionBy("part").orderBy("host", "path")
    both = ranged.withColumn("guest", F.lit(False)).unionByName(guests)
    both = both.withColumn("prev", F.lag(row).over(in_order)).withColumn("next", F.lead(row).over(in_order)).where("not guest")

    def common(side: str) -> Column:
        p, q = F.split(F.col("path"), ""), F.split(F.col(f"{side}.path"), "")
        same = F.aggregate(F.zip_with(p, q, lambda x, y: x.eqNullSafe(y)), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, e: F.struct((s["n"] + (s["on"] & e).cast("int")).alias("n"), (s["on"] & e).alias("on")))
        return F.when((F.col(f"{side}.host") == F.col("host")) & (F.col(f"{side}.lines") != F.col("lines")), same["n"]).otherwise(-1)

    near = both.withColumn("p", F.coalesce(common("prev"), F.lit(-1))).withColumn("n", F.coalesce(common("next"), F.lit(-1)))
    other = F.when((F.col("p") >= F.col("n")) & (F.col("p") >= 0), F.col("prev.lines")).when(F.col("n") >= 0, F.col("next.lines"))
    return near.select("host", "path", other.alias("other")).where("other is not null")


def _rows_of(pages: DataFrame, key: str, url: str, html: str) -> DataFrame:
    """Rows (key, url, page_key, host, path, lines, kinds, sizes, alone, whole), one per page: a hash, the kind and the code points of each line, the numbers of those that the elements alone keep, and all lines as one text."""
    prepare(pages.sparkSession)
    kind = f"key {dict(pages.dtypes)[key]}, url string, page_key string, host string, path string, lines array<long>, kinds array<int>, sizes array<int>, alone array<int>, whole string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [blocks(page.decode("utf-8", "replace")) for page in binary_views(batch.column(5))]
            numbers = [[[x for x, _ in own], [len(t) for _, t in own]] for own in found]
            lines = pa.array([line_hashes([t for _, t in own]) for own in found], pa.list_(pa.int64()))
            kinds, sizes, alone = (pa.array(x, pa.list_(pa.int32())) for x in ([k for k, _ in numbers], [n for _, n in numbers], [kept_lines(k, n, set()) for k, n in numbers]))
            whole = pa.array(["\n".join(t for _, t in own) for own in found], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], lines, kinds, sizes, alone, whole], names=["key", "url", "page_key", "host", "path", "lines", "kinds", "sizes", "alone", "whole"])

    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), page_key(url, html), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"), utf8(html).alias("html"))
    return rows.mapInArrow(run, kind)


def _distinct(rows: DataFrame) -> DataFrame:
    return rows.select("page_key", "host", "path", "lines", "kinds", "sizes").dropDuplicates(["page_key"])


def parsed(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Rows (page_key, host, path, lines, kinds, sizes) of the distinct pages: a hash, the kind and the code points of each line."""
    return _distinct(_rows_of(pages, url, url, html))


def differenced(rows: DataFrame) -> DataFrame:
    """Rows (page_key, gone, kept) for the pages of ``rows`` (as ``parsed`` gives them) that share lines with their nearest neighbour.

    ``gone`` are the numbers of the shared lines and ``kept`` those of the main
    text, null where the elements alone would have kept the same.  Pages with
    equal host and path are differenced with the same neighbour, not with each other.
    """
    other = materialize(_beside(rows.groupBy("host", "path").agg(F.min("lines").alias("lines"))), "beside")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone, kept = [], []
            for a, kinds, sizes, b in zip(*(c.to_pylist() for c in batch.columns[1:])):
                gone.append(shared(a, b))
                own = kept_lines(kinds, sizes, set(gone[-1]))
                kept.append(own if own != kept_lines(kinds, sizes, set()) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.list_(pa.int32())) for x in (gone, kept))], names=["page_key", "gone", "kept"])

    pairs = rows.join(other, ["host", "path"]).select("page_key", "lines", "kinds", "sizes", "other")
    return pairs.mapInArrow(align, "page_key string, gone array<int>, kept array<int>").where(F.size("gone") > 0)


def page_key(url: str, html: str) -> Column:
    zero = F.lit("\0")
    return F.md5(F.concat(F.coalesce(F.col(url), zero), zero, F.coalesce(F.col(html), F.lit(""))).cast("binary")).alias("page_key")


def extract_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Rows (key, url, text, n_chars), one per row of ``pages``.

    Blocks are joined by one newline; character references are decoded, white
    space inside a block becomes one space.  Null or empty HTML, and pages
    without article text, give an empty text.  Null URLs share the empty host.
    A page whose host has no other path, or only copies beside it, is not
    differenced.  Extra columns are ignored.
    """
    rows = materialize(_rows_of(pages, key, url, html), "pages", codec="zstd")
    differing = differenced(_distinct(rows)).where("kept is not null").select("page_key", "kept")
    differing = materialize(differing, "differing")
    n, numbers = differing.agg(F.count("*"), F.coalesce(F.sum(F.size("kept")), F.lit(0))).first()
    differing = F.broadcast(differing) if 50 * n + 4 * numbers <= MAX_BROADCAST_BYTES else differing
    found = rows.join(differing, "page_key", "left").withColumn("cut", F.split("whole", "\n", -1)).withColumn("keep", F.coalesce("kept", "alone"))
    text = F.array_join(F.transform("keep", lambda i: F.get("cut", i)), "\n")
    out = found.select(F.col("key").alias(key), F.col("url").alias(url), text.alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
