"""Main text of web pages: nearest-URL page differencing.

A page is read into blocks (the text between block-level tags, references decoded, white space folded) in one of
three zones. ``main``: inside <article> or <main>. ``out``: scripts, styles, head, navigation, headers and footers of
the page, asides, forms, dialogs and whatever a class, id or role names as menu, notice, advert, share bar or reader
comments, within the main zone too. ``open``: all else.

Pages are dealt by ranges of (host, path, digest, id) and sorted, and each is paired with that neighbour of its host whose path
shares the longest beginning with its own (ties: the one before). Its neighbours are the nearest pages on either side with another digest: copies
of a page are looked past, are parsed once where they follow each other, and copies at one address get one text. The lines of the two pages beside their main zones are aligned
by a longest common subsequence, and what is shared is deleted as the site's own. Where a page has a main zone, its
text is that zone, and open lines are template or teasers; where it has none, its text is what is left of the open zone.
Lines of main zones are not differenced: two copies of one article on a host share every line, and the article would go.

Each range is also sent the last page before it and the first after it with another digest than its own first and last (found on
addresses, digests and ids alone), so that neighbours do not depend on the ranges. A page of any length is parsed as a whole, in time linear
in its length. Nulls: a null page is empty; a null URL has an empty host and path. Repeated ids and pages each give a row. An empty table gives no rows, other columns are ignored.
"""

from __future__ import annotations

import html as refs
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from os.path import commonprefix
from typing import NamedTuple
from urllib.parse import urlsplit

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialise, parts_for

#: Fixed by HTML: elements whose content is raw text, elements without content, and elements that end a line.
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
MAIN = frozenset(("article", "main"))
OUT = frozenset("nav aside footer header form dialog menu head button select svg canvas audio video object math template".split())
_NAMED = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|adsense|banner|sponsor\w*|promo\w*|cookie\w*|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscribe|"
    r"subscription|signup|login|nav|navbar|navigation|menu|breadcrumbs?|sidebar|side|widget|footer|masthead|topbar|toolbar|share|sharing|social|related|"
    r"recommend\w*|comments?|commentlist|respond|reply|replies|disqus|pagination|pager|skip)(?:$|[\s_-]|\d)",
    re.I,
)
_NAME = re.compile(r"</?[a-zA-Z]")
_NAME_END = re.compile(r"[\s/>]|\Z")
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_PIECE = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|[^<]+|<", re.S)
#: A name begins where no other name goes on, so that a long one is read once.
_ATTRIBUTE = re.compile(r"(?<![^\s=\"'<>/])([^\s=\"'<>/]++)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
#: Fixed by HTML: start tags that end an open element of the same group.
_ENDS_P = BLOCK - {"body", "html", "head", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "optgroup", "legend", "summary", "li", "dd", "dt"}


def _boilerplate(tag: str, attributes: str) -> bool:
    if tag in OUT:
        return True
    if not attributes or tag in ("html", "body") or tag in MAIN:
        return False
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), next((v for v in values if v), "")
        if name in ("class", "id") and _NAMED.search(refs.unescape(value)):
            return True
        if name == "role" and value.lower() in _ROLES or name == "aria-hidden" and value.lower() == "true":
            return True
    return bool(re.search(r"(?:^|\s)hidden(?:\s|=|$)", attributes))


def _tag_ends(page: str) -> dict[int, int]:
    """For each ``>`` and quote of the page: where a tag that is outside quotes there ends, -1 if it does not."""
    marks = [m.start() for m in re.finditer(r"[>\"']", page)]
    out: dict[int, int] = {}
    later = {'"': -1, "'": -1}  # the next quote of a kind
    after: dict[int, int] = {}  # the mark that follows a mark
    follows = -1
    for i in reversed(marks):
        after[i] = follows
        c = page[i]
        if c == ">":
            out[i] = i
        else:
            close = later[c]
            out[i] = -1 if close < 0 or after[close] < 0 else out[after[close]]
            later[c] = i
        follows = i
    return out


_MARK = re.compile(r"[>\"']")


def blocks(page: str) -> list[tuple[str, str]]:
    """(zone, text) of the blocks of a page, in order."""
    out: list[tuple[str, str]] = []
    held: list[str] = []
    stack: list[tuple[str, str]] = []  # (element, zone inside it)
    count: dict[str, int] = {}  # of open elements by name
    places: list[int] = []  # in the stack, of open blocks and paragraphs
    zone, at = "open", 0
    last = page.rfind(">")
    ends: dict[int, int] | None = None  # made once a tag was not ended

    def end() -> None:
        if held:
            text = " ".join("".join(held).split())
            if text:
                out.append((zone, text))
            held.clear()

    def leave(k: int) -> None:
        nonlocal zone
        for name, _ in stack[k:]:
            count[name] -= 1
        del stack[k:]
        while places and places[-1] >= k:
            places.pop()
        zone = stack[-1][1] if stack else "open"

    stop = mark = (0, -1)  # the last answers to where a name ends and where the next mark is: good from the first place to the second

    def opens(at: int) -> bool:
        """Whether the < here can begin a tag: none does that is not ended."""
        nonlocal stop, mark
        if at > last:
            return False
        if ends is None or not _NAME.match(page, at):
            return True
        first = at + 2 if page[at + 1] == "/" else at + 1
        if not stop[0] <= first <= stop[1]:
            stop = (first, _NAME_END.search(page, first).start())
        if not mark[0] <= stop[1] <= mark[1]:
            found = _MARK.search(page, stop[1])
            mark = (stop[1], found.start() if found else len(page))
        return ends.get(mark[1], -1) >= 0

    while at < len(page):
        if page[at] == "<" and not page.startswith(("<!--", "<![CDATA["), at) and not opens(at):
            held.append("<")
            at += 1
            continue
        m = _PIECE.match(page, at)
        if m[0] == "<" and ends is None and _NAME.match(page, at):
            ends = _tag_ends(page)
        at = m.end()
        closing, tag, attributes = m[1], m[2], m[3]
        if tag is None:
            piece = m[0]
            if piece.startswith("<![CDATA["):
                held.append(piece[9:].removesuffix("]]>"))
            elif not (piece.startswith("<!") or piece.startswith("<?")):
                held.append(refs.unescape(piece))
            continue
        tag = tag.lower()
        if closing:
            k = next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag) if count.get(tag) else None
            if tag in BLOCK:
                end()
            if k is not None:
                if any(stack[j][1] != zone for j in (k - 1,) if j >= 0) or (k == 0 and zone != "open"):
                    end()
                leave(k)
            continue
        if tag in BLOCK:
            end()
        elif tag == "br":
            held.append(" ")
        if tag in VOID:
            continue
        if tag in RAW and not attributes.rstrip().endswith("/"):
            close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at, last + 1)
            at = close.end() if close else len(page)
            continue
        if attributes.rstrip().endswith("/") and tag not in BLOCK:
            continue
        if tag in _ENDS_P:  # an open paragraph ends, with what was opened inside it
            if places and stack[places[-1]][0] == "p":
                leave(places[-1])
        inside = "out" if zone == "out" or _boilerplate(tag, attributes) and not (tag == "header" and zone == "main") else "main" if zone == "main" or tag in MAIN else "open"
        if inside != zone:
            end()
            zone = inside
        if tag == "p" or tag in BLOCK:
            places.append(len(stack))
        count[tag] = count.get(tag, 0) + 1
        stack.append((tag, inside))
    end()
    return out


def shared_lines(a: list[str], b: list[str]) -> set[int]:
    """Places in a of a longest common subsequence of a and b, found by its matches (Hunt and Szymanski) between their common beginning
    and their common end."""
    most = min(len(a), len(b))
    head = next((k for k in range(most) if a[k] != b[k]), most)
    tail = next((k for k in range(most - head) if a[-1 - k] != b[-1 - k]), most - head)
    out = {*range(head), *range(len(a) - tail, len(a))}
    where: dict[str, list[int]] = {}
    for j in range(len(b) - tail - 1, head - 1, -1):
        where.setdefault(b[j], []).append(j)
    ends: list[int] = []
    links: list[tuple] = []
    for i in range(head, len(a) - tail):
        line = a[i]
        for j in where.get(line, ()):
            k = bisect_left(ends, j)
            link = (i, links[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                links.append(link)
            elif j < ends[k]:
                ends[k], links[k] = j, link
    link = links[-1] if links else None
    while link:
        out.add(link[0])
        link = link[1]
    return out


def main_text(parsed: list[tuple[str, str]], neighbour: list[str] | None) -> str:
    """The main text of a parsed page; neighbour: the lines beside the main zone of the page it is paired with."""
    main = [t for z, t in parsed if z == "main"]
    if main:
        return "\n".join(main)
    gone = shared_lines([t for _, t in parsed], neighbour) if neighbour else set()
    return "\n".join(t for i, (z, t) in enumerate(parsed) if z == "open" and i not in gone)


_SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


class Page(NamedTuple):
    """A page that has been parsed; lines are those beside its main zone."""

    parsed: list[tuple[str, str]]
    lines: list[str]
    host: str
    path: str
    digest: bytes


def _address(url: str | None) -> tuple[str, str]:
    try:
        parts = urlsplit(url or "")
        return parts.netloc.lower(), parts.path
    except ValueError:
        return "", url or ""


def _text(here: Page, before: Page | None, after: Page | None, host: str, path: str) -> str:
    """The main text of a page at an address; before, after: the nearest other pages."""
    usable = [x for x in (before, after) if x is not None and x.host == host]
    pair = max(usable, key=lambda x: len(commonprefix([path, x.path])), default=None)
    return main_text(here.parsed, pair.lines if pair else None)


def _order(place: str, digest: bytes, page_id: int | None) -> tuple:
    """Spark's order of (place, digest, page_id)."""
    return (place.encode(errors="surrogatepass"), bytes(digest), page_id is not None, page_id or 0)


def _ranges(places: DataFrame, n: int) -> list[dict[str, tuple | None]]:
    """The first and the last (place, digest, page_id) of each of n ranges at most, in order, and the first and last with another digest than these."""
    key = F.struct("place", "digest", "page_id").alias("key")
    dealt = materialise(places.repartitionByRange(n, "place", "digest", "page_id").select(F.spark_partition_id().alias("part"), key), "html-ranges")
    ends = dealt.groupBy("part").agg(F.min("key").alias("first"), F.max("key").alias("last"))
    both = dealt.join(ends, "part")
    others = both.groupBy("part", "first", "last").agg(
        F.min(F.when(F.col("key.digest") != F.col("first.digest"), F.col("key"))).alias("then"), F.max(F.when(F.col("key.digest") != F.col("last.digest"), F.col("key"))).alias("till")
    )
    got = others.collect()  # four addresses a range
    return sorted(({c: None if r[c] is None else tuple(r[c]) for c in ("first", "last", "then", "till")} for r in got), key=lambda x: _order(*x["first"]))


def _guests(ranges: list[dict[str, tuple | None]]) -> list[tuple]:
    """(place, digest, page_id, range) of the pages of other ranges that each range needs: the nearest of another digest before its first and after its last page."""
    out = []
    for order, first, last, other in ((range(len(ranges)), "first", "last", "till"), (range(len(ranges) - 1, -1, -1), "last", "first", "then")):
        near = far = None  # the nearest page passed so far, and the nearest of another digest than that
        for k in order:
            own = ranges[k][first]
            for x in (near, far):
                if x is not None and x[1] != own[1]:
                    out.append((*x, k))
                    break
            end, rest = ranges[k][last], ranges[k][other]
            far = rest if rest is not None else near if near is not None and near[1] != end[1] else far
            near = end
    return out


def extract(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of each page."""
    spark = pages.sparkSession
    key = F.regexp_replace(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    source = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), source.alias("html"), F.split(key, "[?#]")[0].alias("place"), F.unhex(F.sha2(source, 256)).alias("digest"))
    n = parts_for(pages.select(url, html))
    ranges = _ranges(rows.select("place", "digest", "page_id"), n)
    starts = spark.sparkContext.broadcast([_order(*r["first"]) for r in ranges])

    @F.pandas_udf("int")
    def part_of(place: pd.Series, digest: pd.Series, page_id: pd.Series) -> pd.Series:
        return pd.Series([bisect_right(starts.value, _order(p, d, None if pd.isna(i) else int(i))) - 1 for p, d, i in zip(place, digest, page_id, strict=True)], dtype="int32")

    across = F.broadcast(spark.createDataFrame(_guests(ranges), "its_place string, its_digest binary, its_id long, part int"))
    same = (F.col("place") == F.col("its_place")) & (F.col("digest") == F.col("its_digest")) & F.col("page_id").eqNullSafe(F.col("its_id"))
    guests = rows.join(across, same).select(*rows.columns, "part", F.lit(True).alias("guest"))
    # The id as text: pandas would make doubles of ids among nulls.
    rows = rows.withColumn("part", part_of("place", "digest", F.col("page_id").cast("string"))).withColumn("guest", F.lit(False)).unionByName(guests)
    rows = rows.repartitionById(n, F.col("part")).sortWithinPartitions("part", "place", "digest", "page_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = here = None
        held: list[tuple] = []  # page_id, url, host and path of the copies of ``here`` that wait for the page after them
        at, out, size = None, [], 0

        def done(after: Page | None) -> None:
            nonlocal size
            texts: dict[tuple, str] = {}
            for page, link, host, path in held:
                if (host, path) not in texts:
                    texts.clear()
                    texts[host, path] = _text(here, before, after, host, path)
                text = texts[host, path]
                out.append({"page_id": page, "url": link, "text": text, "n_chars": len(text)})
                size += len(text)
            held.clear()

        def parsed(source: str, link: str | None, digest: bytes) -> Page:
            found = blocks(source)
            return Page(found, [t for z, t in found if z != "main"], *_address(link), digest)

        for batch in batches:
            for page, link, source, _, digest, part, guest in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if part != at:
                    done(None)
                    before, here, at = None, None, part
                if here is None or here.digest != digest:
                    after = parsed(source, link, digest)
                    done(after)
                    before, here = here, after
                elif (here.host, here.path) != _address(link):  # a copy elsewhere: the next page's neighbour is the nearer one
                    here = here._replace(host=_address(link)[0], path=_address(link)[1])
                if not guest:
                    held.append((page, link, *_address(link)))
                if size > 4 << 20 or len(out) > 2000:
                    yield pa.RecordBatch.from_pylist(out, schema=_SCHEMA)
                    out, size = [], 0
        done(None)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=_SCHEMA)

    return rows.select("page_id", "url", "html", "place", "digest", "part", "guest").mapInArrow(run, "page_id long, url string, text string, n_chars long")
