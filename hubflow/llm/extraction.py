"""HTML extraction by nearest-URL page differencing."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from hashlib import blake2b
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hubflow.llm.common import cut, whole

#: Fixed values of HTML: elements without content, without text to read, and those that end a line of text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style title textarea noscript template svg math iframe object canvas select head audio video".split())
#: Of these, the ones whose content is no markup: without an end tag they last to the end of the page.
RAW = frozenset("script style title textarea".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
#: End tags that authors leave out: their elements are not tracked.
LOOSE = frozenset("p li dt dd b i em strong u s a span font small big tt code br option tr td th thead tbody tfoot colgroup".split())
#: Elements, roles and words of class or id that mark what is not the article.
ASIDE = frozenset("nav footer aside form button dialog menu label".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
ASIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe teaser teasers toolbar topbar widget widgets".split()
)
#: Of these, the ones of what readers add, which has articles of its own.
READERS = frozenset("comment comments disqus replies reply respond".split())
#: Words that say nothing of a part's content: inside an article a class or id counts only if all its other words do.
NEUTRAL = frozenset(
    "area article articles bar block body bottom box button buttons card container content form group holder icons inline inner item left links list main module outer page panel post posts reader right section site slot stories story thread top unit user users wrap wrapper zone".split()
)

#: Words that make a class name one of a state ("has-sidebar", "comments-open") and not of a part of the page.
STATE_WORDS = frozenset("has with without no not is open closed enabled disabled free".split())

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
ATTRIBUTE = re.compile(r"""[\s/]*+(?:([^\s=>/]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+)))?|=)?""")
END_TAG = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in SILENT}
NOT_SHOWN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
PARTS = re.compile(r"[^a-z0-9]+")

#: What structure says of a line.
OUTSIDE, ARTICLE, ASIDE_LINE = 0, 1, 2
#: Apart, too, but by a class, an id or a form only, which may surround all of a page: an article inside still is one.
LOOSELY = 3
#: Pairs of equal lines up to which lines are aligned directly.
FEW = 20_000
#: Pages of a range of addresses that are sorted and paired together; a range has more where there would be more than RANGES.
PAIRED = 200
RANGES = 2000


def _apart(name: str, attributes: dict[str, str], in_article: bool) -> int:
    """ASIDE_LINE or LOOSELY for elements that hold what is not the article, else OUTSIDE.

    A class or id counts by its words, but not if it names a state, nor inside an article if it names something else as
    well ("related-work"); on ``article`` and ``main`` only as a whole or if it is of the readers, and on the page's root
    elements not at all.
    """
    if name in ASIDE or name == "header" and not in_article:
        return LOOSELY if name == "form" else ASIDE_LINE
    if not attributes:
        return OUTSIDE
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or NOT_SHOWN.search(attributes.get("style", "")) or attributes.get("role") in ASIDE_ROLES:
        return ASIDE_LINE
    if name in ("html", "body"):
        return OUTSIDE
    for token in (attributes.get("class", "") + " " + attributes.get("id", "")).split():
        words = set(PARTS.split(token)) - {""}
        if words & STATE_WORDS:
            continue
        if name in ("article", "main"):
            words = words & READERS or {token}
        elif in_article and any(w not in ASIDE_WORDS and w not in NEUTRAL and not w[-1].isdigit() for w in words):
            continue
        if words & ASIDE_WORDS or not in_article and "header" in words:
            return ASIDE_LINE if words & READERS else LOOSELY
    return OUTSIDE


def _article_of(articles: list[list[int]], outside: int) -> set[int]:
    """Which of the article and main elements make up the article of a page; each is (element around it, loosely apart, characters of its own).

    The one with the most characters (the first of these) and those around it: others are comments or other stories. One
    inside an element that is loosely apart comes in only if there is no other, and if it has as many as the page outside.
    """
    for loose in (0, 1):
        sizes = [size if apart == loose else 0 for _, apart, size in articles]
        if any(sizes) and (not loose or max(sizes) >= outside):
            n, kept = sizes.index(max(sizes)), set()
            while n >= 0:
                kept.add(n)
                n = articles[n][0]
            return kept
    return set()


def _tag_end(html: str, at: int) -> tuple[int, dict[str, str], bool]:
    """Where a tag ends whose name ends at ``at`` (-1: nowhere), its attributes in lower case, and whether it closes itself.

    A ``>`` inside a quoted value is no end. Attributes are read once from left to right, so the time is linear: a quote
    without a partner is looked for in vain only where no such quote follows.
    """
    end = html.find(">", at)
    if end < 0 or "=" not in (between := html[at:end]):
        return end, {"hidden": ""} if end >= 0 and "hidden" in between.lower().split() else {}, end > 0 and html[end - 1] == "/"
    found: dict[str, str] = {}
    while at < len(html):
        if html[at] == ">":
            return at, found, html[at - 1] == "/"
        m = ATTRIBUTE.match(html, at)
        if m[1]:
            found.setdefault(m[1].lower(), (m[2] or m[3] or m[4] or "").lower())
        at = m.end()
    return -1, found, False


def lines_of(html: str) -> tuple[list[str], list[int]]:
    """The lines of text of a page, and for each whether it lies in the article, apart from it, or in neither.

    Reads the page once from left to right. A tag that the page's end cuts off is no text; elements without text to
    read are skipped to their end tags, or, without one, only their tags are (but see ``RAW``).
    """
    lines: list[str] = []
    kinds: list[int] = []
    words: list[str] = []
    stack: list[tuple[str, int, int]] = []  # open elements, each with the kind and the article outside it
    articles: list[list[int]] = []
    owners: list[int] = []
    open_: dict[str, int] = defaultdict(int)
    endless: set[str] = set()
    kind, article, at, outside = OUTSIDE, -1, 0, 0

    def end_line() -> None:
        nonlocal outside
        if words:
            line = " ".join(unescape("".join(words)).split())
            words.clear()
            if line:
                lines.append(line)
                kinds.append(kind)
                owners.append(article)
                if kind == ARTICLE:
                    articles[article][2] += len(line)
                elif kind == OUTSIDE:
                    outside += len(line)

    while (tag := html.find("<", at)) >= 0:
        closing = html.startswith("/", tag + 1)
        m = NAME.match(html, tag + 1 + closing)
        if not m:
            declaration = html.startswith(("<!", "<?", "</"), tag)
            words.append(html[at : tag if declaration else tag + 1])
            if not declaration:
                at = tag + 1
                continue
            mark = "-->" if html.startswith("<!--", tag) else ">"
            end = html.find(mark, tag + 2)
            at = len(html) if end < 0 else end + len(mark)
            continue
        words.append(html[at:tag])
        name = m[0].lower()
        end, attributes, closed = _tag_end(html, m.end())
        at = len(html) if end < 0 else end + 1
        if end < 0:
            break
        if name in SILENT and not closing:
            if not (closed and name in ("svg", "math")) and name not in endless:
                over = END_TAG[name].search(html, at)
                if over:
                    at = over.end()
                elif name in RAW:
                    at = len(html)
                else:
                    endless.add(name)
            continue
        if name == "br":
            words.append(" ")
        if name in BLOCK:
            end_line()
        if name in VOID or name in LOOSE and not (attributes and not closing and kind < ASIDE_LINE and _apart(name, attributes, kind == ARTICLE)) and not open_[name]:
            continue
        if closing:
            if open_[name]:
                while True:
                    end_line()
                    n, kind, article = stack.pop()
                    open_[n] -= 1
                    if n == name:
                        break
        elif not closed:
            if name in LOOSE:  # a marked element, or one inside it of the same name
                end_line()
            stack.append((name, kind, article))
            open_[name] += 1
            main = name == "main" or attributes.get("role") == "main"
            if kind != ASIDE_LINE or main:  # a page has one main part, whatever its surroundings are called
                apart = _apart(name, attributes, kind == ARTICLE)
                if not apart and (main or name == "article"):
                    articles.append([article, int(not main and (kind == LOOSELY or article >= 0 and articles[article][1] == 1)), 0])
                    kind, article = ARTICLE, len(articles) - 1
                elif kind != LOOSELY or apart == ASIDE_LINE:
                    kind = apart or kind
    words.append(html[at:])
    end_line()
    kept = _article_of(articles, outside)
    return lines, [k if k == OUTSIDE else ARTICLE if k == ARTICLE and n in kept else ASIDE_LINE for k, n in zip(kinds, owners, strict=True)]


def _few_matches(a: list[str], b: list[str], first: int, found: set[int]) -> None:
    """Hunt and Szymanski (1977): time follows the number of equal pairs."""
    where = defaultdict(list)
    for j, x in enumerate(b):
        where[x].append(j)
    ends: list[int] = []
    chain: list[tuple] = []
    for i, x in enumerate(a):
        for j in reversed(where.get(x, ())):
            k = bisect_left(ends, j)
            link = (first + i, chain[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                chain.append(link)
            elif ends[k] != j:
                ends[k], chain[k] = j, link
    link = chain[-1] if chain else None
    while link:
        found.add(link[0])
        link = link[1]


def _lengths(a: list[str], b: list[str]) -> np.ndarray:
    """For each prefix of ``b`` the length of its longest common subsequence with ``a``; a word of bits at a time (Hyyro, 2004)."""
    bits: dict[str, int] = defaultdict(int)
    for j, x in enumerate(b):
        bits[x] |= 1 << j
    full = (1 << len(b)) - 1
    v = full
    for x in a:
        u = v & bits.get(x, 0)
        v = (v + u | v - u) & full
    zeros = 1 - np.unpackbits(np.frombuffer(v.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)].astype(np.int64)
    return np.concatenate([[0], np.cumsum(zeros)])


def common_lines(a: list[str], b: list[str]) -> set[int]:
    """Places in ``a`` of a longest common subsequence of lines.

    Equal ends are taken first. Where few lines are equal the rest is found directly; else ``a`` is halved and ``b`` cut
    where the halves share most (Hirschberg, 1975), so a page of very many equal lines takes little time and memory.
    """
    found: set[int] = set()
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, n, j, m = todo.pop()
        while i < n and j < m and a[i] == b[j]:
            found.add(i)
            i, j = i + 1, j + 1
        while i < n and j < m and a[n - 1] == b[m - 1]:
            n, m = n - 1, m - 1
            found.add(n)
        if i == n or j == m:
            continue
        times = Counter(b[j:m])
        if n - i == 1 or sum(times[x] for x in a[i:n]) <= FEW:
            _few_matches(a[i:n], b[j:m], i, found)
            continue
        half = (i + n) // 2
        total = _lengths(a[i:half], b[j:m]) + _lengths(a[half:n][::-1], b[j:m][::-1])[::-1]
        cut_at = j + int(np.argmax(total))
        todo += [(i, half, j, cut_at), (half, n, cut_at, m)]
    return found


def main_text(lines: list[str], kinds: list[int], partner: list[str] | None) -> str:
    """Deletes the lines that the partner shares, unless they lie in the article, and those that structure sets apart."""
    shared = common_lines(lines, partner) if partner else set()
    has_article = ARTICLE in kinds
    return "\n".join(x for n, (x, k) in enumerate(zip(lines, kinds, strict=True)) if k == ARTICLE or k == OUTSIDE and not has_article and n not in shared)


def _prefix(a: str | None, b: str | None) -> int:
    a, b, n = a or "", b or "", 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


#: What pages are sorted by.
ADDRESS = ("host", "path", "query", "page_id")


def _place(address: tuple) -> tuple:
    """Sorts addresses as Spark does, a null id first."""
    *names, page_id = address
    return (*names, page_id is not None, page_id or 0)


def _mark(lines: list[str]) -> int:
    """A hash of a page's lines."""
    return int.from_bytes(blake2b("\n".join(lines).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def range_bounds(rows: DataFrame, paired: int, ranges: int = RANGES) -> list[tuple]:
    """Addresses that cut the sorted pages into ranges of about ``paired``, from a sample of at least 8 a range."""
    total = rows.count()
    parts = min(-(-total // paired), ranges)
    if parts < 2:
        return []
    sample = rows.select(*ADDRESS).where(F.pmod(F.xxhash64(*ADDRESS), F.lit(total)) < 8 * parts).distinct().collect()
    places = sorted(_place(tuple(r)) for r in sample)
    return sorted({places[len(places) * k // parts] for k in range(1, parts)}) if places else []


def range_edges(slim: DataFrame) -> dict[tuple, list[int]]:
    """From ``range`` and the rows' ``ADDRESS`` and mark: which rows the ranges need from other ranges of their host.

    A range's first lines need the nearest page before it with other lines, its last lines the nearest after it. Of
    each range only the outermost row of a host and the outermost one with other lines come to the driver.
    """
    row = F.struct("path", "query", "page_id", "mark")
    ends = cut(slim.groupBy("host", "range").agg(F.min(row).alias("first"), F.max(row).alias("last")))
    wide = ends.groupBy("host").count().where("count > 1").select("host")
    ends = cut(ends.join(wide, "host", "left_semi"))  # at most two hosts a range
    inner = slim.join(F.broadcast(ends), ["host", "range"])
    inner = inner.groupBy("host", "range").agg(F.min(F.when(F.col("mark") != F.col("first.mark"), row)).alias("second"), F.max(F.when(F.col("mark") != F.col("last.mark"), row)).alias("last_but"))
    by_host = defaultdict(list)
    for r in ends.join(F.broadcast(inner), ["host", "range"]).collect():
        by_host[r["host"]].append(r)
    needs = defaultdict(list)
    for host, found in by_host.items():
        found.sort(key=lambda r: r["range"])
        for line, near, far, outer in ((found, "first", "last", "last_but"), (found[::-1], "last", "first", "second")):
            known = None
            for before, r in zip(line, line[1:]):
                if before[far]["mark"] != r[near]["mark"]:
                    known = before[far]
                elif before[outer] is not None:
                    known = before[outer]
                # else all of the range before has these lines, and what it needed is needed here
                if known is not None:
                    needs[(host, *known)].append(r["range"])
    return dict(needs)


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", paired: int = PAIRED) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars.

    1. Every page becomes its lines of text with what structure says of them (article, apart, neither).
    2. Pages of a host are sorted by URL path and query; each is paired with the neighbour whose path and query share
       the longer prefix (the one before on a tie). Neighbours with the very same lines show nothing, so on each side
       the nearest page with other lines is taken, however many copies lie between. The sorted pages of all hosts are cut into ranges of about ``paired``, so no host meets in one task.
       Pages at the end of a range are copied to the ranges that need them, so pairs don't depend on the ranges; for
       that, tables of more than one range are read twice.
    3. Lines are aligned by longest common subsequence and shared ones deleted. Differencing alone can't give right
       results: adverts differ from page to page, and articles repeat passages. So lines inside an article element
       stay, and lines that structure sets apart go. Of several article elements the largest is the article.

    Nulls: a null html is empty and gives an empty text; pages with a null or odd URL form a host of their own.
    Repeated rows stay. Other columns are ignored.
    """
    address = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)[^/?#]*([^?#]*)(\?[^#]*)?"
    url = F.coalesce(F.col(url_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.lower(F.regexp_extract(url, address, 1)).alias("host"), F.regexp_extract(url, address, 2).alias("path"), F.regexp_extract(url, address, 3).alias("query"), whole(html_col).alias("html"))
    bounds = range_bounds(rows, paired)

    def ranged(batch: pa.RecordBatch) -> tuple[list[tuple], list[int]]:
        addresses = list(zip(*[batch.column(c).to_pylist() for c in ADDRESS], strict=True))
        return addresses, [bisect_right(bounds, _place(a)) for a in addresses]

    def slim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [_mark(lines_of(x.as_py())[0]) for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ADDRESS], pa.array(marks, pa.int64()), pa.array(ranged(batch)[1], pa.int32())], [*ADDRESS, "mark", "range"])

    kinds_of_address = "host string, path string, query string, page_id long"
    needs = range_edges(cut(rows.drop("url").mapInArrow(slim, f"{kinds_of_address}, mark long, range int"))) if bounds else {}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = set()
        for batch in batches:
            found = [lines_of(x.as_py()) for x in batch.column("html")]
            marks = [_mark(x[0]) for x in found]
            addresses, at = ranged(batch)
            guests = []
            for n, key in enumerate(zip(addresses, marks, strict=True)):
                key = (*key[0], key[1])
                if key in needs and key not in sent:  # of equal rows one is enough
                    sent.add(key)
                    guests += [(n, k) for k in needs[key]]
            columns = [*[batch.column(c) for c in (*ADDRESS, "url")], pa.array(marks, pa.int64()), pa.array([x[0] for x in found], pa.list_(pa.string())), pa.array([x[1] for x in found], pa.list_(pa.int32()))]
            names = [*ADDRESS, "url", "mark", "lines", "kinds", "range", "guest"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(at, pa.int32()), pa.array([False] * len(at), pa.bool_())], names)
            if guests:
                which = pa.array([n for n, _ in guests], pa.int64())
                yield pa.RecordBatch.from_arrays([*[c.take(which) for c in columns], pa.array([k for _, k in guests], pa.int32()), pa.array([True] * len(guests), pa.bool_())], names)

    parsed = rows.mapInArrow(read, f"{kinds_of_address}, url string, mark long, lines array<string>, kinds array<int>, range int, guest boolean")
    dealt = parsed.withColumn("where", F.concat("path", "query"))
    order = [F.col(c) for c in ("path", "query", "page_id", "mark")]
    for side, by in (("before", order), ("after", [c.desc() for c in order])):
        # in a run of pages with the same lines all look at the row before the run
        near = Window.partitionBy("range", "host").orderBy(*by)
        starts = F.when(F.lag("mark").over(near) != F.col("mark"), F.struct(F.lag("where").over(near).alias("where"), F.lag("lines").over(near).alias("lines")))
        dealt = dealt.withColumn("starts", starts).withColumn(side, F.last("starts", ignorenulls=True).over(near.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("starts")
    paired_rows = dealt.where("NOT guest").select("page_id", "url", "where", "lines", "kinds", "before", "after")

    def difference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for r in batch.to_pylist():
                around = [r[k] for k in ("before", "after") if r[k] is not None]
                partner = max(around, key=lambda x: _prefix(x["where"], r["where"]))["lines"] if around else None
                texts.append(main_text(r["lines"], r["kinds"], partner))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return paired_rows.mapInArrow(difference, "page_id long, url string, text string, n_chars long")
