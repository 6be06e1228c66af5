"""Main text of web pages by nearest-URL page differencing.

Pages are dealt out in ranges of the order of host and URL path, each range with copies of the WINDOW pages before and after it,
so that a page's neighbours are the pages of its host whose paths are nearest. Each page becomes a list of text lines (one for
each block). Neighbours are asked from the nearest path on until VOTERS of them have answered; near copies of the page (most of
its long lines are theirs too) have no vote, as they share the article. A voter's lines are aligned with the page's own by a
longest common subsequence, and a line is deleted

* at the page's edge, before the first or after the last line that stays: if most voters share it;
* between lines that stay: if all voters, LEAST_VOTERS at least, share it, as sentences too occur again.

Two kinds of evidence go before the alignment. Lines in elements that are never article text (menus, forms, scripts and so on) are
no lines, whatever their neighbours hold. Where a page marks its article (article, main), the lines in it are the page's lines; of
these only those are deleted that end the article of all of VOTERS voters too (it begins with its heading). Class names are the weakest evidence: a line that stands in an
element of such a class is left out unless nothing else is left of the page.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import Counter, deque
from collections.abc import Iterator
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import slices, small_batches

#: Bytes of html in a range of pages, or a mebibyte where that makes no more ranges than shuffle partitions; and ranges at most,
#: whose edges (three keys each) are broadcast.
RANGE_BYTES = 16 << 20
MAX_RANGES = 20_000
#: Characters of a path that are compared.
PATH_CHARS = 512
#: Pages to both sides that may be asked, voters that are enough, and voters without which no line between others goes.
WINDOW = 4
VOTERS = 5
LEAST_VOTERS = 3
#: Words of a long line. A page more than half of whose words in such lines are its neighbour's too is a near copy of it.
LONG_WORDS = 20
#: Bits of the alignment table that are kept at once; larger ones are halved.
TABLE_BITS = 1 << 25
#: fixed values: element names
_RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes"}
_DROP = {"nav", "header", "footer", "aside", "form", "button", "select", "svg", "dialog", "head", "canvas", "object", "audio", "video", "menu"}
_MAIN = {"article", "main"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "nobr", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "link", "meta"}
#: what a start tag ends: an open element of the key is closed by a start tag of the values
_CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
#: fixed values: names in class, id and role that mark what is not article text
_DROP_NAMES = {
    "ad", "ad-banner", "ad-container", "ad-slot", "adbox", "ads", "advert", "advertisement", "advertising", "adverts", "banner", "breadcrumb", "breadcrumbs", "complementary", "consent", "contentinfo",
    "cookie", "cookie-banner", "cookie-consent", "cookie-notice", "cookies", "footer", "gdpr", "header", "main-menu", "main-nav", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice",
    "notices", "page-footer", "page-header", "popup", "promo", "related", "related-articles", "related-posts", "search", "share", "share-buttons", "sharing", "sidebar", "site-footer", "site-header", "social",
    "social-share", "sponsor", "sponsored", "subscribe",
}
#: fixed values: names that mark reader comments, which may be marked as articles of their own
_COMMENT_NAMES = {"comment", "comment-list", "comment-section", "commentlist", "comments", "comments-area", "disqus", "disqus_thread", "replies", "reply"}
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|[^<]+|<", re.S)
_MARKS = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)(?:hidden(?=\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|style\s*=\s*[\"'][^\"']*display\s*:\s*none)", re.I)


def _marked(attributes: str) -> int:
    """2: hidden or reader comments; 1: a name that marks what is not article text; 0: neither. Names count whole."""
    if not attributes:
        return 0
    if _HIDDEN.search(attributes):
        return 2
    names = {w for m in _MARKS.finditer(attributes) for w in (m[1] or m[2] or m[3] or "").lower().split()}
    return 2 if names & _COMMENT_NAMES else 1 if names & _DROP_NAMES else 0


def lines(page: str) -> tuple[list[str], bool]:
    """Text lines of a page in which its article may be, and whether they are those of a marked article.

    Lines of elements that are never article text are left out. If any line is in a marked article (article, main), only those
    are. Lines under a name that marks other text (a menu's, a sidebar's) are left out in the same way, if others are left.
    """
    out: list[tuple[str, bool, int]] = []  # text, in a marked article, doubt
    stack: list[tuple[str, int, bool]] = []  # name, doubt, in a marked article
    open_: Counter[str] = Counter()  # names on the stack
    piece: list[str] = []
    doubt, main, raw_end = 0, False, -1

    def flush() -> None:
        if piece:
            if text := " ".join(html.unescape("".join(piece)).split()):
                out.append((text, main, doubt))
            piece.clear()

    def pop_to(i: int) -> None:
        nonlocal doubt, main
        open_.subtract(name for name, *_ in stack[i:])
        del stack[i:]
        doubt, main = stack[-1][1:] if stack else (0, False)

    for m in _TOKEN.finditer(page):
        if m.start() < raw_end:
            continue
        name = m[2]
        if name is None:
            if doubt < 2 and (s := m[0])[:2] not in ("<!", "<?"):
                piece.append(s)
            elif doubt < 2 and s.startswith("<![CDATA["):
                piece.append(html.escape(s[9:].removesuffix("]]>")))
            continue
        name = name.lower()
        if name not in _INLINE:
            flush()
        if m[1]:
            if open_[name]:
                pop_to(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name))
            continue
        if name in _RAW:
            end = re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, m.end())
            raw_end = end.end() if end else len(page)
            continue
        if name in _VOID:
            continue
        if name not in _INLINE:
            for i in range(len(stack) - 1, -1, -1):  # an open paragraph ends here
                if stack[i][0] == "p":
                    pop_to(i)
                    break
                if stack[i][0] not in _INLINE:
                    if name in _CLOSED_BY.get(stack[i][0], ()):
                        pop_to(i)
                    break
        marks = name in _MAIN or bool(re.search(r"role\s*=\s*[\"']?main\b", m[3], re.I))
        more = 2 if name in _DROP and not (name == "header" and main) else 0 if name in ("html", "body") else _marked(m[3])
        if more and name in _INLINE:
            more = 2  # part of a line is left out, or not
        doubt, main = max(doubt, more), main or marks
        stack.append((name, doubt, main))
        open_[name] += 1
    flush()
    for want in ((True, 0), (True, 1), (False, 0), (False, 1)):  # a marked article without doubt, if there is one
        kept = [t for t, marked, d in out if d <= want[1] and marked >= want[0]]
        if kept:
            return kept, want[0]
    return [], False


def _rows_of_table(a: list, b: list) -> list[int]:
    """Bit-parallel table of longest common subsequences: in row i, bit j is 0 where a[: i + 1] gains by b[j]."""
    places: dict = {}
    for j, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    v, rows = full, []
    for x in a:
        u = v & places.get(x, 0)
        v = ((v + u) | (v - u)) & full
        rows.append(v)
    return rows


def _lengths(a: list, b: list) -> np.ndarray:
    """Length of a longest common subsequence of a with each beginning of b."""
    places: dict = {}
    for j, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    v = full
    for x in a:
        u = v & places.get(x, 0)
        v = ((v + u) | (v - u)) & full
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate(([0], np.cumsum(bits == 0)))


def common(a: list[str], b: list[str]) -> set[int]:
    """Places in `a` of a longest common subsequence of two lists of lines; memory is linear in their lengths."""
    found: set[int] = set()
    parts = [(0, a, b)]
    while parts:
        base, x, y = parts.pop()
        lo, n, m = 0, len(x), len(y)
        while lo < n and lo < m and x[lo] == y[lo]:
            found.add(base + lo)
            lo += 1
        while n > lo and m > lo and x[n - 1] == y[m - 1]:
            n, m = n - 1, m - 1
            found.add(base + n)
        both = set(x[lo:n]) & set(y[lo:m])
        at = [i for i in range(lo, n) if x[i] in both]
        y = [t for t in y[lo:m] if t in both]
        if not at:
            continue
        if len(at) * len(y) > TABLE_BITS and len(at) > 1:  # halve, at the place of y where both halves together are longest
            half = len(at) // 2
            first, second = [x[i] for i in at[:half]], [x[i] for i in at[half:]]
            cut = int((_lengths(first, y) + _lengths(second[::-1], y[::-1])[::-1]).argmax())
            for places, some in ((at[:half], y[:cut]), (at[half:], y[cut:])):
                within = {base + places[i] for i in common([x[i] for i in places], some)}
                found |= within
            continue
        rows = _rows_of_table([x[i] for i in at], y)
        i, j = len(at), len(y)
        while i and j:
            if rows[i - 1] >> (j - 1) & 1:
                j -= 1
            else:
                i -= 1
                if not i or rows[i - 1] >> (j - 1) & 1:
                    found.add(base + at[i])
                    j -= 1
    return found


def same_end(a: list[str], b: list[str]) -> range:
    """Places in `a` of the common end of both."""
    n = min(len(a), len(b))
    return range(len(a) - next((i for i in range(n) if a[-1 - i] != b[-1 - i]), n), len(a))


def _words(text: str) -> int:
    return text.count(" ") + 1


def near_copy(own: list[str], other: list[str]) -> bool:
    """The same lines, or more than half of the words in own long lines are in lines of the other page."""
    if own == other:
        return True
    long = [t for t in own if _words(t) >= LONG_WORDS]
    if not long:
        return False
    held = set(other)
    return 2 * sum(_words(t) for t in long if t in held) > sum(map(_words, long))


def main_text(own: tuple[list[str], bool], neighbours: list[tuple[list[str], bool]]) -> str:
    """Text of a page given the lines of its neighbours, the nearest first. Where all lines would go, all stay."""
    kept, marked = own
    votes, voters = [0] * len(kept), 0
    for other, _ in neighbours:
        if voters == VOTERS:
            break
        if not other or near_copy(kept, other):
            continue
        voters += 1
        for i in same_end(kept, other) if marked else common(kept, other):
            votes[i] += 1
    enough = voters if marked else voters // 2 + 1
    lo, hi = 0, len(kept)
    if voters >= (VOTERS if marked else 1):
        while lo < hi and votes[lo] >= enough:
            lo += 1
        while hi > lo and votes[hi - 1] >= enough:
            hi -= 1
    if lo == hi:
        return " ".join(kept)
    between = not marked and voters >= LEAST_VOTERS
    return " ".join(kept[i] for i in range(lo, hi) if not (between and votes[i] == voters))


def _edges(keys: DataFrame, parts: int) -> tuple[list[tuple], list[tuple], list[tuple]]:
    """Of each of about `parts` ranges of equal size its first key, the last of its WINDOW first and the first of its WINDOW last."""
    names = keys.columns

    def ends(batches):
        first, last = [], deque(maxlen=WINDOW)
        for batch in batches:
            first += batch.slice(0, WINDOW - len(first)).to_pylist() if len(first) < WINDOW else []
            last.extend(batch.slice(max(0, batch.num_rows - WINDOW)).to_pylist())
        if first:
            rows = [first[0], first[-1], last[0]]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows]) for c in names] + [pa.array([TaskContext.get().partitionId()] * 3, pa.int32()), pa.array([0, 1, 2], pa.int32())], [*names, "part", "which"])

    schema = "host string, path string, number long, part int, which int"
    found = keys.repartitionByRange(parts, *names).sortWithinPartitions(*names).mapInArrow(ends, schema).toArrow().sort_by([("part", "ascending"), ("which", "ascending")])  # three rows for each range
    found = list(zip(*(found[c].to_pylist() for c in names), strict=True))
    return found[::3], found[1::3], found[2::3]


def extract(pages: DataFrame) -> DataFrame:
    """One row for each row of pages: page_id, url, text, n_chars.

    Null or empty html, and pages without article text, give empty text. Null urls are a host of their own. Repeated rows
    are pages next to themselves, and near copies of themselves. Only page_id, url and html are read. A host of any size is dealt
    over as many ranges as its share asks for.
    """
    host, path = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    rows = small_batches(pages).select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    key = {"host": F.left(F.coalesce(host, F.lit("")), F.lit(PATH_CHARS)), "path": F.left(F.coalesce(path, F.lit("")), F.lit(PATH_CHARS)), "number": F.coalesce("page_id", F.lit(-(1 << 63)))}
    rows = rows.withColumns(key)
    names = list(key)
    size = rows.agg(F.sum(F.octet_length("html")).alias("n")).first()["n"] or 0
    least = min(size >> 20, int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parts = max(1, least, min(MAX_RANGES, -(-size // RANGE_BYTES)))
    shared = pages.sparkSession.sparkContext.broadcast(_edges(rows.select(*names), parts))  # three keys for each range

    def deal(batches):
        first, head, tail = shared.value
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in names), strict=True))
            # the last WINDOW pages of a range are shown to the next range, the first to the one before
            to = []
            for i, k in enumerate(keys):
                r = bisect_right(first, k) - 1
                to.append((i, r, False))
                if r + 1 < len(first) and k >= tail[r] and first[r + 1][0] == k[0]:
                    to.append((i, r + 1, True))
                if r > 0 and k <= head[r]:
                    to.append((i, r - 1, True))
            rows, ranges, shown = zip(*to, strict=True) if to else ((), (), ())
            out = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(ranges, pa.int32()), pa.array(shown, pa.bool_())], [*out.schema.names, "range", "shown"])

    schema = "page_id long, url string, html string, host string, path string, number long, range int, shown boolean"
    rows = rows.mapInArrow(deal, schema).repartition(parts, "range").sortWithinPartitions("range", "host", "path", "number", "url")

    def each(batches) -> Iterator[tuple]:
        for batch in batches:
            for part in slices(batch, "html"):
                for row in part.to_pylist():
                    yield (row["range"], row["host"]), row["path"], lines(row.pop("html") or ""), row

    def texts(batches) -> Iterator[tuple]:
        near: deque[tuple] = deque(maxlen=2 * WINDOW + 1)  # pages before the one to be decided, it, and pages after it

        def decided(at: int) -> Iterator[tuple]:
            place, path, own, row = near[at]
            if not row["shown"]:
                others = [(-len(commonprefix((path, x[1]))), abs(i - at), i) for i, x in enumerate(near) if i != at and x[0] == place]
                text = main_text(own, [near[i][2] for *_, i in sorted(others)])
                yield row["page_id"], row["url"], text, len(text)

        waiting = 0
        for page in each(batches):
            near.append(page)
            waiting += 1
            if waiting > WINDOW:
                yield from decided(len(near) - waiting)
                waiting -= 1
        for left in range(waiting, 0, -1):
            yield from decided(len(near) - left)

    def run(batches):
        block: list[tuple] = []

        def flush():
            ids, urls, texts, sizes = zip(*block, strict=True)
            block.clear()
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(texts, pa.string()), pa.array(sizes, pa.int64())], ["page_id", "url", "text", "n_chars"])

        for row in texts(batches):
            block.append(row)
            if len(block) >= 256:
                yield flush()
        if block:
            yield flush()

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
