"""HTML extraction by nearest-URL page differencing.

Within a host, pages in order of their URL path have a previous and a next page; each is paired with the one that shares the longer path
beginning. The text lines of a pair are aligned by a longest common subsequence and the lines that both have are deleted: they belong to the
site, not to the page. What markup says goes first: lines of menus, footers, adverts and the like never count as text, and lines inside a page's
article are its own even if the nearest page, a copy perhaps, has them too. Differencing decides about all other lines, those beside an article too.

Pages are dealt out by ranges of (host, path), so a host with a third of all pages is split like any other stretch of keys; the pages at the ends of a
range go to its neighbour too, so the pairs do not depend on where ranges end."""
from __future__ import annotations

import bisect
import html
import math
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import input_bytes, tune

# Elements and names by the part they play.
RAW = "script style textarea title iframe".split()  # text up to the end tag
DROPPED = set("nav footer aside form button input label fieldset dialog menu audio video noscript template object svg math canvas select datalist".split())
INNER = set("article main".split())
BLOCKS = set("p div section article main header footer nav aside h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr caption blockquote pre figure figcaption address form fieldset hr body html details summary".split())
SPACED = set("br td th img wbr".split())
TRACKED = BLOCKS - {"p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "dt", "dd", "tr", "hr", "caption", "thead", "tbody", "tfoot", "html", "body"} | DROPPED
VOID = set("br hr img input wbr meta link base area col embed source track param".split())
NAMES = set("ads adv advert adverts advertisement banner sponsor sponsored promo promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs footer topbar cookie cookies gdpr popup modal newsletter subscribe signup share sharing related recommended widget comment comments respond disqus replies copyright pager pagination".split())
MILD = set("ad side header masthead consent notice notices overlay login search social legal tags".split())  # only where nothing else is in the name
AFFIXES = set("main site page post article top bottom left right inner outer box bar block list item items link links wrap wrapper container area section holder panel row col column group slot unit text title content card button buttons icon icons posts user bottom leaderboard primary secondary global js the wp area articles stories strip law policy form this reply thread modal message messages zone unit trigger toggle count".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alert".split())
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(" + "|".join(RAW) + r")\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*|[^>]*)>", re.S | re.I)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)

MOST_RANGES = 50_000  # bounds what the driver holds; a longer range is sorted on disk and read as a stream
OWN, OPEN = 1, 0  # a line of the article; a line about which markup says nothing


DROP, DOUBT = 2, 1


def names_part(value: str) -> int:
    """What the names in a class or id attribute say. DROP: one of them names a part that is not text, by all of its words, some of which may be affixes (`related-posts`, `site_header-2`). DOUBT: a name has such a word among
    others (`share-price`, `related-work`), and differencing decides. Neither `side-by-side` nor `ad-hoc` says anything."""
    says = 0
    for name in value.lower().split():
        words = [w for w in re.split(r"[-_]+|\d+", name) if w]
        known = any(w in NAMES for w in words)
        if (known or any(w in MILD for w in words)) and all(w in NAMES or w in MILD or w in AFFIXES for w in words):
            return DROP
        says = max(says, DOUBT * known)
    return says


def unwanted(tag: str, attributes: str, inside: bool) -> int:
    if tag in DROPPED or tag == "header" and not inside:
        return DROP
    if not attributes or tag in ("html", "body", "article", "main"):
        return 0
    says = 0
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id"):
            says = max(says, names_part(value))
        elif name == "role":
            if value.lower() in ROLES:
                return DROP
        elif name == "hidden" or value.lower() == "true":
            return DROP
    return says


def lines(page: str) -> list[tuple[int, str]]:
    """(kind, line) of every block of text in page order, without what markup rules out. Where a page has an article, its lines are OWN, but for parts whose name is in doubt; all others are OPEN.
    A head is left as it is: what stands in it has elements of its own that go, and its end tag may be missing."""
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # tag, dropped, inside an article, in doubt
    dropped = inside = doubt = False
    held: list[str] = []
    at = 0

    def cut() -> None:
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            held.clear()
            if text:
                out.append((OWN if inside and not doubt else OPEN, text))

    for m in TOKEN.finditer(page):
        if m.start() > at and not dropped:
            held.append(page[at : m.start()])
        at = m.end()
        if m[3] is None:
            continue
        tag = m[3].lower()
        if tag in BLOCKS:
            cut()
        elif tag in SPACED:
            held.append(" ")
        if m[2]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    _, dropped, inside, doubt = stack[-1] if stack else ("", False, False, False)
                    break
        elif tag not in VOID and not m[4].endswith("/"):
            says = 0 if dropped else unwanted(tag, m[4], inside)
            if says or tag in TRACKED or tag in INNER:
                dropped, inside, doubt = dropped or says == DROP, inside or tag in INNER, doubt or says == DOUBT
                stack.append((tag, dropped, inside, doubt))
    if at < len(page) and not dropped:
        held.append(page[at:])
    cut()
    return out


def common_lines(a: list[str], b: list[str]) -> set[int]:
    """Positions in a of a longest common subsequence of a and b, by bit-parallel dynamic programming. Rows of the table are kept at every so many lines and
    made again between, so that memory grows as the lines' number to the power 1.5."""
    also = set(a)
    b = [x for x in b if x in also]
    where: dict[str, int] = {}
    for k, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << k
    at = [k for k, x in enumerate(a) if x in where]
    every = max(1, math.isqrt(len(at)))
    full = (1 << len(b)) - 1

    def step(v: int, k: int) -> int:
        m = where[a[k]]
        u = v & m
        return ((v + u) | (v - u)) & full

    kept, v = [], full
    for i, k in enumerate(at):
        if i % every == 0:
            kept.append(v)
        v = step(v, k)
    i, j, out = len(at), len(b), set()
    rows: list[int] = []  # of the block that i is in: before its first line, after it, ...
    first = -1
    while i and j:
        if (i - 1) // every * every != first:
            first = (i - 1) // every * every
            rows = [kept[first // every]]
            for k in at[first : min(first + every, len(at))]:
                rows.append(step(rows[-1], k))
        if rows[i - first] >> (j - 1) & 1:
            j -= 1
        else:
            i -= 1
            if rows[i - first] >> (j - 1) & 1:
                j -= 1
                out.add(at[i])
    return out


def text_of(page: list[tuple[int, str]], other: list[tuple[int, str]] | None) -> str:
    """The page's text: all lines but those shared with the nearest page that are not the article's own."""
    shared: set[int] = set()
    at = [k for k, (kind, _) in enumerate(page) if kind == OPEN]
    if other is not None and at:
        shared = {at[k] for k in common_lines([page[k][1] for k in at], [x for _, x in other])}
    return "\n".join(x for k, (_, x) in enumerate(page) if k not in shared)


URL = re.compile(r"^(?:[a-zA-Z][\w+.-]*:)?//([^/?#]*)([^?#]*)")


def address(url: str | None) -> tuple[str | None, str]:
    """(host, path) of a URL; no host where there is none to compare by."""
    m = URL.match(url or "")
    return (m[1].lower(), m[2]) if m else (None, url or "")


def nearest(path: str, before: str | None, after: str | None) -> int:
    """-1 or 1: the neighbour whose path has the longer beginning in common; the previous one if equal. 0: no neighbour."""
    if before is None or after is None:
        return -1 if before is not None else 1 if after is not None else 0
    n = [next((k for k, (x, y) in enumerate(zip(path, p)) if x != y), min(len(path), len(p))) for p in (before, after)]
    return -1 if n[0] >= n[1] else 1


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", range_bytes: int = 2 << 20) -> DataFrame:
    """page_id, url, text, n_chars of every page. Null or empty html gives an empty text. A page without a host, or alone on its host, is
    compared with none; equal URLs are ordered by page_id (null first), then html. Rows may repeat."""
    spark = pages.sparkSession
    tune(spark)
    base = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), pages[html_col].cast("string").alias("html"))
    order = lambda i, u: ((a := address(u))[0] or "", a[1], i if i is not None else -(2**63))
    ranges = min(MOST_RANGES, max(1, int(input_bytes(base) // range_bytes)))
    # where ranges end, from a random sample; affects how pages are dealt out, not the result
    some = base.select("page_id", "url").orderBy(F.xxhash64("page_id", "url")).limit(20 * ranges).collect() if ranges > 1 else []
    keys = sorted(order(r.page_id, r.url) for r in some)
    bounds = [keys[len(keys) * k // ranges] for k in range(1, ranges)] if keys else []

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple] = {}
        for b in batches:
            for key in map(order, b.column(0).to_pylist(), b.column(1).to_pylist()):
                r = bisect.bisect_right(bounds, key)
                low, high = found.get(r, (key, key))
                found[r] = min(low, key), max(high, key)
        rows = [(r, *k) for r, both in found.items() for k in both]
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], t) for k, t in enumerate((pa.int32(), pa.string(), pa.string(), pa.int64()))], ["range", "host", "path", "page_id"])

    # the first and last page of each range also go to the range before and after
    seen: dict[int, tuple] = {}
    if bounds:
        e = base.select("page_id", "url").mapInArrow(ends, "range int, host string, path string, page_id long")
        key = F.struct("host", "path", "page_id")
        for r in e.groupBy("range").agg(F.min(key).alias("a"), F.max(key).alias("b")).collect():
            seen[r.range] = tuple(r.a), tuple(r.b)
    full = sorted(seen)
    guests: dict[tuple, list[int]] = {}
    for x, y in zip(full, full[1:]):
        guests.setdefault(seen[x][1], []).append(y)
        guests.setdefault(seen[y][0], []).append(x)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, u, h in zip(*(b.column(k).to_pylist() for k in range(3))):
                key, page = order(i, u), zlib.compress("\n".join(f"{k}{x}" for k, x in lines(h or "")).encode("utf-8", "replace"), 1)
                home = bisect.bisect_right(bounds, key)
                rows += [(home, key[0], key[1], i, u, True, page)] + [(g, key[0], key[1], i, u, False, page) for g in guests.get(key, [])]
            for k in range(0, len(rows), 256):
                yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in rows[k : k + 256]], t) for c, t in enumerate((pa.int32(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.binary()))], ["range", "host", "path", "page_id", "url", "own", "page"])

    def unpack(page: bytes) -> list[tuple[int, str]]:
        return [(int(x[0]), x[1:]) for x in zlib.decompress(page).decode().split("\n") if x]

    def difference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in batches:
                yield from zip(*(b.column(k).to_pylist() for k in range(7)))
            yield None

        out, before, cur = [], None, None
        for nxt in rows():
            if cur is not None and cur[5]:
                near = lambda x: x[2] if x is not None and x[:2] == cur[:2] and cur[1] else None
                side = nearest(cur[2], near(before), near(nxt))
                other = {-1: before, 1: nxt, 0: None}[side]
                text = text_of(unpack(cur[6]), unpack(other[6]) if other else None)
                out.append((cur[3], cur[4], text, len(text)))
                if len(out) == 256:
                    yield batch(out)
                    out = []
            before, cur = cur, nxt
        if out:
            yield batch(out)

    def batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], t) for c, t in enumerate((pa.int64(), pa.string(), pa.string(), pa.int64()))], ["page_id", "url", "text", "n_chars"])

    dealt = base.mapInArrow(read, "range int, host string, path string, page_id long, url string, own boolean, page binary")
    # several ranges a task, so that tasks are about even
    return dealt.repartition(max(1, ranges // 4), "range").sortWithinPartitions("range", "host", "path", F.col("page_id").asc_nulls_first(), "page").mapInArrow(difference, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
