"""Main text of HTML pages: markup zones, and nearest-URL page differencing where markup says nothing.

A page's blocks become text lines with a zone: main (inside an article or main element), dropped
(menus, headers, footers, sidebars, notices, adverts, forms, scripts, comments, by element, role
or class words) or open (neither). Main lines are text; open lines, of every page, are differenced:
pages are paired with the neighbours by URL path on the same host, lines are aligned by longest
common subsequence, and open lines shared with either neighbour are deleted. Differencing alone does
not give right results (the README has figures): pages repeat their articles as often as their
menus, so lines that the markup decides are left to it.

Class words and forms drop softly, as wrappers of whole pages have them too: a main element in them is
main again, and so is an article, but where the word names other texts (comments, teasers, adverts)
only if the page has no main line besides. A page with no line outside them keeps their lines as open.

Pairing sorts only (host, path, key), by range, so a host with a third of all pages is split like
any other; pages move only where they need their neighbours' line hashes.

Defined cases: null or empty html, and pages without text, give the empty text. A null or odd URL
has an empty host and its own path. Repeated rows give equal rows. A neighbour that shares all main and
open lines is a copy and is ignored. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize

MAIN, OPEN, DROPPED = 2, 1, 0
#: Zones of the scan alone: in a softly dropped wrapper, in one that names other texts, and in an article there.
SOFT, OTHERS, SPARE = 3, 4, 5

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>"
    r"|<(?P<close2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<rest2>[^>]*)>"
    r"|<[!?/][^>]*>"
    r"|</?[a-zA-Z][^>]*\Z",  # the text ends in a tag
    re.S,
)
ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

RAW = {"script", "style", "noscript", "template", "iframe", "svg", "textarea", "select", "title", "object", "canvas", "audio", "video"}
#: What begins a tag or a comment where no ">" follows any more.
LAST = re.compile(r"<!--|</?[a-zA-Z]")
BLOCKS = {"address", "article", "aside", "blockquote", "body", "button", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section", "summary", "table", "tbody", "tfoot", "thead", "tr", "ul"}
SPACED = {"br", "td", "th", "img", "wbr"}
CONTAINERS = {"address", "article", "aside", "blockquote", "button", "details", "dialog", "div", "dl", "fieldset", "figure", "footer", "form", "head", "header", "main", "menu", "nav", "ol", "section", "span", "p", "table", "ul", "li"}
DROPPED_ELEMENTS = {"aside", "button", "dialog", "footer", "form", "head", "menu", "nav"}
DROPPED_ROLES = {"alert", "alertdialog", "banner", "complementary", "contentinfo", "dialog", "form", "menu", "menubar", "navigation", "search", "toolbar"}
DROPPED_WORDS = {"ad", "ads", "advert", "advertisement", "adverts", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disqus", "footer", "gdpr", "login", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "overlay", "pager", "pagination", "popup", "promo", "related", "replies", "respond", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget"}


#: Words of wrappers whose articles are other texts than the page's own.
OTHER_TEXTS = {"ad", "ads", "advert", "advertisement", "adverts", "comment", "comments", "disqus", "promo", "related", "replies", "respond", "sponsor", "sponsored"}
#: A class such as has-sidebar says what is elsewhere on the page.
STATES = {"has", "no", "with", "without"}
#: Last words of compounds that are about their first one: share-buttons shares, but notice-period is no notice.
PARTS = {"area", "articles", "bar", "block", "body", "box", "button", "buttons", "card", "cards", "column", "container", "content", "entry", "feed", "form", "grid", "group", "head", "heading", "icons", "inner", "item", "items", "label", "left", "link", "links", "list", "main", "media", "message", "outer", "panel", "policy", "posts", "region", "right", "row", "section", "slot", "space", "stories", "thread", "title", "top", "unit", "wrap", "wrapper"}


def _words(value: str) -> set[str]:
    """What the class tokens (or the id) name: their last word, and the others where the last one is a mere part."""
    found: set[str] = set()
    for name in value.split():
        words = [w.lower() for w in WORDS.findall(name) if not w.isdigit()]
        if words and words[0] not in STATES:
            while len(words) > 1 and words[-1] in PARTS:
                words.pop()
            found.add(words[-1])
    return found


def _dropped(name: str, rest: str, in_main: bool) -> int | None:
    """The zone that an element's own name and attributes drop it to: DROPPED, SOFT, OTHERS or None."""
    soft = SOFT if name == "form" else None
    if name in DROPPED_ELEMENTS and not soft or name == "header" and not in_main:
        return DROPPED
    for m in ATTRIBUTE.finditer(rest) if rest else ():
        kind, value = m.group(1).lower(), m.group(2) or m.group(3) or m.group(4) or ""
        if kind == "role":
            if value.lower() in DROPPED_ROLES:
                return DROPPED
        elif kind in ("hidden", "aria-hidden"):
            if kind == "hidden" and "=" not in m.group(0) or value.lower() in ("true", "hidden"):
                return DROPPED
        else:
            words = _words(value)
            if words & OTHER_TEXTS:
                soft = OTHERS
            elif words & DROPPED_WORDS or not in_main and "header" in words:
                soft = soft or SOFT
    return soft


def _inside(zone: int, name: str, rest: str) -> int:
    """The zone inside an element that stands in ``zone``."""
    if not zone:
        return DROPPED
    if name in ("article", "main") or 'role="main"' in rest:
        if zone in (OPEN, MAIN):
            return MAIN
        own = _dropped(name, rest, True)
        if own == DROPPED or own == OTHERS and name == "article":
            return DROPPED
        return MAIN if zone == SOFT or zone != SPARE and name != "article" else SPARE
    own = _dropped(name, rest, zone in (MAIN, SPARE))
    if own is None or own == DROPPED:
        return zone if own is None else DROPPED
    return OTHERS if own == OTHERS or zone in (OTHERS, SPARE) else SOFT


def _settled(found: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """Main and open lines: what the zones of the scan alone come to depends on the rest of the page."""
    zones = {zone for zone, _ in found}
    become = {OPEN: OPEN, MAIN: MAIN}
    if MAIN not in zones and SPARE in zones:
        become[SPARE] = MAIN
    elif not zones & {OPEN, MAIN}:
        become |= {SOFT: OPEN, OTHERS: OPEN}
    return [(become[zone], text) for zone, text in found if zone in become]


def lines(page: str) -> list[tuple[int, str]]:
    """(zone, text) of each block with text, in page order."""
    out: list[tuple[int, str]] = []
    runs: list[str] = []
    stack: list[tuple[str, int]] = []  # open containers and the zone outside each
    zone, at, last = OPEN, 0, page.rfind(">")
    opened: dict[str, int] = {}  # how many of each name are in the stack
    endless: set[str] = set()  # raw elements that no end follows any more

    def close() -> None:
        if runs:
            if text := " ".join("".join(runs).split()):
                out.append((zone, text))
            runs.clear()

    def take(text: str) -> None:
        if text and zone:
            runs.append(entities.unescape(text) if "&" in text else text)

    while True:
        m = TOKEN.search(page, at) if at <= last else None
        if m is None:
            rest = LAST.search(page, at)
            take(page[at : rest.start() if rest else len(page)])
            close()
            return _settled(out)
        take(page[at : m.start()])
        at = m.end()
        name = m.group("name") or m.group("name2")
        if not name:
            continue
        name = name.lower()
        if m.group("close") or m.group("close2"):
            if name in BLOCKS:
                close()
            if name in CONTAINERS and opened.get(name):
                if name in ("p", "span", "li") and stack[-1][0] != name:
                    continue  # a stray end inside another container ends nothing
                while stack:
                    top, zone = stack.pop()
                    opened[top] -= 1
                    if top == name:
                        break
            continue
        rest = m.group("rest") or m.group("rest2") or ""
        if name in RAW:
            if name == "svg" and rest.endswith("/") or name in endless:
                continue
            end = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
            if end:
                at = end.end()
            elif name in ("script", "style"):
                at = len(page)
            else:  # an embedded element that is never closed is no more than its tag
                endless.add(name)
            continue
        if name in SPACED:
            if runs:
                runs.append(" ")
            continue
        if name in BLOCKS:
            close()
        if name in CONTAINERS:
            if name in ("p", "li"):  # the next one ends an open one
                while stack and stack[-1][0] == name:
                    zone = stack.pop()[1]
                    opened[name] -= 1
            inside = _inside(zone, name, rest)
            if name not in ("p", "li", "span") or inside != zone:
                stack.append((name, zone))
                opened[name] = opened.get(name, 0) + 1
            zone = inside


def common_lines(mine: list[int], other: list[int]) -> set[int]:
    """Places in ``mine`` on a longest common subsequence with ``other`` (Hunt and Szymanski)."""
    places: dict[int, list[int]] = {}
    for j, h in enumerate(other):
        places.setdefault(h, []).append(j)
    tails: list[int] = []
    links: list[tuple[int, int]] = []  # (place in mine, link before it)
    heads: list[int] = []
    for i, h in enumerate(mine):
        for j in reversed(places.get(h, ())):
            k = bisect_left(tails, j)
            links.append((i, heads[k - 1] if k else -1))
            if k == len(tails):
                tails.append(j)
                heads.append(len(links) - 1)
            else:
                tails[k], heads[k] = j, len(links) - 1
    found, at = set(), heads[-1] if heads else -1
    while at >= 0:
        found.add(links[at][0])
        at = links[at][1]
    return found


def _hashes(found: list[tuple[int, str]]) -> list[int]:
    return [int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True) for _, text in found]


def main_text(found: list[tuple[int, str]], neighbours: list[list[int]] = ()) -> str:
    """The main lines, and the open lines that no neighbour shares."""
    shared: set[int] = set()
    if neighbours:
        mine = _hashes(found)
        for other in neighbours:
            common = common_lines(mine, other)
            if len(common) < len(mine):
                shared |= common
    return "\n".join(text for i, (zone, text) in enumerate(found) if zone == MAIN or i not in shared)


def neighbours(keys: DataFrame) -> DataFrame:
    """(key, near): the nearest pages by path on the same host, before and after, from (key, host, path).

    Rows are sorted by range; within a range the neighbour is the next row, and across ranges the
    first and last rows are joined, one pair for each range.
    """
    ordered = keys.distinct().repartitionByRange("host", "path", "key").withColumn("part", F.spark_partition_id())
    placed = materialize(ordered)
    row = F.struct("host", "path", "key")
    within = W.partitionBy("part").orderBy("host", "path", "key")
    stepped = placed.select("host", "key", "part", F.lag(row).over(within).alias("before"), F.lead(row).over(within).alias("after"))
    ends = placed.groupBy("part").agg(F.min(row).alias("first"), F.max(row).alias("last"))
    across = W.orderBy("part")  # one row for each range
    ends = ends.select(F.col("part").alias("_part"), F.lag("last").over(across).alias("from_left"), F.lead("first").over(across).alias("from_right"))
    joined = stepped.join(ends, F.col("part") == F.col("_part"), "left")
    both = F.array(F.coalesce("before", "from_left"), F.coalesce("after", "from_right"))
    same = F.transform(F.filter(both, lambda n: n["host"] == F.col("host")), lambda n: n["key"])
    return joined.select("key", F.explode(same).alias("near"))


def _keyed(pages: DataFrame, page_id: str, url: str, page: str) -> DataFrame:
    address = F.coalesce(F.col(url), F.lit(""))
    host = F.lower(F.regexp_extract(address, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    path = F.regexp_extract(address, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)
    return pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(page), F.lit("")).alias("html"), F.xxhash64(page_id, url, page).alias("key"), host.alias("host"), path.alias("path"))


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(page_id, url, text) for every row."""
    keyed = _keyed(pages, page_id, url, page)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, held, unsure = [], [], []
            for key, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = lines(raw.as_py())
                keys.append(key)
                held.append(_hashes(found))
                unsure.append(any(zone == OPEN for zone, _ in found))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(held, pa.list_(pa.int64())), pa.array(unsure)], ["key", "lines", "unsure"])

    scanned = materialize(keyed.select("key", "html").mapInArrow(scan, "key long, lines array<long>, unsure boolean"))
    unsure = scanned.where("unsure").select("key").distinct()
    if unsure.isEmpty():  # the markup decides every line
        near = None
        work = keyed.withColumn("near", F.array().cast("array<array<long>>"))
    else:
        pairs = neighbours(keyed.select("key", "host", "path")).join(unsure, "key", "left_semi")
        near = pairs.join(scanned.dropDuplicates(["key"]).select(F.col("key").alias("near"), "lines"), "near").groupBy("key").agg(F.collect_list("lines").alias("near"))
        work = keyed.join(near.hint("shuffle_hash"), "key", "left")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(lines(raw.as_py()), near or []) for raw, near in zip(batch.column(2), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], [page_id, url, "text"])

    kinds = [pages.schema[c].dataType.simpleString() for c in (page_id, url)]
    return work.select("page_id", "url", "html", "near").mapInArrow(read, f"`{page_id}` {kinds[0]}, `{url}` {kinds[1]}, text string")
