"""Main text of web pages by differencing pages with near URLs.

A page becomes text lines, one per block, without the parts that its markup names as boilerplate. Pages are put in the
order of host and URL path; each is compared with the different pages of its host whose paths are nearest, their lines
are aligned by longest common subsequence, and shared lines are deleted as template.

Pages of a site also share whole articles and passages, which are no template. So a neighbour that would leave nothing
of the page is a copy of it and passed over, a line has to be shared with two neighbours where there are two, and where
the markup marks the article itself, shared lines of prose inside it stay: there only shared lines that are nothing but
links are deleted, and lines outside it do not belong to the text.
"""

from __future__ import annotations

import html as entities
from bisect import bisect_right
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import materialise, slices, small_batches

TOKEN = regex.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?>\"[^\"]*\"|'[^']*'|[^>\"'])*+|[^>]*)>", regex.S)
TAG = regex.compile(r"</?[a-zA-Z!]")
ATTRIBUTE = regex.compile(r"""([^\s=/"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
#: Fixed values of HTML: elements that start a line, that have no end tag, and whose content is no markup.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template svg iframe textarea title math object canvas video audio".split())
#: Elements and roles that mark boilerplate.
DROPPED = frozenset("nav header footer aside form button select dialog menu head fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Names of parts of a page that are boilerplate, and of such that are in the article too.
NAMES = frozenset(
    "ad ads advert adverts advertisement sponsor sponsored promo banner cookie cookies consent gdpr notice notices popup modal newsletter subscribe signup login sidebar menu nav navbar "
    "navigation breadcrumb breadcrumbs footer masthead comment comments disqus respond replies related recommended share sharing social pagination pager toolbar topbar".split()
)
#: Of these, the ones that name parts of an article as well: inside it only their lines of nothing but links go.
SOFT = frozenset("related recommended share sharing social".split())
COMMENTS = frozenset("comment comments reply replies disqus respond".split())
#: Words that say nothing beside such a name.
NEUTRAL = frozenset("site page post posts article main top bottom left right box bar list item items section area block wrapper container widget links link buttons button inner outer slot".split())
#: Fixed values of HTML: elements that a form around a whole page has inside it, and a form in a page has not.
PAGE_PARTS = regex.compile(r"<(?:article|main|nav|header|footer|section|h1)\b", regex.I)
FORM_END = regex.compile("</form", regex.I)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: How a line is marked between stages: inside the article or not, nothing but links or not.
FLAGS = {(False, False): "n", (True, False): "c", (True, True): "l", (False, True): "o"}
NEIGHBOURS = 2
DRAWS = 20


def _names(value: str, wanted: frozenset[str]) -> bool:
    """Whether a class or id is the name of such a part: ad-box and site-footer are, related-work and nav-open are not."""
    parts = value.replace("_", "-").split("-")
    return not wanted.isdisjoint(parts) and all(p in wanted or p in NEUTRAL for p in parts)


@lru_cache(4096)
def _boilerplate(name: str, attributes: str, inside: bool) -> bool:
    """Whether an element is boilerplate; `inside` says that it stands in the article."""
    if name in ("html", "body"):
        return False
    own = name in ("article", "main")
    if name in DROPPED:
        return True
    if not attributes.strip():
        return False
    named = COMMENTS if own else NAMES - SOFT if inside else NAMES
    for key, value in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key in ("class", "id") and any(_names(v, named) for v in value.split()):
            return True
        if not own and (key == "role" and value in ROLES or key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", "")):
            return True
    return False


@lru_cache(4096)
def _soft(attributes: str) -> bool:
    return any(key.lower() in ("class", "id") and any(_names(v, SOFT) for v in value.strip("\"'").lower().split()) for key, value in ATTRIBUTE.findall(attributes))


class _Forms:
    """Which forms of a page hold the parts of a page: places of these and of the ends of forms, found once if asked for."""

    def __init__(self, html: str):
        self.html, self.parts, self.ends = html, None, None

    def around_page(self, at: int) -> bool:
        if self.parts is None:
            self.parts, self.ends = ([m.start() for m in x.finditer(self.html)] for x in (PAGE_PARTS, FORM_END))
        i, j = bisect_right(self.parts, at), bisect_right(self.ends, at)
        return i < len(self.parts) and (j == len(self.ends) or self.parts[i] < self.ends[j])


def lines(html: str) -> list[tuple[str, bool, bool]]:
    """(text, inside the article, nothing but links) of each line outside boilerplate."""
    out: list[tuple[str, bool, bool]] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # open containers: name, drops its content, is an article, drops lines of links
    text: list[str] = []
    dropped = core = soft = anchors = plain = at = 0
    heading, forms = False, _Forms(html)

    def flush() -> None:
        nonlocal plain
        if text:
            line = " ".join(entities.unescape("".join(text)).split())
            if line and (plain or not soft):
                out.append((line, core > 0, not plain))
            text.clear()
        plain = 0

    def close(upto: int) -> None:
        nonlocal dropped, core, soft
        for _, drops, article, links in stack[upto:]:
            dropped -= drops
            core -= article
            soft -= links
        del stack[upto:]

    def take(piece: str) -> None:
        nonlocal plain
        if not dropped or heading and core and dropped == 1:
            text.append(piece)
            if not anchors and not piece.isspace():
                plain += 1

    end = len(html)
    while at < end:
        start = html.find("<", at)
        if start < 0:
            take(html[at:])
            break
        if start > at:
            take(html[at:start])
        m = TOKEN.match(html, start)
        if not m:
            if TAG.match(html, start) and html.find(">", start) < 0:
                break  # the page ends inside a tag
            take("<")
            at = start + 1
            continue
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        closing = bool(m[1])
        if name == "br":
            take(" ")
        elif name == "a":
            anchors = 0 if closing else 1
        elif name in RAW:
            if not closing and not m[3].endswith("/"):
                stop = regex.compile(rf"</{name}\b[^>]*>?", regex.I).search(html, at)
                at = stop.end() if stop else end
        elif closing:
            if name in BLOCKS:
                flush()
                anchors = 0
            if name in HEADINGS:
                heading = False
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    if name in BLOCKS or i == len(stack) - 1:
                        close(i)
                    break
        else:
            block = name in BLOCKS
            if block:
                flush()
                anchors = 0
                if stack and stack[-1][0] in ("p", *HEADINGS):  # a block ends an open paragraph
                    close(len(stack) - 1)
            if name in VOID:
                continue
            drops = _boilerplate(name, m[3], core > 0)
            if name == "form" and drops and forms.around_page(at - 1):
                drops = _boilerplate("div", m[3], core > 0)
            links = core > 0 and not drops and _soft(m[3])
            heading = heading or name in HEADINGS and bool(stack) and stack[-1][0] in ("header", "hgroup")
            if drops or block and name not in ("p", "li", *HEADINGS, "td", "th", "tr", "dt", "dd", "option", "hr"):
                article = name in ("article", "main") and not drops and not dropped
                stack.append((name, drops, article, links))
                dropped += drops
                core += article
                soft += links
    flush()
    return out


def _rows(x: list[str], y: list[str]) -> list[int]:
    """For each prefix of x the bit vector of its longest common subsequences with the prefixes of y.

    A zero bit j of row i says that the subsequence of x[..i] and y[..j] is longer than that of x[..i] and y[..j-1].
    """
    where: dict[str, int] = {}
    for j, k in enumerate(y):
        where[k] = where.get(k, 0) | 1 << j
    full = (1 << len(y)) - 1
    v, rows = full, []
    for k in x:
        u = v & where.get(k, 0)
        v = ((v + u) | (v - u)) & full
        rows.append(v)
    return rows


def _lengths(x: list[str], y: list[str]) -> np.ndarray:
    """Length of the longest common subsequence of x with each prefix of y, the empty one first."""
    v, out = (1 << len(y)) - 1, np.zeros(len(y) + 1, np.int64)
    full, where = v, {}
    for j, k in enumerate(y):
        where[k] = where.get(k, 0) | 1 << j
    for k in x:
        u = v & where.get(k, 0)
        v = ((v + u) | (v - u)) & full
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(y) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(y)]
    np.cumsum(1 - bits.astype(np.int64), out=out[1:])
    return out


CELLS = 1 << 24


def shared(a: list[str], b: list[str]) -> set[int]:
    """Positions of a in a longest common subsequence with b.

    Ends that are equal on both sides are aligned first, the rest by bit vectors. Beyond CELLS cells it is cut in two
    where the halves' subsequences add up to the longest, so memory is linear in the lines, however long the pages.
    """
    out: set[int] = set()
    open_ = [(0, len(a), 0, len(b))]
    while open_:
        i, i2, j, j2 = open_.pop()
        while i < i2 and j < j2 and a[i] == b[j]:
            out.add(i)
            i, j = i + 1, j + 1
        while i < i2 and j < j2 and a[i2 - 1] == b[j2 - 1]:
            i2, j2 = i2 - 1, j2 - 1
            out.add(i2)
        if i == i2 or j == j2:
            continue
        x, y = a[i:i2], b[j:j2]
        if len(x) * len(y) > CELLS and len(x) > 1:
            middle = len(x) // 2
            at = int((_lengths(x[:middle], y) + _lengths(x[middle:][::-1], y[::-1])[::-1]).argmax())
            open_ += [(i, i + middle, j, j + at), (i + middle, i2, j + at, j2)]
            continue
        rows = _rows(x, y)
        r, c = len(x) - 1, len(y) - 1
        while r >= 0 and c >= 0:
            if rows[r] >> c & 1:
                c -= 1
            elif r and not rows[r - 1] >> c & 1:
                r -= 1
            else:
                out.add(i + r)
                r, c = r - 1, c - 1
    return out


Line = tuple[str, bool, bool]


def main_text(page: list[Line], others: list[list[Line]]) -> str:
    """The lines of a page that are its own; `others` are its neighbours, nearest first."""
    article = any(core for _, core, _ in page)
    doubtful = [not article or core and links for _, core, links in page]
    if article and not any(doubtful):
        return "\n".join(t for t, core, _ in page if core)
    mine, support, usable = [t for t, _, _ in page], [0] * len(page), 0
    for other in others:
        gone = shared(mine, [t for t, _, _ in other])
        if any(i not in gone and not links and (core or not article) for i, (_, core, links) in enumerate(page)):
            usable += 1
            for i in gone:
                support[i] += 1
    enough = min(2, max(usable, 1))
    return "\n".join(t for i, (t, core, _) in enumerate(page) if (core or not article) and not (doubtful[i] and support[i] >= enough))


def _common(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def _place(bounds: list[tuple], edges: dict[tuple, list[int]] | None):
    """Parse pages and say which part each belongs to; pages at a part's edge go to the next one too, as onlookers."""

    def run(batches):
        for batch in slices(batches, "html", 8 << 20):
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("host", "path", "key")), strict=True))
            rows: list[tuple] = []
            for i, (key, body) in enumerate(zip(keys, batch.column("html").to_pylist(), strict=True)):
                found = lines(body or "")
                text, flags = "\n".join(t for t, _, _ in found), "".join(FLAGS[core, links] for _, core, links in found)
                rows.append((i, bisect_right(bounds, key), False, text, flags))
                rows += [(i, part, True, text, flags) for part in edges.get(key, ())]
            at, part, onlooker, text, flags = zip(*rows, strict=True)
            at = pa.array(at)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(at) for c in ("page_id", "url", "host", "path", "key")), pa.array(part, pa.int32()), pa.array(onlooker), pa.array(text, pa.string()), pa.array(flags, pa.string())],
                names=["page_id", "url", "host", "path", "key", "part", "onlooker", "text", "flags"],
            )

    return run


class _Run:
    """Pages of one host that follow each other and have the same lines: copies, which are compared once."""

    def __init__(self, host: str, path: str, text: str, flags: str):
        self.host, self.path, self.text, self.flags = host, path, text, flags
        self.members: list[tuple] = []

    def lines(self) -> list[Line]:
        return [(t, f in "cl", f in "lo") for t, f in zip(self.text.split("\n"), self.flags, strict=True)] if self.flags else []


def _runs(batches):
    now = None
    for batch in batches:
        ids, urls, *rest = (batch.column(c) for c in ("page_id", "url", "host", "path", "onlooker", "text", "flags"))
        hosts, paths, onlookers, texts, flags = (c.to_pylist() for c in rest)
        for i in range(batch.num_rows):
            if now is None or (hosts[i], texts[i], flags[i]) != (now.host, now.text, now.flags) or not hosts[i]:
                if now is not None:
                    yield now
                now = _Run(hosts[i], paths[i], texts[i], flags[i])
            if not onlookers[i]:
                now.members.append((ids[i].as_py(), urls[i].as_py()))
    if now is not None:
        yield now


def _differ(batches):
    def out(rows):
        ids, urls, texts = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
        )

    rows, held = [], 0
    for window, here in _ahead(_runs(batches)):
        near = [r for r in window if r is not here and here.host and r.host == here.host]
        near.sort(key=lambda r: -_common(r.path, here.path))
        text = main_text(here.lines(), [r.lines() for r in near])
        for member in here.members:
            rows.append((*member, text))
            held += len(text)
            if held > 4 << 20 or len(rows) >= 2000:
                yield out(rows)
                rows, held = [], 0
    if rows:
        yield out(rows)


def _ahead(items):
    """Each item with those up to NEIGHBOURS before and after it, itself included."""
    held: list = []
    at = 0
    for item in items:
        held.append(item)
        if len(held) - at > NEIGHBOURS:
            yield held, held[at]
            at += 1
        if at > NEIGHBOURS:
            held = held[at - NEIGHBOURS :]
            at = NEIGHBOURS
    for i in range(at, len(held)):
        yield held[max(0, i - NEIGHBOURS) :], held[i]


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", parts: int | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) for each page: its main text, blocks joined by newlines, and its code points.

    Character references are decoded, white space inside a block becomes one space, and nothing is capped, however long
    the page. Null or empty html gives an empty text. A page's neighbours are the NEIGHBOURS different pages of its host
    before it and as many after it in the order (host, path, id); equal pages that follow each other count as one, so
    ties and repeated rows change nothing and each keeps a row. A null url, or one without a host, has no neighbours.
    An empty table gives no rows; other columns, whatever their names, are ignored.

    The order is cut at `parts` - 1 pages drawn by their size; pages at a cut are seen from both of its sides. The driver
    holds a few rows for each part, whatever the number of pages.
    """
    spark = pages.sparkSession
    small_batches(spark)
    url = F.col(url_col)
    base = pages.select(
        F.col(id_col).cast("long").alias("page_id"), url.alias("url"), F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z]+://([^/?#]*)", 1)), F.lit("")).alias("host"),
        F.coalesce(F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1), F.lit("")).alias("path"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("key"), F.col(html_col).alias("html"),
    )
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    slim = base.select("host", "path", "key", F.xxhash64("html").alias("hash"), (F.coalesce(F.octet_length("html"), F.lit(0)) + 64).cast("long").alias("size"))
    slim = materialise(slim)
    total = slim.agg(F.sum("size")).first()[0] or 1
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(6), "host", "path", "key"), 11) / F.lit(float(1 << 53))
    weight = F.col("size") * (float(DRAWS * parts) / total)
    drawn = slim.where(draw < weight).select("host", "path", "key", F.greatest(weight, F.lit(1.0)).alias("weight")).orderBy("host", "path", "key").collect()  # about DRAWS rows a part
    steps = [int(w / DRAWS) for w in accumulate(r["weight"] for r in drawn)]
    bounds = sorted({tuple(r[:3]) for r, now, last in zip(drawn, steps, [0, *steps], strict=False) if now > last})
    edges = _edges(slim, bounds) if bounds else {}
    parsed = base.mapInArrow(_place(bounds, edges), "page_id long, url string, host string, path string, key long, part int, onlooker boolean, text string, flags string")
    dealt = parsed.repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("host", "path", "key", "text")
    return dealt.mapInArrow(_differ, "page_id long, url string, text string, n_chars long")


def _edges(slim: DataFrame, bounds: list[tuple]) -> dict[tuple, list[int]]:
    """Pages at either end of a part, NEIGHBOURS different ones each, with the parts beside it: a few rows a part."""

    def run(batches):
        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in ("host", "path", "key")), strict=True)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("host", "path", "key", "hash")), pa.array([bisect_right(bounds, k) for k in keys], pa.int32())], names=["host", "path", "key", "hash", "part"])

    order = Window.partitionBy("part").orderBy("host", "path", "key", "hash")
    new = F.coalesce((F.col("hash") != F.lag("hash").over(order)) | (F.col("host") != F.lag("host").over(order)), F.lit(True))
    counted = slim.select("host", "path", "key", "hash").mapInArrow(run, "host string, path string, key long, hash long, part int").withColumn("new", new).withColumn("run", F.sum(F.col("new").cast("int")).over(order))
    last = counted.withColumn("runs", F.max("run").over(Window.partitionBy("part"))).where("new")
    found: dict[tuple, list[int]] = {}
    for r in last.where((F.col("run") <= NEIGHBOURS) | (F.col("run") > F.col("runs") - NEIGHBOURS)).collect():
        to = [r["part"] - 1] * (r["run"] <= NEIGHBOURS and r["part"] > 0) + [r["part"] + 1] * (r["run"] > r["runs"] - NEIGHBOURS and r["part"] < len(bounds))
        if to:
            found.setdefault((r["host"], r["path"], r["key"]), []).extend(to)
    return found
