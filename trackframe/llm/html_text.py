"""Main text of web pages: structure first, nearest-URL page differencing for the rest.

A page's markup becomes text blocks ("lines"). Elements that are never part of an article
(menus, page headers and footers, sidebars, notices, adverts, forms, scripts, styles, reader
comments) are left out. If the page marks its article (article, main or role=main), the
blocks inside are its lines. Every page is then differenced with the page of the same host
and of other lines whose URL path is nearest: lines are aligned by longest common subsequence, and
shared lines, the site's template, are deleted. A marked page lends its lines outside of the article:
those in it are no template, and an equal article stays. For the same reason a marked page is only aligned with the
lines of a marked one.

Differencing alone can't tell: menus and adverts differ from page to page while articles are
copied within a host (the README has figures), so what a page marks as article goes before it.

Neighbours in path order are found with a range partitioning and the boundary rows of each
partition, so a host with a third of all pages is many tasks. A run of copies is passed over as one,
be it longer than a partition.

Defined cases: null and empty html give an empty text; a null URL is a host of its own without
neighbours; truncated markup ends where it is cut; repeated rows give a result each (equal pages
would share every line, so an unmarked page is never differenced with an unmarked one of equal lines); ties in path
order go to the smaller page id; extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernels as K
from .common import BROADCAST_IDS, save, save_seen, shuffle_width, table

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe noembed noframes xmp template".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose text is never part of an article.
LEFT_OUT = frozenset("head nav footer aside form dialog menu search button select option datalist".split()) | RAW
#: Those whose text is part of an article only inside of a marked one.
EMBEDDED = frozenset("object svg math canvas audio video".split())
#: Classes, ids and roles that say the same.
NAMES = frozenset(
    "ad ads adbox advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie "
    "cookies disqus footer form gdpr login masthead menu modal nav navbar navigation newsletter notice notices notification "
    "pagination popup promo promoted promotion related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe "
    "toolbar widget".split()
)
_TAG = re.compile(r"""<(?:(!--)|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|[!?/][^>]*>)""")
#: Words that may stand beside them outside of articles (cookie-notice, nav-bar).
FILL = frozenset("bar box buttons links list site slot".split())
#: Those of reader comments, which may be articles in turn; and elements that hold teasers, but no page's article.
COMMENTS = frozenset("comment comments disqus replies reply respond".split())
BESIDE = frozenset("aside nav footer menu".split())
CONTAINERS = frozenset("div section ol ul".split())
_ATTR = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def _tokens(attrs: str) -> list[tuple[str, str]]:
    """(attribute, token) of class, id and role."""
    if "=" not in attrs:
        return []
    found = [(k.lower(), a or b or c) for k, a, b, c in _ATTR.findall(attrs)]
    return [(k, x) for k, v in found if k in ("class", "id", "role") for x in v.split()]


def _left_out(name: str, tokens: list[tuple[str, str]], in_article: bool) -> bool:
    if name in LEFT_OUT or not in_article and (name == "header" or name in EMBEDDED):
        return True
    if name in ("html", "body", "article", "main"):
        return False
    for key, token in tokens:
        if in_article:  # an id there is an anchor, but for the comments below the text
            if token.lower() in NAMES if key != "id" else name in CONTAINERS and token.lower() in COMMENTS:
                return True
            continue
        words = {p.lower() for p in _PART.findall(token)}
        known = words & (NAMES | {"header"})
        if known and words - known <= FILL:
            return True
    return False


def _firm(name: str, tokens: list[tuple[str, str]]) -> bool:
    """Whether articles inside are no sign that an element that is left out holds the page's article."""
    return name in BESIDE or any(not COMMENTS.isdisjoint(p.lower() for p in _PART.findall(x)) for _, x in tokens)


def blocks(page: str) -> tuple[list[str], bool]:
    """The page's blocks outside of elements that are left out; and whether they are those of a
    marked article. An element around the marked article is not left out."""
    return blocks_and_others(page)[:2]


def blocks_and_others(page: str) -> tuple[list[str], bool, list[str]]:
    """blocks, and of a page with a marked article the blocks outside of it."""
    found, marked, others, wraps = _pass(page, frozenset())
    if not marked and wraps:
        found, marked, others, _ = _pass(page, frozenset(wraps))
    return found, marked, others


def _pass(page: str, lifted: frozenset[int]) -> tuple[list[str], bool, list[str], set[int]]:
    """blocks_and_others, without leaving out the elements that start at the places lifted; and the
    places of those left out around an article."""
    lines: list[tuple[int, str]] = []  # 2: of article, 1: of main
    wraps: set[int] = set()
    stack: list[tuple[str, int]] = []
    out: list[tuple[int, bool]] = []  # place of each open element left out, and whether it is firm
    skip = inside = inner = 0  # open elements left out, of article, of main
    piece: list[str] = []
    opened: Counter[str] = Counter()  # open elements by name
    walls: list[int] = []  # places in the stack of open blocks

    def flush():
        if piece:
            text = " ".join(entities.unescape("".join(piece)).split())
            piece.clear()
            if text:
                lines.append((2 if inside else 1 if inner else 0, text))

    def pop():
        nonlocal skip, inside, inner
        gone, kind = stack.pop()
        opened[gone] -= 1
        if walls and walls[-1] == len(stack):
            walls.pop()
        if kind == 1:
            skip -= 1
            out.pop()
        inside -= kind == 2
        inner -= kind == 3

    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at and not skip:
            piece.append(page[at:lt])
        if lt == n:
            break
        m = _TAG.match(page, lt)
        if m is None:
            after = page[lt + 1 : lt + 2]
            if after.isalpha() or after in ("/", "!", "?"):
                end = page.find(">", lt)  # a stray quote, or the page is cut inside of the tag
                if end < 0:
                    break
                m = re.match(r"<()(/?)([a-zA-Z][^\s/>]*)([^>]*)>", page[lt : end + 1])
                at = end + 1
                if m is None:
                    continue
            else:
                if not skip:
                    piece.append("<")
                at = lt + 1
                continue
        else:
            at = m.end()
        comment, close, name, attrs = m[1], m[2], m[3], m[4] or ""
        if comment:
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if not name:
            continue
        name = name.lower()
        if close:
            if name in BLOCKS:
                flush()
            if opened[name]:  # else the end tag has no element
                while stack[-1][0] != name:
                    pop()
                pop()
            continue
        if name in BLOCKS:
            flush()
            if name == "body" and opened["head"]:
                while stack and stack[-1][0] != "head":
                    pop()
                pop()
            elif name in ("li", "p", "dd", "dt", "tr", "td", "th"):
                # an open element of the kind ends, if only inline elements are open inside of it
                depth = walls[-1] if walls else -1
                if depth >= 0 and stack[depth][0] == name:
                    while len(stack) > depth:
                        pop()
        elif name == "br" and not skip:
            piece.append(" ")
        if name in RAW and not attrs.endswith("/"):
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
            close_at = page.find(">", end.start()) if end else -1
            at = n if close_at < 0 else close_at + 1
            continue
        if name in VOID or attrs.endswith("/") and name not in BLOCKS:
            continue
        kind, tokens = 0, _tokens(attrs)
        if name == "article":
            kind = 2
        elif name == "main" or ("role", "main") in tokens:
            kind = 3
        elif lt not in lifted and _left_out(name, tokens, bool(inside or inner)):
            kind = 1
            out.append((lt, _firm(name, tokens)))
        if kind > 1 and (kind == 3 or not any(firm for _, firm in out)):
            wraps.update(place for place, _ in out)
        if name in BLOCKS:
            walls.append(len(stack))
        opened[name] += 1
        stack.append((name, kind))
        skip += kind == 1
        inside += kind == 2
        inner += kind == 3
    flush()
    top = max((level for level, _ in lines), default=0)
    return [x for level, x in lines if level == top], top > 0, [x for level, x in lines if level < top], wraps


def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Marks the entries of a that are in a longest common subsequence of a and b (row maxima by numpy; long pairs are
    halved, so that memory stays in proportion to the lines)."""
    keep = np.zeros(len(a), dtype=bool)
    p, most = 0, min(len(a), len(b))
    while p < most and a[p] == b[p]:
        p += 1
    q = 0
    while q < most - p and a[-1 - q] == b[-1 - q]:
        q += 1
    keep[:p] = True
    if q:
        keep[len(a) - q :] = True
    x, y = a[p : len(a) - q], b[p : len(b) - q]
    if not len(x) or not len(y):
        return keep

    def rows(x, y):
        last = np.zeros(len(y) + 1, dtype=np.int32)
        yield last
        for v in x:
            last = last.copy()
            last[1:] = np.maximum(last[1:], last[:-1] + (y == v))
            np.maximum.accumulate(last, out=last)
            yield last

    if len(x) * len(y) <= 4_000_000:
        t = list(rows(x, y))
        i, j = len(x), len(y)
        while i and j:
            if t[i][j] == t[i - 1][j]:
                i -= 1
            elif t[i][j] == t[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                keep[p + i] = True
        return keep
    if len(x) == 1:
        keep[p] = (y == x[0]).any()
        return keep
    half = len(x) // 2
    for up in rows(x[:half], y):
        pass
    for down in rows(x[half:][::-1], y[::-1]):
        pass
    cut = int(np.argmax(up + down[::-1]))
    keep[p : p + half] = common(x[:half], y[:cut])
    keep[p + half : p + len(x)] = common(x[half:], y[cut:])
    return keep


#: own: hashes of the lines; lent: of those that a page lends (all of an unmarked page, those outside of the article of a marked one).
_PARSED = "row long, page_id long, url string, host string, path string, marked boolean, lines array<string>, own array<long>, lent array<long>"


def _place(url: str | None) -> tuple[str | None, str]:
    if url is None:
        return None, ""
    rest = url.split("#", 1)[0].partition("://")
    tail = rest[2] if rest[1] else rest[0]
    cut = min((i for i in (tail.find(c) for c in "/?") if i >= 0), default=len(tail))
    return tail[:cut].rpartition("@")[2].lower(), tail[cut:] or "/"


def _hashes(lines: list[str]) -> list[int]:
    if not lines:
        return []
    buf, starts = K.joined([x.encode("utf-8", "surrogatepass") for x in lines])
    return K.spans(buf, starts[:-1], starts[1:]).view(np.int64).tolist()


def _parsed(batches):
    row = TaskContext.get().partitionId() << 33
    for batch in batches:
        pages = batch.column("html").to_pylist()
        for i in range(0, len(pages), 500):
            rows = []
            for page_id, url, page in zip(batch.column("page_id").slice(i, 500).to_pylist(), batch.column("url").slice(i, 500).to_pylist(), pages[i : i + 500]):
                found, marked, others = blocks_and_others(page or "")
                lines = [x.encode("utf-8", "replace").decode() for x in found]
                own = _hashes(lines)
                rows.append((row, page_id, url, *_place(url), marked, lines, own, _hashes(others) if marked else own))
                row += 1
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["row", "page_id", "url", "host", "path", "marked", "lines", "own", "lent"])


def beside(rows: DataFrame, part: list[str], order: list[str], group: list[str], value: str) -> DataFrame:
    """Adds before and after: structs of order, group and value of the nearest rows in the order (within part)
    on both sides whose group columns differ, null where none does."""
    one = F.struct(*dict.fromkeys([*order, *group, value]))
    for name, by in (("before", order), ("after", [F.desc(c) for c in order])):
        w = Window.partitionBy(*part).orderBy(*by)
        last = F.lag(F.struct(one.alias("x"))).over(w)
        other = F.lit(False)
        for c in group:
            other |= ~F.col(f"__last.x.{c}").eqNullSafe(F.col(c))
        rows = rows.withColumn("__last", last).withColumn("__start", F.when(F.col("__last").isNotNull() & other, F.col("__last.x")))
        rows = rows.withColumn(name, F.last("__start", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__last", "__start")
    return rows


def neighbours(rows: DataFrame, order: list[str], group: list[str], value: str) -> DataFrame:
    """Adds before and after: structs of order, group and value of the nearest rows on both sides in
    the global order whose group columns differ, null at its ends. Rows are range-partitioned; the rows
    of two groups beyond each end of a partition are lent to it."""
    names = list(dict.fromkeys([*order, *group, value]))
    one = F.struct(*names)
    placed = save(rows.repartitionByRange(shuffle_width(rows.sparkSession), *order).withColumn("__part", F.spark_partition_id()), "ordered")
    ends = placed.groupBy("__part").agg(F.min(one).alias("a"), F.max(one).alias("z"))
    # four rows at most for each partition: its ends and the first rows of other groups
    inner = placed.join(F.broadcast(ends), "__part")

    def other(end):
        differs = F.lit(False)
        for c in group:
            differs |= ~F.col(c).eqNullSafe(F.col(f"{end}.{c}"))
        return F.when(differs, one)

    inner = inner.groupBy("__part").agg(F.min(other("a")).alias("a2"), F.max(other("z")).alias("z2"))
    ends = ends.join(inner, "__part").select("__part", F.explode(F.array_distinct(F.array_compact(F.array("a", "a2", "z2", "z")))).alias("x")).select("__part", "x.*")
    ends = beside(ends.withColumn("__all", F.lit(0)), ["__all"], order, group, value)
    ends = ends.groupBy("__part").agg(F.min(F.struct(one.alias("x"), "after")).alias("a"), F.max(F.struct(one.alias("x"), "before")).alias("z"))
    up = Window.orderBy("__part")
    ends = ends.select("__part", F.lag("z").over(up).alias("low"), F.lead("a").over(up).alias("high"))
    lent = ends.select("__part", F.explode(F.array_compact(F.array("low.x", "low.before", "high.x", "high.after"))).alias("x"))
    more = [c for c in placed.columns if c not in (*names, "__part")]
    lent = lent.select("x.*", *[F.lit(None).cast(placed.schema[c].dataType).alias(c) for c in more], "__part", F.lit(True).alias("__lent"))
    both = placed.withColumn("__lent", F.lit(False)).unionByName(lent)
    return beside(both, ["__part"], order, group, value).where("not __lent").drop("__part", "__lent")


def _prefix(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def _differenced(batches):
    """Rows with their neighbours to (row, gone): the places of the lines that the nearer one shares, for rows that lose any."""
    for batch in batches:
        out = []
        for row, host, path, marked, own, before, after in zip(*(batch.column(c).to_pylist() for c in ("row", "host", "path", "marked", "own", "before", "after"))):
            near = [x for x in (before, after) if x and x["host"] == host]
            if not near or not own:
                continue
            other = max(near, key=lambda x: _prefix(path, x["path"]))["lends"]
            if marked and not other["marked"]:
                continue
            gone = np.flatnonzero(common(np.asarray(own, dtype=np.int64), np.asarray(other["lent"], dtype=np.int64)))
            if len(gone):
                out.append((row, gone.tolist()))
        yield pa.record_batch([pa.array([r for r, _ in out], pa.int64()), pa.array([g for _, g in out], pa.list_(pa.int32()))], names=["row", "gone"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url and main text of every row of pages (page_id, url, html)."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    parsed = save(p.mapInArrow(_parsed, _PARSED), "parsed")
    rows = parsed.where(F.col("host").isNotNull() & (F.size("own") + F.size("lent") > 0))
    rows = rows.select("host", "path", "page_id", "row", "marked", F.xxhash64("marked", "own", "lent").alias("list"), "own", F.struct("marked", "lent").alias("lends"))
    found = neighbours(rows, ["host", "path", "page_id", "row"], ["host", "list"], "lends").select("row", "host", "path", "marked", "own", "before", "after")
    gone, (n,) = save_seen(found.mapInArrow(_differenced, "row long, gone array<int>"), "gone", F.sum(F.size("gone") + 4))
    if (n or 0) <= 4 * BROADCAST_IDS:  # else both sides are shuffled
        gone = F.broadcast(gone)
    left = F.filter("lines", lambda x, i: F.col("gone").isNull() | ~F.array_contains("gone", i))
    return parsed.join(gone, "row", "left").select("page_id", "url", F.array_join(left, "\n\n").alias("text"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
