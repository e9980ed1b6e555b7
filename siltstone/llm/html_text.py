"""Main text of web pages: blocks from markup, and nearest-URL page differencing of the blocks that markup leaves open.

A page is parsed into blocks of text. Markup settles some: what is in menus, headers, footers, sidebars, notices, adverts, forms
and comments is dropped. Each page is paired with the pages before and after it in order of URL path within its host, and their
lines are aligned by longest common subsequence. Pages with neither an article nor a main element are open: all their other blocks may be
template, and the lines that an open page shares with an open neighbour are deleted. Inside an article, lines that it shares with its
neighbours may be template or repeated by right, such as a licence line, so they go only if over half of the host's articles have them.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batch_bytes, cut, table
from .url_filters import host_path

#: Elements whose content is no text, that hold other things than the main text, and that begin a block.
NO_TEXT = frozenset("script style noscript template iframe svg math canvas object audio video head select textarea button".split())
NOT_MAIN = frozenset("nav header footer aside form menu dialog".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of class, id and role attributes that name what is not main text.
NOT_MAIN_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies discussion disqus "
    "footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promotion related replies reply search share sharing "
    "sidebar social sponsor sponsored subscribe toolbar widget".split()
)
#: Different articles of a host from which what over half of them have is its template.
LEAST_ARTICLES = 10
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_NAME_WORD = re.compile(r"[a-z]+")
_RAW_END = {t: re.compile(rf"</{t}\s*>|\Z", re.I) for t in ("script", "style", "textarea", "title", "noscript", "iframe", "template", "svg", "select", "button", "canvas", "object")}
_ATTRIBUTES_READ = re.compile(r"class|id|role|hidden|style|aria", re.I)


def _named_not_main(attributes: str) -> bool:
    if not _ATTRIBUTES_READ.search(attributes):
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key in ("class", "id", "role") and not NOT_MAIN_NAMES.isdisjoint(_NAME_WORD.findall(value)):
            return True
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value) or key == "aria-hidden" and value == "true":
            return True
    return bool(re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", re.sub(r"\"[^\"]*\"|'[^']*'", "", attributes)))


def blocks(page: str | None) -> list[tuple[str, int]]:
    """(text, state) of each block with text, in page order; state 0: not main text, 1: open, 2: in an article or main element.

    Character references are decoded once, white space runs become one space, and text is trimmed. Unclosed elements end with
    their parent, or with the page; an article that begins in a menu or header that was not closed ends that.
    """
    page = page or ""
    out: list[tuple[str, int]] = []
    text: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # element, whether it drops its content, whether it is main
    dropping = main = 0
    at = 0

    def flush() -> None:
        if text:
            joined = " ".join(html.unescape("".join(text)).split())
            if joined:
                out.append((joined, 0 if dropping else 2 if main else 1))
            text.clear()

    while True:
        m = _TAG.search(page, at)
        if m is None:
            text.append(page[at:])
            break
        if m.start() > at:
            text.append(page[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            if name in BLOCKS:
                flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    flush() if any(s[1] or s[2] for s in stack[k:]) else None
                    for s in stack[k:]:
                        dropping, main = dropping - s[1], main - s[2]
                    del stack[k:]
                    break
                if stack[k][2] and name not in ("article", "main", "body", "html"):
                    break  # a stray end tag does not close an article
            continue
        if name in BLOCKS:
            flush()
        if name in NO_TEXT or name == "title":
            if name in _RAW_END and not m[3].endswith("/"):
                at = _RAW_END[name].search(page, at).end()
                continue
            if name == "head":
                end = re.compile(r"</head\s*>|<body[\s>]", re.I).search(page, at)
                if end:
                    at = end.end() if end[0].startswith("</") else end.start()
                continue
        if name in VOID or m[3].endswith("/"):
            continue
        named = _named_not_main(m[3])
        is_main = not named and (name in ("article", "main") or bool(re.search(r"role\s*=\s*[\"']?main\b", m[3], re.I)))
        drops = named or name in NOT_MAIN or name in NO_TEXT
        if is_main and dropping and not main and all(not s[1] or s[0] in NOT_MAIN for s in stack):
            stack, dropping = [s for s in stack if not s[1]], 0
        if name == "p":
            while stack and stack[-1][0] in ("p", "b", "i", "em", "strong", "span", "a") and not stack[-1][1]:
                stack.pop()
        if drops or is_main:
            flush()
        stack.append((name, drops, is_main))
        dropping, main = dropping + drops, main + is_main
    flush()
    return out


def shared_lines(a: list[int], b: list[int]) -> list[int]:
    """Positions in a of a longest common subsequence of a and b, by the matches in order of a (Hunt and Szymanski)."""
    places = defaultdict(list)
    for j, y in enumerate(b):
        places[y].append(j)
    tails: list[int] = []
    ends: list[tuple[int, int]] = []  # index into chain
    chain: list[tuple[int, int]] = []  # position in a, index of the previous
    for i, x in enumerate(a):
        for j in reversed(places.get(x, ())):
            k = bisect_left(tails, j)
            chain.append((i, ends[k - 1][1] if k else -1))
            if k == len(tails):
                tails.append(j)
                ends.append((j, len(chain) - 1))
            else:
                tails[k] = j
                ends[k] = (j, len(chain) - 1)
    out, at = [], ends[-1][1] if ends else -1
    while at >= 0:
        i, at = chain[at]
        out.append(i)
    return out[::-1]


def differenced(own: list[str], neighbours: list[list[int]], line_id) -> str:
    """The open blocks of a page without the lines that it shares with a neighbour."""
    ids = [line_id(t) for t in own]
    gone: set[int] = set()
    for other in neighbours:
        shared = shared_lines(ids, other)
        # pages that share most of their text are copies of each other: what they share says nothing about the template
        if sum(len(own[i]) for i in shared) * 2 <= sum(map(len, own)):
            gone.update(shared)
    return " ".join(t for i, t in enumerate(own) if i not in gone)


def _line_id(text: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


_KEY = ["host", "path", "page_id", "row"]


def with_neighbours(rows: DataFrame) -> DataFrame:
    """rows (host, path, page_id, row, lines and more) with before, after: the lines of the rows just before and after in order of path
    within the host, null at a host's ends.

    Ranges of all four columns are ordered apart, so that a host or a url of any size is split, and each range gets its
    outer rows' neighbours from the ranges beside it: a row a range, of one page's line hashes.
    """
    ranged = cut(rows.repartitionByRange(*_KEY).withColumn("part", F.spark_partition_id()), "lines")
    key = F.struct(*_KEY)
    ends = ranged.groupBy("part").agg(F.min_by(F.struct("host", "lines"), key).alias("first"), F.max_by(F.struct("host", "lines"), key).alias("last"))
    # one row a range
    by_part = Window.orderBy("part")
    ends = ends.select("part", F.lag("last").over(by_part).alias("_below"), F.lead("first").over(by_part).alias("_above"))
    order = Window.partitionBy("part").orderBy(*_KEY)
    own = F.struct("host", "lines")
    near = ranged.withColumns({"_b": F.lag(own).over(order), "_a": F.lead(own).over(order)}).join(F.broadcast(ends), "part")
    same = lambda x: F.when(x["host"] == F.col("host"), x["lines"])
    return near.select(*rows.columns, same(F.coalesce("_b", "_below")).alias("before"), same(F.coalesce("_a", "_above")).alias("after"))


def _template(own: list[int], sizes: list[int], other: list[int]) -> list[int]:
    """Positions of the lines that an article shares with another, none where that is over half of its text: they are copies."""
    shared = shared_lines(own, other)
    return shared if sum(sizes[i] for i in shared) * 2 <= sum(sizes) else []


def _everywhere(articles: DataFrame, shared: DataFrame) -> DataFrame:
    """host, line of shared that over half of the host's different articles have, where it has enough of them."""
    content = F.xxhash64("lines").alias("content")
    n_articles = articles.groupBy("host").agg(F.count_distinct(content).alias("n_articles")).filter(F.col("n_articles") >= LEAST_ARTICLES)
    lines = articles.select("host", content, F.explode(F.array_distinct("lines")).alias("line")).join(shared.select("host", "line").distinct(), ["host", "line"], "left_semi")
    counted = lines.groupBy("host", "line").agg(F.count_distinct("content").alias("n"))
    return counted.join(n_articles, "host").filter(2 * F.col("n") > F.col("n_articles")).select("host", "line")


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """page_id, url, text, n_chars, n_neighbours for every row of pages; null html is an empty page, null urls have no host and
    so each other as neighbours; repeated rows stay. n_neighbours is 0 for pages with an article or main element.

    Only line hashes are ordered by URL. The texts of open pages meet what their neighbours have once; pages with an article meet the lines to
    delete from them, and are shuffled only where those are too many to broadcast.
    """
    read = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(page).alias("html"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            for at in range(0, b.num_rows, 200):
                part = b.slice(at, 200)
                found = [blocks(x) for x in part.column(2).to_pylist()]
                yield part, found, [any(s == 2 for _, s in f) for f in found]

    def lined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found, done in parse(batches):
            own = [[t for t, s in f if s == (2 if d else 1)] for f, d in zip(found, done)]
            lines = [[_line_id(t) for t in x] for x in own]
            columns = {"texts": pa.array([None if d else x for x, d in zip(own, done)], pa.list_(pa.string())), "lines": pa.array(lines, pa.list_(pa.int64())), "sizes": pa.array([[len(t) for t in x] for x in own], pa.list_(pa.int32()))}
            yield pa.RecordBatch.from_pydict({"page_id": part.column(0), "url": part.column(1), "page": part.column(3)} | columns)

    def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found, done in parse(batches):
            gone = [set(x or ()) for x in part.column(3).to_pylist()]
            got = [" ".join(t for t, s in f if s == 2 and not (g and _line_id(t) in g)) for f, d, g in zip(found, done, gone) if d]
            kept = part.filter(pa.array(done, pa.bool_()))
            yield pa.RecordBatch.from_pydict({"page_id": kept.column(0), "url": kept.column(1), "text": pa.array(got, pa.string()), "n_chars": pa.array(list(map(len, got)), pa.int64()), "n_neighbours": pa.array([0] * len(got), pa.int64())})

    def common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*[b.column(k).to_pylist() for k in (2, 3, 4, 5)])
            got = [[own[i] for i in sorted(set(_template(own, sizes, before)) & set(_template(own, sizes, after)))] for own, sizes, before, after in rows]
            yield pa.RecordBatch.from_pydict({"host": b.column(0), "page": b.column(1), "shared": pa.array(got, pa.list_(pa.int64()))})

    def difference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 200):
                part = b.slice(at, 200)
                texts, before, after = (part.column(k).to_pylist() for k in (2, 3, 4))
                others = [[x for x in pair if x] for pair in zip(before, after)]
                got = [differenced(t, o, _line_id) for t, o in zip(texts, others)]
                yield pa.RecordBatch.from_pydict({"page_id": part.column(0), "url": part.column(1), "text": pa.array(got, pa.string()), "n_chars": pa.array(list(map(len, got)), pa.int64()), "n_neighbours": pa.array(list(map(len, others)), pa.int64())})

    schema = "page_id long, url string, text string, n_chars long, n_neighbours long"
    with batch_bytes(pages.sparkSession):
        host, path = host_path(F.col("url"))
        hashed = read.withColumn("page", F.xxhash64("page_id", "url", "html"))
        every = hashed.mapInArrow(lined, "page_id long, url string, page long, texts array<string>, lines array<long>, sizes array<int>")
        every = cut(every.withColumns({"host": host, "path": path, "row": F.xxhash64("url", "texts", F.monotonically_increasing_id())}), "blocks")
        open_pages, articles = every.filter("texts is not null"), every.filter("texts is null")
        near = with_neighbours(open_pages.select(*_KEY, "lines"))
        met = open_pages.select("page_id", "url", "texts", "row").join(near.select(F.col("page_id").alias("_id"), F.col("row").alias("_row"), "before", "after"), F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("row") == F.col("_row")))
        opened = met.select("page_id", "url", "texts", "before", "after").mapInArrow(difference, schema)
        # equal rows are one page here
        once = articles.select("host", "path", "page_id", F.col("page").alias("row"), "lines", "sizes").dropDuplicates(_KEY)
        near = with_neighbours(once).withColumns({"before": F.coalesce("before", "after"), "after": F.coalesce("after", "before")})
        near = near.filter(F.arrays_overlap("lines", "before") & F.arrays_overlap("lines", "after"))
        shared = near.select("host", "row", "lines", "sizes", "before", "after").mapInArrow(common, "host string, page long, shared array<long>")
        shared = cut(shared.select("host", "page", F.explode("shared").alias("line")).distinct(), "shared")
        gone = cut(shared.join(_everywhere(articles, shared), ["host", "line"]).groupBy("page").agg(F.collect_set("line").alias("gone")), "template")
        done = hashed.join(gone, "page", "left").select("page_id", "url", "html", "gone").mapInArrow(settled, schema)
        return done.unionByName(opened)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(table(spark, sf_dir, "pages"))
