"""Main text of web pages by differencing them with the page of the nearest URL.

A page's mark-up is cut into blocks, the text lines of the page, without what its tags
and names call menus, headers, footers, side bars, notices, adverts, forms, scripts,
styles or comments. Names count as a whole, and not on an element around the page's main
element, heading or only article. Pages are then put in the order of host and URL path,
and each is paired with the neighbour of its own host whose path is nearer. Their lines
are aligned by the longest common subsequence; shared lines are what the site repeats,
and go, on every page. An ``article`` or ``main`` element is evidence only against
deleting a shared passage in it; lines outside that no other page shares stay. Where all
lines of a page are shared and none is in such an element, pages are copies of each other
and nothing tells the site's lines apart, so they stay.

Only hashes of lines travel to the partner's task, and every page is the partner of two
others at most, so a host may hold any share of the pages.
"""

from __future__ import annotations

import bisect
import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitewatch.llm.common import chunks, own_names
from sitewatch.operators.checkpoints import cut

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*?)(?:>|\Z)",
    re.DOTALL,
)
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
# Elements of HTML.
UNREAD = frozenset("script style noscript template svg math iframe object canvas audio video".split())
APART = frozenset(
    "nav header footer aside form head title menu dialog select button textarea option label fieldset".split()
)
MAIN = frozenset("article main".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd mark q s samp small span strike"
    " strong sub sup time tt u var wbr link meta".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Words in names of elements that hold no main text.
APART_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar sidebars menu"
    " nav navbar navigation breadcrumb breadcrumbs header masthead footer comment comments commentlist disqus respond"
    " cookie cookies consent notice notices popup modal newsletter subscribe signup login share sharing social related"
    " recommended widget contentinfo complementary search toolbar pagination pager".split()
)
# Words that may stand beside them in one name, such as ``post-comments`` or ``left-sidebar``.
BESIDE_WORDS = frozenset(
    "site page post posts main primary secondary top bottom left right list box bar area section block unit slot links"
    " items button buttons icons form thread".split()
)


def _named_apart(attributes: str) -> bool:
    """Whether a whole name of the element, with no words but these, means no main text."""
    for a, b, c in NAMED.findall(attributes):
        for name in (a or b or c).lower().split():
            words = {w for w in re.split("[^a-z]+", name) if w}
            if not words.isdisjoint(APART_WORDS) and words <= APART_WORDS | BESIDE_WORDS:
                return True
    return False


def _tags(page: str) -> list[tuple[int, int, str, bool, bool, str]]:
    """(start, end, name, closing, empty, attributes); start and end span what is no text."""
    found: list[tuple[int, int, str, bool, bool, str]] = []
    at = 0
    while tag := TAG.search(page, at):
        start, at = tag.start(), max(tag.end(), tag.start() + 1)
        name = (tag[2] or "").lower()
        closing, empty = bool(tag[1]), name in VOID or (tag[3] or "").endswith("/")
        if name in UNREAD:
            if not closing and not empty:
                close = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.IGNORECASE).search(page, at)
                at = close.end() if close else len(page)
            name = ""
        found.append((start, at, name, closing, empty, tag[3] or ""))
    return found


def _closed_at(tags: list[tuple[int, int, str, bool, bool, str]]) -> dict[int, int]:
    """The closing tag of every opening tag that has one, as indices."""
    opened: dict[str, list[int]] = {}
    ends: dict[int, int] = {}
    for i, (_, _, name, closing, empty, _) in enumerate(tags):
        if closing:
            if opened.get(name):
                ends[opened[name].pop()] = i
        elif name and not empty:
            opened.setdefault(name, []).append(i)
    return ends


def blocks(page: str) -> list[tuple[str, bool]]:
    """Text blocks in page order and whether each lies in the page's article.

    That is its only article, or of several the one with the heading; where there is no
    article, the ``main`` element. Comments and teasers in articles of their own are none.
    """
    tags = _tags(page)
    ends = _closed_at(tags)
    opening = [i for i, t in enumerate(tags) if t[2] and not t[3]]
    mains, heads, articles = ([i for i in opening if tags[i][2] == n] for n in ("main", "h1", "article"))
    # An element around what tells the story is a wrapper, whatever it is called.
    story = mains or heads or (articles if len(articles) == 1 else [])

    def apart(i: int) -> bool:
        name, empty, attributes = tags[i][2], tags[i][4], tags[i][5]
        if name in APART and name != "form":
            return True
        if empty or name in ("main", "html", "body"):
            return False
        if name != "form" and not (attributes and _named_apart(attributes)):
            return False
        at = bisect.bisect_left(story, i)
        return not (i in ends and at < len(story) and story[at] <= ends[i])

    found: list[tuple[str, int]] = []  # text, and its article, else its main element, else -1
    pieces: list[str] = []
    tops: list[int] = []  # articles that lie in no other
    nested: list[tuple[str, int]] = []
    own = -1
    stop = False  # within an element that is never closed, which does not hide an article

    def flush() -> None:
        text = " ".join("".join(pieces).split())
        pieces.clear()
        if text:
            found.append((text, own))

    at = i = 0
    while i <= len(tags):
        start, end, name, closing, empty, _ = tags[i] if i < len(tags) else (len(page), len(page), "", False, False, "")
        if start > at and not stop:
            pieces.append(html.unescape(page[at:start]))
        at, i = end, i + 1
        if not name:
            continue
        if stop:
            if name not in MAIN or closing or apart(i - 1):
                continue
            stop = False
        out = not closing and not empty and apart(i - 1)
        if name in INLINE and not out:
            if name == "br":
                pieces.append(" ")
            continue
        flush()
        if out:
            if i - 1 in ends:
                i = ends[i - 1]
                at, i = tags[i][1], i + 1
            else:
                stop = True
        elif name in MAIN and not empty:
            if not closing:
                nested.append((name, i - 1))
                if name == "article" and sum(n == name for n, _ in nested) == 1:
                    tops.append(i - 1)
            elif any(n == name for n, _ in nested):
                while nested.pop()[0] != name:
                    pass
            inner = [k for n, k in nested if n == "article"] or [k for _, k in nested]
            own = inner[0] if inner else -1
    if not stop:
        flush()
    if len(tops) > 1:
        tops = [k for k in tops if (h := bisect.bisect_left(heads, k)) < len(heads) and heads[h] < ends.get(k, len(tags))]
        tops = tops if len(tops) == 1 else []
        return [(text, k in tops) for text, k in found]
    return [(text, k in tops if tops else k >= 0) for text, k in found]


def common_lines(one: list[int], two: list[int]) -> list[int]:
    """Indices in ``one`` of a longest common subsequence with ``two``.

    Bit-parallel rows, and Hirschberg's halving to find the lines in linear memory.
    """
    both = set(one) & set(two)
    a = [(i, x) for i, x in enumerate(one) if x in both]
    todo, shared = [(a, [x for x in two if x in both])], []
    while todo:
        a, b = todo.pop()
        if not a or not b:
            continue
        if len(a) == 1:
            shared += [a[0][0]] * (a[0][1] in b)
            continue
        middle = len(a) // 2
        before = _lengths([x for _, x in a[:middle]], b)
        after = _lengths([x for _, x in a[middle:]][::-1], b[::-1])[::-1]
        split = int(np.argmax(before + after))
        todo += [(a[:middle], b[:split]), (a[middle:], b[split:])]
    return sorted(shared)


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Length of the longest common subsequence of ``a`` with every prefix of ``b``."""
    places: dict[int, int] = {}
    for j, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full
    for x in a:
        met = row & places.get(x, 0)
        row = ((row + met) | (row - met)) & full
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.append(0, np.cumsum(1 - bits.astype(np.int64)))


def host(url: Column) -> Column:
    named = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.regexp_replace(named, r"^www\.", "")


def path(url: Column) -> Column:
    """The path with numbers filled up to equal length, so that order means nearness."""
    plain = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    trimmed = F.regexp_replace(plain, r"(?:\.html?|/)$", "")
    return F.regexp_replace(F.regexp_replace(trimmed, r"(\d+)", "00000000000$1"), r"0*(\d{12,})", "$1")


def _blocks_of(pages: DataFrame, page_id: str, url: str, page: str) -> DataFrame:
    kept = own_names(pages, page_id, url, page).withColumn("_key", F.xxhash64(page_id, url, page))
    types = dict(kept.dtypes)
    schema = f"`{page_id}` {types[page_id]}, `{url}` {types[url]}, _key long, lines array<string>, inside array<boolean>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, page):
                found = [blocks(p or "") for p in part.column(page).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(page_id),
                        part.column(url),
                        part.column("_key"),
                        pa.array([[t for t, _ in f] for f in found], pa.list_(pa.string())),
                        pa.array([[i for _, i in f] for f in found], pa.list_(pa.bool_())),
                    ],
                    [page_id, url, "_key", "lines", "inside"],
                )

    return kept.mapInArrow(run, schema)


def nearest_pages(pages: DataFrame, url: str = "url") -> DataFrame:
    """``_key, partner``: of the neighbours in the host's order, the one with the nearer path.

    Nearer means more equal leading characters; the page before wins a tie. The order is
    global, so a page gets the same partner however the table is partitioned.
    """
    keyed = pages.select("_key", host(F.col(url)).alias("host"), path(F.col(url)).alias("path")).distinct()
    placed = cut(
        keyed.repartitionByRange("host", "path", "_key")
        .sortWithinPartitions("host", "path", "_key")
        .withColumn("place", F.monotonically_increasing_id()),
        "page_order",
    )
    # One row per partition of the order: where it begins and where the one before it ends.
    part = F.shiftright("place", 33)
    ends = placed.groupBy(part.alias("part")).agg(F.min("place").alias("first"), F.max("place").alias("last"))
    before = ends.select("first", F.lag("last").over(Window.orderBy("part")).alias("end"))
    follows = placed.join(F.broadcast(before), placed["place"] == before["first"], "left").select(
        "_key", "host", "path", F.when(F.col("first").isNull(), F.col("place") - 1).otherwise(F.col("end")).alias("prior")
    )
    prior = placed.select(F.col("place").alias("prior"), F.col("_key").alias("k"), F.col("host").alias("h"), F.col("path").alias("p"))
    pairs = follows.join(prior, "prior").where("host = h")
    one, two = F.split("path", ""), F.split("p", "")
    equal = F.zip_with(one, two, lambda x, y: F.coalesce(x == y, F.lit(False)))
    nearness = F.coalesce(F.array_position(equal, False), F.lit(0))
    near = F.when(nearness == 0, F.size(equal) + 1).otherwise(nearness).cast("int").alias("near")
    pairs = cut(pairs.select("_key", "k", near), "page_pairs")
    sides = pairs.select("_key", F.struct("near", F.lit(1).alias("before"), F.col("k").alias("partner")).alias("s")).unionByName(
        pairs.select(F.col("k").alias("_key"), F.struct("near", F.lit(0).alias("before"), F.col("_key").alias("partner")).alias("s"))
    )
    return sides.groupBy("_key").agg(F.max("s").alias("s")).select("_key", F.col("s.partner").alias("partner"))


def shared_lines(lines: DataFrame, partners: DataFrame) -> DataFrame:
    """``_key, shared``: indices of the lines, given as hashes, that a page shares."""
    hashes = lines.select("_key", "own").dropDuplicates(["_key"])
    other = hashes.select(F.col("_key").alias("partner"), F.col("own").alias("theirs"))
    both = hashes.join(partners, "_key").join(other, "partner").select("_key", "own", "theirs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [
                common_lines(a, b)
                for a, b in zip(batch.column("own").to_pylist(), batch.column("theirs").to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_key"), pa.array(told, pa.list_(pa.int32()))], ["_key", "shared"]
            )

    return both.mapInArrow(run, "_key long, shared array<int>")


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars, n_lines, n_shared`` per row.

    Null or empty mark-up gives an empty text. A null URL has an empty host and path, so
    such pages are compared with each other. Repeated rows are one page for the pairing
    and get the same text; ids may be null; an empty table gives an empty result; further
    columns are ignored.
    """
    found = _blocks_of(pages, page_id, url, page)
    # Pages are cut into blocks twice, which is cheaper than to keep all texts meanwhile.
    hashed = found.select("_key", url, F.transform("lines", lambda x: F.xxhash64(x)).alias("own"))
    hashed = cut(hashed, "page_lines")
    told = cut(shared_lines(hashed, nearest_pages(hashed, url)), "page_shared")
    joined = found.join(told, "_key", "left").withColumn("shared", F.coalesce("shared", F.array().cast("array<int>")))
    marked = F.exists("inside", lambda i: i)
    alike = F.size("shared") == F.size("lines")
    kept = F.filter(
        "lines", lambda _, i: F.get("inside", i) | (alike & ~marked) | ~F.array_contains("shared", i)
    )
    text = F.array_join(kept, "\n\n")
    return joined.select(
        page_id,
        url,
        text.alias("text"),
        F.length(text).cast("long").alias("n_chars"),
        F.size("lines").alias("n_lines"),
        F.size("shared").alias("n_shared"),
    )
