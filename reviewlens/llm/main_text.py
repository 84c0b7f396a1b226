"""Main text of web pages by nearest-URL page differencing.

A page is cut into text lines, one per block. Lines in menus, page headers, footers, side bars, notices, adverts, forms,
scripts, styles and reader comments are recognised by their elements and never become lines. What is left of a site's
template is found by differencing: every page is compared with its nearest pages by URL path on the same host, their
lines are aligned by a longest common subsequence, and shared lines are deleted. Pages of a host with the same lines are
folded to one before, so the nearest page is always a different one. In an <article> or <main>, lines that are nothing but
links are deleted like that. Prose there is deleted where VOTES of the nearest articles share it, since one article may
repeat another; quotations are kept. What stands outside is not part of the article.

Only hashes of lines are shuffled. Neighbours come from a window over (host, part of path), whose
pieces are stitched by their first and last pages, so a host with a large share of all pages is no single task.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlens.llm.common import bounded_batches, stored
from reviewlens.llm.url_filter import host_and_path

PIECE = 6
#: From this share of a page's lines on, a nearest page may be another version of it.
COPY_SHARE = 0.9
#: Pages looked at on each side, how many of the nearest of them judge prose, and how many must share a line of it.
REACH = 3
JUDGES = 4
VOTES = 3
#: Bits of alignment rows held at a time; longer alignments are halved.
ROW_BITS = 1 << 26
#: Rows of deletions that are broadcast at most, after counting them.
BROADCAST_ROWS = 5_000

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?][^>]*>?",
    re.DOTALL,
)
RAW = {
    name: re.compile(rf"</{name}\b[^>]*>|\Z", re.IGNORECASE)
    for name in ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")
}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr".split()
)
ARTICLE = frozenset(("article", "main"))
HIDDEN = frozenset(
    "aside audio button canvas datalist dialog footer form head menu nav noscript object select svg template "
    "video".split()
)
ATTRIBUTE = re.compile(
    r"(?P<name>class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:\"(?P<a>[^\"]*)\"|'(?P<b>[^']*)'|(?P<c>[^\s>\"']+)))?",
    re.IGNORECASE,
)
#: Words of class, id and role names that mark what is not the article.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary "
    "consent contentinfo cookie cookies copyright disqus footer gdpr login masthead menu modal nav navbar navigation "
    "newsletter notice notices overlay pager pagination popup promo promotion related recommended replies reply "
    "respond search share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar "
    "widget".split()
)
#: Ends of class names that say what an element holds things in, and beginnings that say something about another element.
HOLDERS = frozenset(
    "area bar block body box button buttons container content form header icons inner item items links list panel posts row "
    "section slot title unit wrap wrapper zone".split()
)
ABOUT = frozenset("has is no not with without".split())
NAME_PARTS = re.compile(r"[a-z]+")
FIXED, LOOSE, PROSE = range(3)


def _attributes(rest: str) -> tuple[bool, bool]:
    """Whether a start tag says that its element isn't shown, and whether its names mark it as no part of the article.

    A name marks an element when its last word does (user-comments, site-footer) or says what holds the marked thing
    (share-buttons), but not when it only tells about another element (has-sidebar) or is about a topic (search-engines).
    """
    gone = marked = False
    if "=" not in rest and "hidden" not in rest.lower():
        return gone, marked
    for m in ATTRIBUTE.finditer(rest):
        name = m["name"].lower()
        value = (m["a"] or m["b"] or m["c"] or "").lower()
        if name == "hidden":
            gone = gone or not value.startswith("until")
        elif name == "aria-hidden":
            gone = gone or value == "true"
        elif name == "style":
            gone = gone or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value))
        else:
            for token in value.split():
                parts = NAME_PARTS.findall(token)
                if parts and parts[0] not in ABOUT and (
                    parts[-1] in MARKS or parts[-1] in HOLDERS and not MARKS.isdisjoint(parts)
                ):
                    marked = True
    return gone, marked


class _Lines:
    """Collects the lines of one page."""

    def __init__(self) -> None:
        self.lines: list[tuple[str, bool, bool, bool]] = []
        self.parts: list[str] = []
        self.plain = False  # the block has text outside links
        self.open: list[tuple[str, bool, bool]] = []  # element, whether it hides what it holds, and does so by its names only
        self.hidden = self.articles = self.links = self.quotes = 0
        self.found = False  # an article has begun

    def text(self, data: str) -> None:
        if not self.hidden and data:
            self.parts.append(data)
            if not self.links and not self.plain and not data.isspace():
                self.plain = True

    def flush(self) -> None:
        if self.parts:
            line = " ".join(entities.unescape("".join(self.parts)).split())
            if line:
                self.lines.append((line, self.articles > 0, not self.plain, self.quotes > 0))
            self.parts, self.plain = [], False

    def start(self, name: str, rest: str) -> None:
        if name == "br":
            self.text("\n")
            return
        if name not in INLINE:
            self.flush()
        if name in ARTICLE:
            # A menu is never around an article: it was left open.
            while any(frame[0] == "nav" for frame in self.open):
                self._pop()
            if not self.found:
                # Names don't hide what is around the article.
                self.hidden -= sum(by_name for _, _, by_name in self.open)
                self.open = [(n, hides and not by_name, False) for n, hides, by_name in self.open]
        if name in VOID or rest.endswith("/") and name in ("path", "use", "circle"):
            return
        gone, marked = _attributes(rest)
        # Names mark neither the article itself nor words inside its prose.
        marked = marked and not (name in ARTICLE and not self.found) and not (name in INLINE and self.articles)
        gone = gone or name in HIDDEN or name == "header" and not self.articles
        whole = name in ("body", "html")
        hides, by_name = (gone or marked) and not whole, marked and not gone and not whole
        self.found = self.found or name in ARTICLE
        if name == "p" and self.open and self.open[-1][0] == "p":
            self._pop()
        if name == "a":
            self.links += 1
        self.open.append((name, hides, by_name))
        self.hidden += hides
        self.articles += name in ARTICLE
        self.quotes += name == "blockquote"

    def _pop(self) -> None:
        name, hides, _ = self.open.pop()
        self.hidden -= hides
        self.articles -= name in ARTICLE
        self.links -= name == "a"
        self.quotes -= name == "blockquote"

    def end(self, name: str) -> None:
        if name not in INLINE:
            self.flush()
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == name:
                while len(self.open) > i:
                    self._pop()
                return
            # An inline end tag doesn't close blocks, and nothing but its own end closes an article.
            if name in INLINE and self.open[i][0] not in INLINE or self.open[i][0] in ARTICLE and name not in ("body", "html"):
                return


def parsed_lines(html: str) -> list[tuple[str, bool, bool, bool]]:
    """The page's lines in order: text, whether in an article, whether nothing but links, whether in a block quotation."""
    page, at = _Lines(), 0
    while True:
        m = MARKUP.search(html, at)
        if m is None:
            # A "<" that starts no markup is text; an unclosed tag at the end is not.
            tail = html[at:]
            page.text(re.sub(r"<[A-Za-z/!][^>]*\Z", "", tail))
            break
        if m.start() > at:
            page.text(html[at : m.start()])
        at = m.end()
        if m["name"] is None:
            continue
        name = m["name"].lower()
        if m["end"]:
            page.end(name)
        elif name in RAW:
            at = RAW[name].search(html, at).end()
            if name not in INLINE:
                page.flush()
        else:
            page.start(name, m["rest"])
    page.flush()
    return page.lines


def page_lines(html: str) -> list[tuple[str, bool, bool]]:
    """The page's lines in order: text, whether in an article, whether nothing but links."""
    return [line[:3] for line in parsed_lines(html)]


def main_lines(html: str) -> tuple[list[str], list[int]]:
    """The lines of the article, or all where there is none, and how each may go.

    LOOSE lines go when the nearest page shares them, PROSE when several do, and FIXED ones stay.
    """
    lines = parsed_lines(html)
    if not any(inside for _, inside, _, _ in lines):
        return [text for text, _, _, _ in lines], [LOOSE] * len(lines)
    held = [line for line in lines if line[1]]
    return [x[0] for x in held], [FIXED if quoted else LOOSE if links else PROSE for _, _, links, quoted in held]


def _rows(own: list[int], other: list[int]) -> Iterator[int]:
    """After each line of `own`, a number whose zero bits are the places in `other` where the common length grows."""
    places: dict[int, int] = {}
    for j, line in enumerate(other):
        places[line] = places.get(line, 0) | 1 << j
    full = (1 << len(other)) - 1
    row = full
    for line in own:
        both = row & places.get(line, 0)
        row = ((row + both) | (row - both)) & full
        yield row


def _lengths(own: list[int], other: list[int]) -> list[int]:
    """Length of the longest common subsequence of `own` and each beginning of `other`."""
    row = (1 << len(other)) - 1
    for row in _rows(own, other):
        pass
    out = [0]
    for bit in reversed(f"{row:0{len(other)}b}" if other else ""):
        out.append(out[-1] + (bit == "0"))
    return out


def shared_lines(own: list[int], other: list[int]) -> list[int]:
    """Indexes in `own` of a longest common subsequence of both, by bit-parallel rows.

    Time is the product of both lengths over the word size, whatever lines repeat. Rows of more than ROW_BITS are not
    held: `own` is halved and `other` cut where both halves share most.
    """
    start, ends = 0, (len(own), len(other))
    while start < min(ends) and own[start] == other[start]:
        start += 1
    i, j = ends
    while min(i, j) > start and own[i - 1] == other[j - 1]:
        i, j = i - 1, j - 1
    outer = [*range(start), *range(i, len(own))]
    known = set(other[start:j])
    at = [k for k in range(start, i) if own[k] in known]
    mine = [own[k] for k in at]
    known = set(mine)
    theirs = [x for x in other[start:j] if x in known]
    if not mine:
        return outer
    found = []
    if len(mine) > 1 and len(mine) * len(theirs) > ROW_BITS:
        half = len(mine) // 2
        before = _lengths(mine[:half], theirs)
        after = _lengths(mine[half:][::-1], theirs[::-1])[::-1]
        cut = max(range(len(before)), key=lambda k: before[k] + after[k])
        found = shared_lines(mine[:half], theirs[:cut])
        found += [half + k for k in shared_lines(mine[half:], theirs[cut:])]
    else:
        rows = list(_rows(mine, theirs))
        i, j = len(mine), len(theirs)
        while i and j:
            if rows[i - 1] >> (j - 1) & 1:
                j -= 1
                continue
            i -= 1
            # The length grew here before this line already, or this line is shared.
            if not i or rows[i - 1] >> (j - 1) & 1:
                found.append(i)
                j -= 1
    return sorted(outer + [at[k] for k in found])


@F.arrow_udf(returnType=T.StructType([T.StructField("hashes", T.ArrayType(T.LongType())), T.StructField("kinds", T.BinaryType())]))
def line_hashes(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for part in parts:
        hashes, kinds = [], []
        for page in part.to_pylist():
            lines, ways = main_lines(page or "")
            hashes.append([xxhash.xxh3_64_intdigest(line) - (1 << 63) for line in lines])
            kinds.append(bytes(ways))
        yield pa.StructArray.from_arrays(
            [pa.array(hashes, type=pa.list_(pa.int64())), pa.array(kinds, type=pa.binary())], names=["hashes", "kinds"]
        )


def _common(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def deleted_lines(own: dict, others: list[dict]) -> list[int]:
    """Places of the page's lines that differencing deletes; `others` are its nearest pages, all different from it.

    Loose lines go when the nearest page shares them. A page that shares COPY_SHARE of all lines may be another version
    of this one, so a page that shares less decides in its stead; where there is none, the lines are template that
    two pages share. Prose goes when VOTES of the JUDGES nearest articles that share less than COPY_SHARE have it as prose.
    """
    hashes, kinds = own["hashes"], own["kinds"]
    known = set(hashes)
    near = sorted(others, key=lambda x: -_common(x["path"], own["path"]))

    def all_shared(x: dict) -> list[int]:
        return [] if known.isdisjoint(x["hashes"]) else shared_lines(hashes, x["hashes"])

    def of_kind(kind: int, x: dict, everything: list[int]) -> list[int]:
        mine = [i for i, k in enumerate(kinds) if k == kind]
        theirs = [h for h, k in zip(x["hashes"], x["kinds"]) if k == kind]
        if not everything or len(mine) == len(hashes) and len(theirs) == len(x["hashes"]):
            return everything
        return [mine[k] for k in shared_lines([hashes[i] for i in mine], theirs)]

    aligned = [(x, all_shared(x)) for x in near]
    apart = [(x, shared) for x, shared in aligned if len(shared) < COPY_SHARE * len(hashes)]
    gone: set[int] = set()
    if LOOSE in kinds and apart:
        gone.update(of_kind(LOOSE, *apart[0]))
    elif LOOSE in kinds:
        votes = Counter(i for x, shared in aligned for i in of_kind(LOOSE, x, shared))
        gone.update(i for i, n in votes.items() if n > 1)
    judges = [(x, shared) for x, shared in apart if PROSE in x["kinds"]][:JUDGES] if PROSE in kinds else []
    votes = Counter(i for x, shared in judges for i in of_kind(PROSE, x, shared))
    gone.update(i for i, n in votes.items() if n >= VOTES)
    return sorted(gone)


@F.arrow_udf(returnType=T.ArrayType(T.LongType()))
def deletions(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for mine, near in parts:
        rows = [deleted_lines(own, others) for own, others in zip(mine.to_pylist(), near.to_pylist(), strict=True)]
        yield pa.array(rows, type=pa.list_(pa.int64()))


@F.arrow_udf(returnType=T.StringType())
def kept_text(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for pages, dropped in parts:
        rows = []
        for page, places in zip(pages.to_pylist(), dropped.to_pylist(), strict=True):
            gone = set(places or ())
            rows.append("\n".join(line for i, line in enumerate(main_lines(page or "")[0]) if i not in gone))
        yield pa.array(rows, type=pa.string())


def neighbours(pages: DataFrame) -> DataFrame:
    """The pages as `own`, with `near`: up to REACH pages before and REACH after each one by path within its host.

    `pages` has host, path, key, hashes and kinds. Each piece of a host (paths with the same first characters) is ordered
    on its own; first and last pages of the pieces are carried across.
    """
    row = F.struct("path", "key", "hashes", "kinds")
    piece = F.substring("path", 1, PIECE)
    cut = pages.withColumn("piece", F.struct(F.col("host"), piece.alias("head")))
    within = Window.partitionBy("piece").orderBy("path", "key")
    local = cut.select(
        "key", "piece", row.alias("own"),
        F.array_compact(F.array(*[F.lag(row, n).over(within) for n in range(REACH, 0, -1)])).alias("before"),
        F.array_compact(F.array(*[F.lead(row, n).over(within) for n in range(1, REACH + 1)])).alias("after"),
    )
    # The first pages of a piece have fewer than REACH before them, the last ones fewer than REACH after them.
    ends = local.filter((F.size("before") < REACH) | (F.size("after") < REACH)).groupBy("piece").agg(
        F.array_sort(F.collect_list(F.when(F.size("before") < REACH, F.col("own")))).alias("first"),
        F.array_sort(F.collect_list(F.when(F.size("after") < REACH, F.col("own")))).alias("last"),
    )
    # Every piece has a page, so REACH pieces on each side are enough.
    across = Window.partitionBy("piece.host").orderBy("piece.head")
    ends = ends.select(
        "piece",
        F.flatten(F.collect_list("last").over(across.rowsBetween(-REACH, -1))).alias("far_before"),
        F.flatten(F.collect_list("first").over(across.rowsBetween(1, REACH))).alias("far_after"),
    )
    before = F.concat("far_before", "before")
    before = F.slice(before, F.greatest(F.size(before) - REACH + 1, F.lit(1)), F.lit(REACH))
    return local.join(ends, "piece").select(
        "key", "own", F.concat(before, F.slice(F.concat("after", "far_after"), 1, REACH)).alias("near")
    )


def main_text(
    pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", out_col: str = "text"
) -> DataFrame:
    """Each row with `out_col`, the main text of its page; a column of that name is replaced.

    Character references are decoded, white space in a block becomes one space, and blocks are joined by one line
    feed. Null and empty pages, and pages without lines, give an empty text. Pages without URL form one host. Pages of a
    host with the same lines are one page here and lose the same. A page with a single other version of it as its
    only neighbour loses nothing; in a host of versions of one page without an <article>, their common lines are template.
    Prose of an <article> stays on hosts with fewer than VOTES other pages. Pages are parsed whole, once for the hashes
    and once for the text.
    """
    host, path = host_and_path(F.col(url_col))
    key = F.xxhash64(F.col(id_col), F.col(url_col), F.col(html_col))
    hashed = bounded_batches(pages).select(
        key.alias("key"), host.alias("host"), path.alias("path"),
        line_hashes.asNondeterministic()(F.col(html_col)).alias("lines"),
    )
    hashed = hashed.select("key", "host", "path", "lines.hashes", "lines.kinds").withColumn(
        "same", F.xxhash64("host", "hashes", "kinds")
    )
    # Rows that are alike have the same key.
    hashed = stored(hashed.dropDuplicates(["key"]), "page-hashes")
    first = F.min_by(F.struct("host", "path", "hashes", "kinds"), F.struct("path", "key")).alias("page")
    folded = hashed.filter(F.size("hashes") > 0).groupBy("same").agg(first).select(F.col("same").alias("key"), "page.*")
    gone = neighbours(folded).filter(F.size("near") > 0).select(
        F.col("key").alias("same"), deletions.asNondeterministic()("own", "near").alias("__gone")
    )
    gone = stored(gone.filter(F.size("__gone") > 0), "page-deletions")
    few = gone.count() <= BROADCAST_ROWS
    gone = hashed.select("same", F.col("key").alias("__key")).join(F.broadcast(gone) if few else gone, "same")
    gone = stored(gone.select("__key", "__gone"), "page-deletions-of-rows")
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    kept = [c for c in pages.columns if c != out_col]
    keyed = pages.select(*kept, F.col(html_col).alias("__html"), key.alias("__key"))
    return keyed.join(gone, "__key", "left").select(*kept, kept_text("__html", "__gone").alias(out_col))
