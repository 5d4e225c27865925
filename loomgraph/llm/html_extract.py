"""Main text of web pages by template deduction.

Tokens are tags, known by their path of elements and classes, and whole blocks of text. Tokens of a host with one occurrence
vector (as many times in the same pages) form an equivalence class. A class is valid if its tokens come in one order and its
tuples always stand in the same gap of the class around them. Valid classes, nested in each other, are the host's template;
the text after each of its tokens is a slot. The slot with most text that is no link and not in page furniture is the main
one; its slots' container, with the page's heading, is the article.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import BROADCAST_ROWS, lean, written
from .url_filter import host_of

#: Share of a host's pages, and pages at least, in which a token must occur for its class to be part of the template.
MIN_SUPPORT = 0.6
MIN_PAGES = 8
#: Share of a class's pages that must agree on its order and on the gap it nests in.
MIN_AGREE = 0.9
#: Share of a slot's text above which links make it a menu.
MOST_LINKS = 0.5
#: Parts into which the pages of one host are dealt where templates are joined by shuffle.
SALTS = 32
#: Pages that a task parses at a time.
PIECE = 200

# HTML element names and common names of page furniture.
_RAW = {"script", "style", "noscript", "template", "svg", "iframe", "textarea", "select", "button", "object", "math", "canvas", "title"}
_VOID = {"area", "base", "col", "embed", "hr", "input", "link", "meta", "param", "source", "track"}
_INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
_LEAF = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "pre", "caption", "figcaption", "legend", "summary", "address", "option"}
_ENDED_BY = {
    "li": {"p", "li"}, "dt": {"p", "dt", "dd"}, "dd": {"p", "dt", "dd"}, "tr": {"p", "tr", "td", "th"}, "td": {"p", "td", "th"}, "th": {"p", "td", "th"}, "option": {"option"},
    "tbody": {"p", "tr", "td", "th", "thead", "tbody"}, "tfoot": {"p", "tr", "td", "th", "thead", "tbody"}, "body": {"head"}, **{f"h{k}": {"p"} | {f"h{n}" for n in range(1, 7)} for k in range(1, 7)},
}
_ANY_BLOCK = {"p"}
_FURNITURE_TAGS = {"nav", "footer", "aside", "form", "dialog", "menu", "head", "fieldset"}
_FURNITURE_NAMES = {
    "ad", "ads", "adbox", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disqus", "footer", "form",
    "header", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "pager", "pagination", "popup", "promo", "promoted", "promotion", "recommended", "related",
    "replies", "reply", "responses", "search", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "subscription", "toolbar", "topbar", "widget", "widgets",
}
_LAYOUT = {"with", "has", "no", "is", "without", "layout"}
_OWN = {"article", "post", "entry", "content", "story"}
_FURNITURE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu", "menubar"}

_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|itemprop)\b\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_NAME = re.compile(r"[a-z]+")
_NUMBER = re.compile(r"[0-9]{2,}")
_NAME_AT = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_QUOTED = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")


def _furniture(tag: str, attributes: str, inside_article: bool) -> bool:
    if tag in _FURNITURE_TAGS or tag == "header" and not inside_article:
        return True
    for m in _ATTRIBUTE.finditer(attributes) if attributes else ():
        kind, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if kind == "hidden" or kind == "role" and value in _FURNITURE_ROLES:
            return True
        if kind in ("class", "id") and tag not in ("body", "html", "article", "main"):
            for word in value.split():
                names = _NAME.findall(word)
                # with-sidebar and the like tell of a page's layout; article-header inside an article is its own.
                if names and names[0] not in _LAYOUT and any(n in _FURNITURE_NAMES for n in names) and not (inside_article and names[0] in _OWN):
                    return True
    return False


@lru_cache(maxsize=20_000)
def _classes(attributes: str) -> str:
    """Class and id words, sorted; numbers of several digits, which tell one page from the next, count as equal."""
    return " ".join(sorted(_NUMBER.sub("#", w) for a in _ATTRIBUTE.finditer(attributes) if a[1].lower() in ("class", "id") for w in (a[2] or a[3] or a[4] or "").split()))


@lru_cache(maxsize=len(_RAW))
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}\b[^>]*+(?:>|\Z)", re.I)


@dataclass(slots=True)
class Element:
    """An open element: its parent, its token, and whether it lies in an article or in page furniture."""

    up: Element | None
    tag: str
    token: int
    article: bool
    furniture: bool


@dataclass(slots=True)
class Block:
    """A block of text: the place of its token among the page's, its element, and how many of its characters are in links."""

    at: int
    text: str
    inside: Element
    links: int


@dataclass(slots=True)
class Page:
    tokens: list[int] = field(default_factory=list)
    blocks: list[Block] = field(default_factory=list)


def _hash(s: str) -> int:
    return xxhash.xxh3_64_intdigest(s.encode("utf-8", "surrogatepass")) - (1 << 63)


@lru_cache(maxsize=100_000)
def _path(above: int, tag: str, classes: str) -> int:
    return _hash(f"{above}/{tag}.{classes}")


def _closing(token: int) -> int:
    return token ^ 0x5555555555555555


def _tag_end(page: str, at: int) -> int:
    """Where the tag that begins at `at` ends: its first > outside quotes, or of an unclosed quote the first > at all; -1 if there is none."""
    end = page.find(">", at)
    if end < 0:
        return -1
    m = _QUOTED.match(page, at)
    return m.end() - 1 if m else end


def parse(page: str) -> Page:
    """The tokens and blocks of a page, in one pass over it.

    A block ends at any tag that isn't inline. Scripts, styles, comments and other raw elements are no text. Elements that
    stay open are closed by what ends them or with the page. Character references are decoded, white space becomes one space.
    """
    out = Page()
    top = Element(None, "", 0, False, False)
    still = Counter()  # open elements by tag
    text: list[str] = []
    links, in_link = 0, False

    def flush() -> None:
        nonlocal links, in_link
        if text:
            s = " ".join(html.unescape("".join(text)).split())
            text.clear()
            if s:
                out.blocks.append(Block(len(out.tokens), s, top, min(links, len(s))))
                out.tokens.append(_hash(f"{top.token}>{s}"))
        links, in_link = 0, False

    def close() -> None:
        nonlocal top
        flush()
        out.tokens.append(_closing(top.token))
        still[top.tag] -= 1
        top = top.up

    def add(s: str) -> None:
        nonlocal links
        text.append(s)
        if in_link:
            links += len(s)

    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            add(page[at:])
            break
        if lt > at:
            add(page[at:lt])
        m = _NAME_AT.match(page, lt)
        if m is None:
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 4)
                at = n if end < 0 else end + 3
            elif page.startswith("<![CDATA[", lt):
                end = page.find("]]>", lt)
                at = n if end < 0 else end + 3
            elif page[lt + 1 : lt + 2] in ("!", "?", "/"):
                end = page.find(">", lt)
                at = n if end < 0 else end + 1
            else:
                add("<")
                at = lt + 1
            continue
        tag, ends = m[2].lower(), bool(m[1])
        end = _tag_end(page, m.end())
        if end < 0:
            break  # the page ends inside a tag
        attributes = page[m.end() : end]
        at = end + 1
        if tag in _INLINE:
            if tag in ("br", "img"):
                add(" ")
            elif tag == "a":
                in_link = not ends
            continue
        if tag in _RAW:
            if not ends and not attributes.endswith("/"):
                found = _raw_end(tag).search(page, at)
                at = found.end() if found else n
                add(" ")
            continue
        if ends:
            flush()
            if still[tag]:
                while top.tag != tag:
                    close()
                close()
            continue
        flush()
        if tag in _VOID:
            continue
        ended = _ENDED_BY.get(tag, _ANY_BLOCK)
        while top.tag in ended:
            close()
        classes = _classes(attributes) if attributes else ""
        top = Element(top, tag, _path(top.token, tag, classes), top.article or tag in ("article", "main"), top.furniture or _furniture(tag, attributes, top.article))
        still[tag] += 1
        out.tokens.append(top.token)
    while top.up is not None:
        close()
    flush()
    return out


def main_text(page: str) -> str:
    """The article of a page by its own tree alone: without page furniture, and of a page that marks articles these only."""
    return _own_text(parse(page))


def _own_text(page: Page) -> str:
    kept = [b for b in page.blocks if not b.inside.furniture]
    if any(b.inside.article for b in kept):
        kept = [b for b in kept if b.inside.article]
    return "\n\n".join(b.text for b in kept)


def fit_page(page: Page, classes: dict[int, int], sizes: dict[int, int]) -> list[tuple[int, int, int]]:
    """(class, order, parent) of each class on a page: hashes of the order of its tokens and of the gap that its tuples stand in; 0 where they differ within the page."""
    around: list[int] = []  # classes with an open tuple, the innermost last
    count: dict[int, int] = {}
    first: dict[int, list[int]] = {}
    parent: dict[int, int] = {}
    broken: set[int] = set()
    for t in page.tokens:
        c = classes.get(t)
        if c is None:
            continue
        k, size = count.get(c, 0), sizes[c]
        i = k % size
        count[c] = k + 1
        if k < size:
            first.setdefault(c, []).append(t)
        elif first[c][i] != t:
            broken.add(c)
        if i == 0:
            own = _path(around[-1], "gap", str(count[around[-1]] % sizes[around[-1]])) if around else 1
            if parent.setdefault(c, own) != own:
                broken.add(c)
            around.append(c)
        elif c in around:
            while around[-1] != c:
                broken.add(around.pop())
        if i == size - 1 and around and around[-1] == c:
            around.pop()
    return [(c, 0, 0) if c in broken or n % sizes[c] else (c, _hash(" ".join(map(str, first[c]))), parent[c]) for c, n in count.items()]


def slots_of(page: Page, known) -> Iterator[tuple[int, Block, bool]]:
    """Each block with its slot, the last known token before it (0: none), and whether its own text is a known token."""
    slot, at = 0, 0
    for b in page.blocks:
        for t in page.tokens[at : b.at]:
            if t in known:
                slot = t
        at = b.at
        yield slot, b, page.tokens[b.at] in known


def _page_rows(pages: DataFrame, key: str, url: str, page: str) -> DataFrame:
    return pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.coalesce(F.col(page), F.lit("")).alias("html"), host_of(F.col(url)).alias("host"))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, PIECE):
            yield batch.slice(lo, PIECE)


def classes_of(rows: DataFrame, support: float = MIN_SUPPORT, least: int = MIN_PAGES) -> DataFrame:
    """(host, token, class, size, tag): tokens of frequent equivalence classes that hold a tag and at least two tokens.

    The occurrence vector is known by the xor of hashes of (page, times), so no task gathers it. A class of text alone is
    content that pages copy from each other.
    """

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _pieces(batches):
            own, token, times, tag = [], [], [], []
            for i, h in enumerate(piece.column("html").to_pylist()):
                p = parse(h)
                places = {b.at for b in p.blocks}
                for is_tag in (True, False):
                    c = Counter(t for k, t in enumerate(p.tokens) if (k in places) != is_tag)
                    own += [i] * len(c)
                    token += c.keys()
                    times += c.values()
                    tag += [is_tag] * len(c)
            at = pa.array(own, pa.int64())
            yield pa.RecordBatch.from_arrays([piece.column("key").take(at), piece.column("host").take(at), pa.array(token, pa.int64()), pa.array(times, pa.int64()), pa.array(tag, pa.bool_())], names=["key", "host", "token", "times", "tag"])

    seen = rows.select("key", "host", "html").mapInArrow(run, f"key {dict(rows.dtypes)['key']}, host string, token long, times long, tag boolean")
    vectors = seen.groupBy("host", "token").agg(F.count(F.lit(1)).alias("pages"), F.bit_xor(F.xxhash64("key", "times")).alias("vector"), F.max("tag").alias("tag"))
    often = written(vectors.where(F.col("pages") >= least), "tokens")
    totals = rows.groupBy("host").agg(F.count(F.lit(1)).alias("total"))
    enough = often.join(totals, "host").where(F.col("pages") >= F.lit(support) * F.col("total")).withColumn("class", F.xxhash64("pages", "vector"))
    sizes = enough.groupBy("host", "class").agg(F.count(F.lit(1)).alias("size"), F.max("tag").alias("nests")).where("nests AND size > 1")
    return enough.join(sizes.select("host", "class", "size"), ["host", "class"]).select("host", "token", "class", F.col("size").cast("long").alias("size"), "tag")


def _with_host(rows: DataFrame, table: DataFrame, columns: tuple[str, ...], run: Callable, schema: str) -> DataFrame:
    """mapInArrow of run(batches, of_host) over pages; of_host(batch, i) has the host's rows of a written table, as a list for each of its columns."""
    if table.count() <= BROADCAST_ROWS:
        by_host: dict[str, list[list]] = {}
        for r in table.select("host", *columns).collect():
            lists = by_host.setdefault(r["host"], [[] for _ in columns])
            for held, c in zip(lists, columns, strict=True):
                held.append(r[c])
        shared, none = rows.sparkSession.sparkContext.broadcast(by_host), [[] for _ in columns]
        return rows.mapInArrow(lean(lambda batches: run(batches, lambda batch, i: shared.value.get(batch.column("host")[i].as_py(), none))), schema)
    # More than may be sent to all: each host's rows, bounded by the size of its template, go to the parts that its pages are dealt to.
    own = table.groupBy("host").agg(F.collect_list(F.struct(*columns)).alias("held"))
    lists = own.select("host", "held", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")).join(lists, ["host", "salt"], "left").select("key", "url", "html", "host", *(F.col(f"held.{c}").alias(f"held_{c}") for c in columns))
    return dealt.mapInArrow(lean(lambda batches: run(batches, lambda batch, i: [batch.column(f"held_{c}")[i].as_py() or [] for c in columns])), schema)


def templates(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """(host, token, fixed, kept) of each host's template: whether a token is text of a valid class, and whether the slot after it belongs to the article.

    A host without a valid container around its main slot, or with no text outside its template, has no template.
    """

    def run(batches: Iterator[pa.RecordBatch], of_host) -> Iterator[pa.RecordBatch]:
        names = ["host", "class", "order", "parent", "pages", "slot", "plain", "links", "chars", "heading", "homes"]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.struct([("token", pa.int64()), ("article", pa.bool_())]))]
        for piece in _pieces(batches):
            fits, slots = Counter(), {}
            for i, (h, host) in enumerate(zip(piece.column("html").to_pylist(), piece.column("host").to_pylist(), strict=True)):
                token, own, size = of_host(piece, i)
                if not token:
                    continue
                known, sizes = dict(zip(token, own, strict=True)), dict(zip(own, size, strict=True))
                p = parse(h)
                fits.update((host, *x) for x in fit_page(p, known, sizes))
                for slot, b, fixed in slots_of(p, known):
                    held = slots.get((host, slot))
                    if held is None:
                        homes, e = [], b.inside
                        while e.up is not None:
                            if e.tag not in _LEAF and e.token in known:
                                homes.append({"token": e.token, "article": e.tag in ("article", "main")})
                            e = e.up
                        held = slots[host, slot] = [0, 0, 0, b.inside.tag == "h1" and not b.inside.furniture, homes]
                    if not fixed:
                        held[2] += len(b.text)
                        held[1] += b.links
                        if not b.inside.furniture:
                            held[0] += len(b.text) - b.links
            c, s = len(fits), len(slots)
            cols = [[*(k[0] for k in fits), *(k[0] for k in slots)]]
            cols += [[*(k[j] for k in fits), *([None] * s)] for j in (1, 2, 3)] + [[*fits.values(), *([None] * s)], [*([None] * c), *(k[1] for k in slots)]]
            cols += [[*([None] * c), *(v[j] for v in slots.values())] for j in range(5)]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds, strict=True)], names=names)

    schema = "host string, class long, order long, parent long, pages long, slot long, plain long, links long, chars long, heading boolean, homes array<struct<token long, article boolean>>"
    found = written(_with_host(rows, classes, ("token", "class", "size"), run, schema).groupBy("host", "class", "order", "parent", "slot").agg(*(F.sum(c).alias(c) for c in ("pages", "plain", "links", "chars")), F.max("heading").alias("heading"), F.min("homes").alias("homes")), "fits")

    fits = found.where("class IS NOT NULL").groupBy("host", "class").agg(F.sum("pages").alias("total"), F.max(F.when((F.col("order") != 0) & (F.col("parent") != 0), F.col("pages"))).alias("agree"))
    valid = classes.join(fits.where(F.col("agree") >= MIN_AGREE * F.col("total")).select("host", "class"), ["host", "class"], "left_semi")
    slots = found.where("slot IS NOT NULL")
    main = slots.groupBy("host").agg(F.max(F.struct("plain", "slot", "homes")).alias("m")).where("m.plain > 0").select("host", F.posexplode("m.homes").alias("pos", "home"))
    # Of containers around the main slot the outermost that is marked as an article, else the innermost.
    rank = F.struct(F.when(F.col("home.article"), 0).otherwise(1), F.when(F.col("home.article"), -F.col("pos")).otherwise(F.col("pos")))
    homes = main.withColumn("box", F.col("home.token")).join(valid.where("tag").select("host", F.col("token").alias("box")), ["host", "box"])
    boxes = homes.groupBy("host").agg(F.min_by("box", rank).alias("box"))
    inside = slots.join(boxes, "host").where(F.exists("homes", lambda x: x["token"] == F.col("box")) | F.col("heading")).where(F.col("links") <= MOST_LINKS * F.col("chars"))
    kept = inside.select("host", F.col("slot").alias("token"), F.lit(True).alias("kept"))
    fixed = valid.join(boxes, "host", "left_semi").where("NOT tag").select("host", "token", F.lit(True).alias("fixed"))
    known = classes.join(boxes, "host", "left_semi").select("host", "token").unionByName(kept.select("host", "token")).distinct()
    marked = known.join(fixed, ["host", "token"], "left").join(kept, ["host", "token"], "left")
    return marked.select("host", "token", F.coalesce("fixed", F.lit(False)).alias("fixed"), F.coalesce("kept", F.lit(False)).alias("kept"))


def article_text(page: Page, token: list[int], fixed: list[bool], kept: list[bool]) -> str:
    """The article's slots of a page that follows a template, joined by blank lines; of a page that has no such text, the article by its own tree."""
    known = set(token)
    text = {t for t, x in zip(token, fixed, strict=True) if x}
    slots = {t for t, x in zip(token, kept, strict=True) if x}
    found = [b.text for slot, b, _ in slots_of(page, known) if slot in slots and not b.inside.furniture and page.tokens[b.at] not in text]
    return "\n\n".join(found) if found else _own_text(page)


def extract_pages(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html", support: float = MIN_SUPPORT, least: int = MIN_PAGES) -> DataFrame:
    """(key, url, text, n_chars) of each page: its main text and the number of its code points.

    A null or empty page has an empty text; pages without a host share the host "". Broken markup is read as far as it goes.
    Hosts of fewer than `least` pages or without a template, and pages that don't follow their host's, are read by their own
    tree. A page takes time in proportion to its length, however deep it is. Repeated rows get equal texts, rows of one key
    are rows of their own; other columns are ignored, whatever their names. An empty table gives no rows.
    """
    rows = _page_rows(pages, key, url, page)
    classes = written(classes_of(rows, support, least), "classes")
    template = written(templates(rows, classes), "template")

    def run(batches: Iterator[pa.RecordBatch], of_host) -> Iterator[pa.RecordBatch]:
        for piece in _pieces(batches):
            texts = [article_text(parse(h), *of_host(piece, i)) for i, h in enumerate(piece.column("html").to_pylist())]
            yield pa.RecordBatch.from_arrays([piece.column("key"), piece.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["key", "url", "text", "n_chars"])

    return _with_host(rows, template, ("token", "fixed", "kept"), run, f"key {dict(rows.dtypes)['key']}, url string, text string, n_chars long")
