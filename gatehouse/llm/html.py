"""Main text of web pages: site template removal by counted subtree hashes."""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Container, Iterable, Iterator, Sequence
from html import unescape

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import boxed, materialise, name

#: A subtree is template if it recurs on so many pages of its host or section, and on this share of them.
LEAST_PAGES, LEAST_SHARE = 8, 0.05
#: Of a host or section of few pages: on so many of them, and on this share.
FEW_PAGES, MOST_SHARE = 3, 0.6
#: Share of all pages from which a subtree of several hosts is template everywhere, whatever their number.
LEAST_SHARE_OF_ALL = 0.002
#: Leading directories of a page's path, each of which names a section.
SECTIONS = 2
#: Elements of HTML whose text is never shown as text of the page.
NO_TEXT = frozenset("head title script style noscript template iframe svg canvas object button select textarea option".split())
#: Elements of HTML that stand beside the main text.
LANDMARKS = frozenset("nav header footer aside form dialog menu".split())
#: Elements of HTML without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements of HTML that stand within a line.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
#: Elements whose text ends at their end tag only.
RAW = frozenset("script style textarea title noscript iframe xmp".split())
#: Elements that hold the main text, if a page has one.
CONTENT = frozenset(("article", "main"))
#: Tokens of class, id or role, each as a whole, that mark what stands beside the main text.
MARKS = frozenset("ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices popup promo promoted related replies reply respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split())
#: Texts of an article stand in these; marks on them say nothing, and in an article they are never template, however often they recur.
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PROSE = frozenset("article main h1 h2 h3 h4 h5 h6 p blockquote pre li dd dt figcaption td th tr tbody thead".split()) | INLINE
#: A start tag of a block closes an open p.
_CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: Start tag -> open elements that it closes, up to one of the bounds.
_CLOSES = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",))}
_P_BOUNDS = ("button", "td", "th", "article", "section", "div", "li", "body", "blockquote", "main")

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>=]*(?:=\s*(?:"[^"]*(?:"|\Z)|'[^']*(?:'|\Z))?[^>=]*)*)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
#: Stands for the page's own host in what is hashed, so that "(c) this.site" recurs on every site.
_OWN_HOST = "\x01"


class Element:
    """An element of a page: tag, mark, children in order, subtree hash, whether it holds an article and a heading, and how much text."""

    __slots__ = ("children", "content", "hash", "heading", "marked", "size", "tag")

    def __init__(self, tag: str, marked: bool = False):
        self.tag, self.marked = tag, marked
        self.children: list[Element | str] = []
        self.hash, self.size, self.content, self.heading = 0, 0, tag in CONTENT, tag in HEADINGS

    def close(self, host: str) -> None:
        """Hash the subtree, whose children are closed: the tag and, in order, texts without outer white space and the children's hashes."""
        parts = [self.tag]
        for child in self.children:
            if isinstance(child, str):
                if text := " ".join(child.split()):
                    parts.append(text.replace(host, _OWN_HOST) if host else text)
                    self.size += len(text)
            else:
                self.content, self.heading = self.content or child.content, self.heading or child.heading
                self.size += child.size
                if child.hash:
                    parts.append(f"<{child.hash:x}>")
        if self.tag in NO_TEXT:
            self.size = 0
        # 0: no text in it. Signed, as Spark's longs are.
        self.hash = xxhash.xxh64_intdigest("\x00".join(parts).encode("utf-8", "surrogatepass")) - (1 << 63) if len(parts) > 1 else 0

    def beside(self, page: Element, inside: bool) -> bool:
        """Whether its tag or marks say that it stands beside the main text; ``inside``: of an article.

        Nothing that holds an article does, nor, on a page without one, what
        holds most of the text. The header of an article that has a heading is the article's own.
        """
        if self.content or not (self.tag in LANDMARKS or self.marked and self.tag not in PROSE):
            return False
        if self.tag == "header" and inside and self.heading:
            return False
        return page.content or 2 * self.size <= page.size


class _Open:
    """The open elements of a page, and how many there are of each tag, so that no end tag searches in vain."""

    def __init__(self, host: str):
        self.stack, self.of, self.host = [Element("#root")], Counter(), host

    def push(self, element: Element) -> None:
        self.stack.append(element)
        self.of[element.tag] += 1

    def cut(self, depth: int) -> None:
        while len(self.stack) > depth:
            element = self.stack.pop()
            self.of[element.tag] -= 1
            element.close(self.host)

    def close_nearest(self, tags: tuple[str, ...], bounds: tuple[str, ...]) -> None:
        if any(self.of[t] for t in tags):
            for depth in range(len(self.stack) - 1, 0, -1):
                if self.stack[depth].tag in tags:
                    return self.cut(depth)
                if self.stack[depth].tag in bounds:
                    return None
        return None

    def end(self, tag: str) -> None:
        if self.of[tag]:
            depth = len(self.stack) - 1
            # Inline elements don't end the block around them.
            while self.stack[depth].tag != tag and (tag not in INLINE or self.stack[depth].tag in INLINE):
                depth -= 1
            if self.stack[depth].tag == tag:
                self.cut(depth)


def parse(html: str | None, host: str = "") -> Element:
    """A lenient tree of any depth: unclosed elements end with their parent or where HTML says; comments go."""
    open_, at, html = _Open(host), 0, html or ""
    stack, end = open_.stack, len(html)
    while at < end:
        m = _TOKEN.search(html, at)
        if m is None:
            stack[-1].children.append(html[at:])
            break
        if m.start() > at:
            stack[-1].children.append(html[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            open_.end(tag)
            continue
        if tag in _CLOSES_P:
            open_.close_nearest(("p",), _P_BOUNDS)
        elif tag in _CLOSES:
            open_.close_nearest(*_CLOSES[tag])
        element = Element(tag, _marked(m[3]))
        stack[-1].children.append(element)
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
            element.children.append(html[at : close.start() if close else end])
            element.close(host)
            at = close.end() if close else end
        elif tag not in VOID and not m[3].endswith("/"):
            open_.push(element)
    root = stack[0]
    open_.cut(0)
    return root


def _marked(attributes: str) -> bool:
    return "=" in attributes and any(MARKS.intersection((m[2] or m[3] or m[4] or "").lower().split()) for m in _ATTRIBUTE.finditer(attributes))


def _may_be_template(e: Element, inside: bool) -> bool:
    return e.hash != 0 and not e.content and not (inside and e.tag in PROSE)


def subtrees(root: Element) -> set[int]:
    """Hashes of the subtrees that may be template: all with text, but in an article no prose."""
    found: set[int] = set()
    todo = [(root, False)]
    while todo:
        e, inside = todo.pop()
        inside = inside or e.tag in CONTENT
        if e.tag in NO_TEXT:
            continue
        if _may_be_template(e, inside):
            found.add(e.hash)
        todo += [(c, inside) for c in e.children if not isinstance(c, str)]
    return found


def main_hash(root: Element) -> int:
    """Hash of what the page's main text stands in: tells copies of a page from other pages."""
    while root.content and root.tag not in CONTENT:
        root = next(c for c in root.children if not isinstance(c, str) and c.content)
    return root.hash


def blocks(root: Element, templates: Sequence[Container[int]] = (), landmarks: bool = True) -> list[str]:
    """Texts of the blocks that remain, in page order, without templates; ``landmarks``: and without what tags and marks put beside the main text."""
    out: list[str] = []
    line: list[str] = []

    def flush() -> None:
        if text := " ".join(unescape("".join(line)).split()):
            out.append(text)
        line.clear()

    # What is still to do, last first; None ends a block.
    todo: list[tuple[Element | str | None, bool]] = [(root, False)]
    while todo:
        e, inside = todo.pop()
        if e is None:
            flush()
        elif isinstance(e, str):
            line.append(e)
        elif e.tag == "br":
            line.append(" ")
        elif e.tag not in NO_TEXT:
            inside = inside or e.tag in CONTENT
            if any(e.hash in t for t in templates) and _may_be_template(e, inside):
                continue
            if landmarks and e.beside(root, inside):
                continue
            if e.tag not in INLINE:
                flush()
                todo.append((None, inside))
            todo += [(c, inside) for c in reversed(e.children)]
    return out


class _Sorted:
    """A set of 64-bit hashes in 8 bytes each."""

    def __init__(self, hashes: Iterable[int]):
        self.hashes = array("q", hashes)
        # In place: sorted() would make an object of each.
        np.frombuffer(self.hashes, np.int64).sort()

    def __contains__(self, x: int) -> bool:
        at = bisect_left(self.hashes, x)
        return at < len(self.hashes) and self.hashes[at] == x


#: Stands for the page itself among the hashes of its subtrees, none of which is 0.
_PAGE = 0


def _subtree_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        sites, trees, pages, hosts = [], [], [], []
        for keys, html, host in zip(batch["sites"], batch["html"], batch["host"], strict=True):
            root = parse(html, host)
            found, page = [_PAGE, *subtrees(root)], main_hash(root)
            for site in keys:
                sites += [site] * len(found)
                trees += found
                pages += [page] * len(found)
                hosts += [xxhash.xxh64_intdigest(host) - (1 << 63)] * len(found)
        yield pd.DataFrame({"site": pd.Series(sites, dtype=object), "tree": pd.Series(trees, dtype="int64"), "page": pd.Series(pages, dtype="int64"), "on": pd.Series(hosts, dtype="int64")})


def subtree_counts(pages: DataFrame, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(site, tree, n, several) from (sites array<string>, html, host): on how many pages of the site a subtree recurs.

    Pages with the same main text count once, so copies of a page neither make
    its parts template nor hide the template of others. several: whether it
    occurs on more than one host. Tree 0 stands for the pages themselves.
    """
    rows = pages.select("sites", "html", "host").mapInPandas(_subtree_rows, "site string, tree long, page long, on long")
    of_page = rows.groupBy("site", "tree", "page").agg(F.min("on").alias("first"), F.max("on").alias("last"))
    counted = of_page.groupBy("site", "tree").agg(F.count("*").alias("n"), (F.min("first") != F.max("last")).alias("several"))
    return counted.where((F.col("n") >= min(FEW_PAGES, least_pages)) | (F.col("tree") == _PAGE))


def extract_text(pages: DataFrame, *, url: str = "url", html: str = "html", least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE, least_share_of_all: float = LEAST_SHARE_OF_ALL, landmarks: bool = True) -> DataFrame:
    """Add ``text`` (main text, blocks joined by an empty line) and ``n_chars`` (its code points).

    1. Subtrees of elements are hashed, with the page's own host masked, and
       counted in Spark by host, by section (the first directory of the path,
       and the first two), and over all hosts.
    2. A subtree is template of a host or section if it stands on at least
       ``least_pages`` different pages and ``least_share`` of its different
       pages, or on FEW_PAGES and MOST_SHARE of them. Hosts of fewer pages show
       no template by themselves, so subtrees on several hosts and
       ``least_share_of_all`` of all pages are template
       everywhere. Templates go, prose inside an article or main excepted.
    3. What is left and marked as navigation, notice, advert, form or comment,
       by its tag or by a whole token of its class, id or role, is a page's own
       and goes as well (``landmarks``; see `Element.beside` for what such marks
       never take). All other text stays, in an article or not.

    A null html gives an empty text; a null url counts as a host of its own.
    Elements may be nested to any depth. Repeated rows stay; columns ``text``
    and ``n_chars`` are replaced, all others are kept. The empty table gives
    the empty table.

    Templates of sites are written first, so that their size is known when they
    are joined: if it is under the session's broadcast threshold no page is
    shuffled, otherwise Spark sorts both sides and splits hot hosts. Those of
    all hosts are at most (subtrees of a page) / ``least_share_of_all``, however
    many pages there are; they are broadcast as sorted numbers of 8 bytes.
    """
    spark = pages.sparkSession
    link = name(url)
    address = F.when(F.instr(link, "://") > 0, link.substr(F.instr(link, "://") + 3, F.length(link))).otherwise("")
    address = F.coalesce(address, F.lit(""))
    host = F.lower(F.regexp_extract(address, r"^[^/?#]*", 0))
    path = F.split(F.regexp_extract(address, r"^[^/?#]*(/[^?#]*)?", 1), "/")
    # What stands before the last slash, without the empty string before the first.
    depth = F.greatest(F.lit(0), F.least(F.lit(SECTIONS), F.size(path) - 2))
    own = F.transform(F.sequence(F.lit(0), depth), lambda d: F.concat(F.lit("/"), F.concat_ws("/", F.array(host), F.slice(path, F.lit(2), d))))
    # The empty string stands for all hosts; the others begin with a slash.
    keyed = boxed(pages.drop("text", "n_chars"), html=name(html), host=host, sites=F.concat(F.array(F.lit("")), own))
    # Written, as it is read twice and pages should be parsed once.
    counts = materialise(subtree_counts(keyed, least_pages))
    of_site = counts.where(F.col("tree") == _PAGE).select("site", F.col("n").alias("pages"))
    often = counts.where(F.col("tree") != _PAGE).join(of_site, "site")
    of_all = often.where("site = '' AND several").where((F.col("n") >= least_pages) & (F.col("n") >= F.col("pages") * least_share_of_all))
    everywhere = spark.sparkContext.broadcast(_Sorted(r[0] for r in of_all.select("tree").toLocalIterator()))
    recurs = (F.col("n") >= least_pages) & (F.col("n") >= F.col("pages") * least_share) | (F.col("n") >= min(FEW_PAGES, least_pages)) & (F.col("n") >= F.col("pages") * MOST_SHARE)
    templates = materialise(often.where(F.col("site") != "").where(recurs).groupBy("site").agg(F.collect_list("tree").alias("template")))

    @F.pandas_udf("string")
    def text(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for htmls, hosts, known in batches:
            out = []
            for h, host, t in zip(htmls, hosts, known, strict=True):
                out.append("\n\n".join(blocks(parse(h, host), (everywhere.value, set(t.tolist())), landmarks)))
            yield pd.Series(out, dtype=object)

    joined, found = keyed, []
    for d in range(SECTIONS + 1):
        known = templates.toDF(f"at{d}", f"template{d}")
        joined = joined.withColumn(f"site{d}", F.get("sites", F.lit(d + 1))).join(known, F.col(f"site{d}") == F.col(f"at{d}"), "left")
        found.append(F.coalesce(f"template{d}", F.array().cast("array<long>")))
    out = joined.select("row.*", text("html", "host", F.concat(*found)).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
