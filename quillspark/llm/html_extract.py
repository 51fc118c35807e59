"""Operator 8: main text of HTML pages, with site templates removed.

First pass: each page is read into a light element tree; every block element's subtree outside the article, and every container (not a
paragraph) inside it, is hashed from its tag, text and children, whatever its tag or class says. Spark counts each host's distinct pages with each hash. A subtree is a template
if it recurs on enough of them (`pages_needed`: all of three, six of nine, 20 of 100, 2,000 of a million, so that the share falls as a host grows and notices that rotate are
found too). Copies of one page count once, so that copied pages aren't taken for templates. Second pass: templates are deleted; what they leave is read by structural rules as a
fallback, for what occurs on few pages: elements that by tag, role or class are menus, headers, footers, sidebars, notices, adverts, forms, scripts or comments are
dropped; the text blocks that remain are the result. Only pages on which a template survives the structural rules are shuffled to meet their hashes.

If a page has `article` elements, only their text counts; else `main`; else the body. Paragraphs of an article are never templates,
as passages may recur in many articles.

Reading takes time in proportion to a page's length, however deeply its elements are nested or left open.

Defined cases: null html is an empty page with text ''; cut-off pages and unclosed tags are read as far as they go; a null URL has the host ''; repeated rows
each give a row; an empty table gives no rows. After a tag whose quoted value never ends, tags of that page end at their first `>`. Only the id, URL and html columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bloom_filter, bloom_words, materialise, maybe_in, pieces, release
from .url_filter import host_and_path

#: The rest of a start tag after its name; quoted values may hold `>`.
_REST = re.compile(r"""((?>[^>"']+|"[^"]*"|'[^']*')*+)>""")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTR = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_SPACE = re.compile(r"[ \t\n\x0b\x0c\r]+")
_WORD = re.compile(r"[a-z0-9]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption option head".split()
)
PARAGRAPH = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre td th tr tbody thead table dd dt dl ol ul figcaption figure article main body html address".split())
DROPPED = frozenset(
    "head nav aside footer header form button select datalist dialog menu search object svg math canvas audio video map applet "
    "script style textarea title noscript iframe template xmp noembed noframes input label fieldset".split()
)
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog status menu menubar toolbar".split())
#: Words of a class or id that mark what isn't main text.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices "
    "popup modal overlay newsletter subscribe subscription sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs footer masthead comment comments "
    "commentlist reply replies disqus discussion related recommended recommendations share sharing social toolbar widget widgets pagination pager login signup".split()
)
HEADERS = frozenset(("header", "site-header", "page-header", "siteheader", "pageheader", "top-header"))
#: An open element of the key closes when one of these starts.
ENDS_ITEMS = frozenset("ul ol dl table tbody thead div article body select".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
_NO_P = BLOCK - {"html", "body", "head", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "legend", "summary", "center"}


def _marked(tag: str, attrs: str) -> bool:
    """Whether an element's attributes say that it isn't main text."""
    for name, value in _ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "role" and value in ROLES:
            return True
        if name in ("class", "id") and tag not in ("body", "html", "article", "main"):
            if not HEADERS.isdisjoint(value.split()) or not MARKS.isdisjoint(_WORD.findall(value)):
                return True
        elif name in ("class", "id") and tag == "article" and not {"comment", "comments", "reply"}.isdisjoint(_WORD.findall(value)):
            return True
    return False


class Element:
    """An open or closed element; `block` is the nearest open block element at or above it, `items` the list items, cells and so on that a new one would close."""

    __slots__ = ("tag", "up", "depth", "dropped", "inside", "header", "parts", "digest", "block", "items")

    def __init__(self, tag: str, up: Element | None, dropped: bool, inside, header: bool):
        self.tag, self.up, self.dropped, self.inside, self.header, self.parts, self.digest = tag, up, dropped, inside, header, [], None
        self.depth = up.depth + 1 if up else 0
        self.block = self if up is None or tag in BLOCK else up.block
        self.items = {} if up is None or tag in ENDS_ITEMS else {**up.items, tag: self} if tag in CLOSED_BY else up.items


def tags_and_text(html: str):
    """(text, tag, attributes) in page order: tag is None for text, attributes None for an end tag. Comments, declarations and raw elements are left out."""
    at, quoted = 0, True
    while True:
        lt = html.find("<", at)
        if lt < 0:
            yield html[at:], None, None
            return
        c = html[lt + 1 : lt + 2]
        if not (c in ("/", "!", "?") or c.isascii() and c.isalpha()):
            yield html[at : lt + 1], None, None
            at = lt + 1
            continue
        if lt > at:
            yield html[at:lt], None, None
        if html.startswith("<!--", lt):
            at = html.find("-->", lt + 4) + 3
            if at < 3:
                return
            continue
        name = _NAME.match(html, lt + 2 if c == "/" else lt + 1)
        m = _REST.match(html, name.end()) if quoted and name and c != "/" else None
        quoted = quoted and (m is not None or not name or c == "/")
        end = m.end() - 1 if m else html.find(">", lt)
        if end < 0:
            return
        at = end + 1
        if name is None or name.end() > end:
            continue
        tag, attrs = name[0].lower(), html[name.end() : end]
        if c == "/":
            yield None, tag, None
        elif tag in RAW and not attrs.endswith("/"):
            stop = re.compile("</" + tag, re.I).search(html, at)
            if stop is None:
                return
            at = html.find(">", stop.end()) + 1
            if at < 1:
                return
        else:
            yield None, tag, attrs


def read_page(html: str):
    """(blocks, elements, places): blocks (text, kind, element) in page order, the hashed elements, which of article and main there are."""
    import xxhash

    root = Element("", None, False, False, False)
    top, blocks, hashed, places = root, [], [], set()
    buffer: list[str] = []
    opened: dict[str, int] = {}

    def flush() -> None:
        if buffer:
            text = _SPACE.sub(" ", unescape("".join(buffer))).strip(" ")
            buffer.clear()
            if text:
                blocks.append((text, 0 if top.dropped else 2 if top.inside == "article" else 1 if top.inside == "main" else 3, top))
                top.parts.append(text)

    def close() -> None:
        nonlocal top
        if top.tag in BLOCK:
            flush()
        e, top = top, top.up
        opened[e.tag] -= 1
        if e.parts:
            digest = xxhash.xxh64_intdigest("\x00".join((e.tag, *e.parts))) - (1 << 63)
            top.parts.append(str(digest))
            if e.tag in BLOCK and e.tag not in ("html", "body", "article", "main", "head") and not (e.inside and e.tag in PARAGRAPH):
                e.digest = digest
                hashed.append(e)

    def close_to(e: Element) -> None:
        while top.depth >= e.depth:
            close()

    for text, tag, attrs in tags_and_text(html):
        if tag is None:
            buffer.append(text)
            continue
        if tag == "br":
            buffer.append(" ")
            continue
        if attrs is None:
            if tag in BLOCK:
                flush()
            if tag not in VOID and opened.get(tag):
                while top.tag != tag:
                    close()
                close()
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        if tag in BLOCK:
            flush()
            if tag in _NO_P and top.block.tag == "p":
                close_to(top.block)
            ended = [e for t, e in top.items.items() if tag in CLOSED_BY[t]]
            if ended:
                close_to(max(ended, key=lambda e: e.depth))
        header = top.header or (tag == "header" and bool(top.inside))
        dropped = top.dropped or (tag in DROPPED and not (tag == "header" and top.inside)) or (bool(attrs.strip()) and _marked(tag, attrs))
        inside = top.inside
        if tag == "article" and not dropped:
            inside = "article"
        elif tag == "main" and not inside and not dropped:
            inside = "main"
        places.add(inside)
        if header and not dropped and tag in HEADING:
            header = False
        if not attrs.endswith("/") or tag in BLOCK:
            top = Element(tag, top, dropped or (header and tag not in ("header", "hgroup", "div", "section")), inside, header)
            opened[tag] = opened.get(tag, 0) + 1
    flush()
    while top is not root:
        close()
    return blocks, hashed, places


def main_text(html: str, templates=frozenset()) -> str:
    """The page's main text without the subtrees whose hashes are in `templates`."""
    blocks, _, places = read_page(html)
    wanted = 2 if "article" in places else 1 if "main" in places else 3
    known: dict[int, bool] = {}

    def deleted(e: Element) -> bool:
        way = []
        while e is not None and id(e) not in known:
            way.append(e)
            e = e.up
        gone = e is not None and known[id(e)]
        for e in reversed(way):
            gone = known[id(e)] = gone or e.digest in templates
        return gone

    return "\n".join(text for text, kind, e in blocks if kind == wanted and not (templates and deleted(e)))


def pages_needed(host_pages):
    """On how many distinct pages of a host a subtree must recur to be a template: three at least, then twice the square root of all."""
    return F.greatest(F.lit(3), F.least(host_pages, F.ceil(F.sqrt(host_pages) * 2)))


def page_subtrees(pages: DataFrame) -> DataFrame:
    """(id, host, page, subtree, survives) for the distinct subtrees of each page; `page` is a hash of all its text."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash

        for b in pieces(batches):
            rows = []
            for i, host, html in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                blocks, hashed, _ = read_page(html or "")
                page = xxhash.xxh64_intdigest("\n".join(x[0] for x in blocks).encode("utf-8", "surrogatepass")) - (1 << 63)
                seen: dict[int, bool] = {}
                for e in hashed:
                    seen[e.digest] = seen.get(e.digest, False) or not e.dropped
                rows += [(i, host, page, d, s) for d, s in seen.items()]
            if rows:
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_()]
                names = ["id", "host", "page", "subtree", "survives"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return pages.select("id", "host", "html").mapInArrow(run, "id long, host string, page long, subtree long, survives boolean")


def templates_of(found: DataFrame) -> DataFrame:
    """Distinct (host, subtree) of the templates, from rows(host, page, subtree)."""
    sizes = found.select("host", "page").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("host_pages"))
    times = found.select("host", "subtree", "page").distinct().groupBy("host", "subtree").agg(F.count(F.lit(1)).alias("times"))
    return times.where("times > 2").join(sizes, "host").where(F.col("times") >= pages_needed(F.col("host_pages"))).select("host", "subtree")


def extract_main_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of `df`: `id_col`, `url_col`, text, n_chars."""
    raw = df.select(F.col(id_col).alias("id"), F.col(url_col).alias("_url"), F.col(html_col).alias("html"))
    pages = raw.withColumn("host", host_and_path(F.col("_url"))[0])
    found = materialise(page_subtrees(pages), "subtrees")
    hit = found.where("survives").join(templates_of(found), ["host", "subtree"]).groupBy("id").agg(F.collect_set("subtree").alias("templates"))
    hit = materialise(hit, "templates")
    release(found)

    words = bloom_words(hit.count())
    h = F.xxhash64(F.col("id").cast("bigint"))
    marked = maybe_in(pages.select("id", "_url", "html"), h, bloom_filter(hit.select("id"), h, words), words, "_hit")
    rest = marked.where("_hit").join(hit.hint("merge"), "id", "left").select("id", "_url", "html", "templates")
    plain = marked.where("not _hit").select("id", "_url", "html", F.lit(None).cast("array<bigint>").alias("templates"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in pieces(batches):
            text = [main_text(html or "", frozenset(t or ())) for html, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(pa.int64()), b.column(1), pa.array(text, pa.string()), pa.array(list(map(len, text)), pa.int64())], names=[id_col, url_col, "text", "n_chars"]
            )

    return plain.unionByName(rest).mapInArrow(run, f"{id_col} long, {url_col} string, text string, n_chars long")
