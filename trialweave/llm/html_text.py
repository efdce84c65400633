"""Main text of web pages, with site templates found by hashing element subtrees and counting them per host.

A page is walked once as a stream of tags, with a stack of open elements.  Text of the article counts (of the whole body where a page has
neither ``article`` nor ``main``), without elements that aren't content by their tag or by a word of their class, id or role that names a part of another kind.  Every block's
subtree has a hash of its tag, classes, text and its children's hashes, bottom up, and open elements are counted by tag, so a walk is linear in the page whatever its nesting and its faults; a subtree that recurs on at least ``share`` of the pages of a host, of a layout of the host or of a section of it, and on ``least``
of these pages, is part of that part's template and goes from its pages.  A layout is the set of a page's containers (tag and class, digits aside), a section the first folder
of the address; paragraphs and headings by themselves count for the whole host only, as a common line of articles may be on half of the pages of a small part.  Pages of a part with the same main text count once, so copies of an article don't make it a template.

Spark counts (host, part, subtree) pre-aggregated; the templates of a part are fewer than its blocks per page / ``share``, so they fit in a row.  They are staged and joined by
host and part: broadcast when their file is small, else a sort-merge join whose skewed hosts Spark splits.

Defined cases: null or empty html, or a page without text, gives an empty text; html of any length is one row, walked whole; a null or odd url has the host ''; an unclosed element ends
with its parent or the page, and a menu, header, sidebar, footer or form without an end also where the first article begins; an article within one that has an end isn't content; repeated rows count as one page; a subtree on exactly ``share`` of the pages (a tie) is a template; ids may be of any type and null; an empty table gives an
empty result; columns beside id, url and html aren't read, whatever their names.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialweave.llm.text import numbered
from trialweave.plans.staging import staged

SHARE = 0.5
LEAST = 5

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"<]*"|'[^'<]*'|[^>"'])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
#: Fixed lists: elements by their part in a page.
_RAW = {"script", "style", "title", "textarea", "noscript", "iframe", "template", "xmp", "noembed", "noframes"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_NEVER = {"head", "nav", "footer", "aside", "form", "menu", "dialog", "svg", "math", "canvas", "object", "select", "button", "video", "audio", "fieldset", "map"}
_INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "ruby", "rb", "rt",
    "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img",
}
#: Elements of running text, which don't tell layouts apart.
_PROSE = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "dl", "dt", "dd", "blockquote", "pre", "figure", "figcaption", "table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup", *_INLINE}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Words of a class, id or role that name a part which isn't the article: menus, sidebars, notices, adverts, forms, reader comments, wherever it stands.
_NOT_CONTENT = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|sidebar|nav|navbar|navigation|menu\w*|breadcrumbs?|pagination|cookies?|consent|gdpr|notice|notices|"
    r"comments?|commentlist|respond|disqus|newsletter|subscribe|signup|site-?header|site-?footer)(?:$|[\s_-])"
)
#: Words that only say so around the article; within it such a block stays unless it is part of a template.
_AROUND = re.compile(
    r"(?:^|[\s_-])(?:banner|side|nav\w*|pager|popup|modal|overlay|discussion|share|sharing|social|related|recommended|login|search|toolbar|masthead|footer|copyright|widget)(?:$|[\s_-])"
)
_CLASS = re.compile(r"""(?<![\w-])class\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "form"}
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
#: Elements whose opening ends an open one of the set.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements that an article ends if they are never ended themselves.
_LEFT_OPEN = re.compile(r"<(/?)(head|nav|header|aside|footer|form)(?=[\s/>])", re.I)
_CLOSES_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "figure", "footer", "form", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul", *_HEADINGS}


def _not_content(tag: str, attributes: str, inside: int) -> bool:
    if tag in _NEVER:
        return True
    if not attributes:
        return False
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
            return True
        if name == "role" and value in _ROLES:
            return True
        if name in ("class", "id") and tag not in ("html", "body", "article", "main") and (_NOT_CONTENT.search(value) or (not inside and _AROUND.search(value))):
            return True
        if name == "class" and tag == "article" and "comment" in value:
            return True
    return False


def _container(tag: str, attributes: str) -> str:
    found = _CLASS.search(attributes) if attributes else None
    return " ".join([tag, *sorted({re.sub(r"\d+", "", c) for c in found[1].strip("\"'").split()})]) if found else tag


def _unclosed(source: str) -> set[int]:
    """Where the elements begin that could swallow an article and have no end."""
    open_: dict[str, list[int]] = {}
    for m in _LEFT_OPEN.finditer(source):
        held = open_.setdefault(m[2].lower(), [])
        if not m[1]:
            held.append(m.start())
        elif held:
            held.pop()
    return {at for held in open_.values() for at in held}


class Page:
    """One walk over a page; ``templates`` are hashes of subtrees to leave out."""

    __slots__ = ("blocks", "containers", "main", "other", "subtrees")

    def __init__(self, source: str, templates: frozenset[int] | set[int] = frozenset()) -> None:
        self.main: list[str] = []  # pieces inside article or main
        self.other: list[str] = []
        self.subtrees: set[int] = set()
        self.blocks: set[int] = set()  # those that aren't a paragraph or heading
        self.containers: set[str] = set()
        # An open element: tag, its hash so far, pieces so far in main and other, whether it isn't content.
        stack: list[tuple[str, xxhash.xxh64, int, int, bool]] = []
        open_: Counter[str] = Counter()  # open elements by tag
        outer: list[int] = []  # places in the stack of those that aren't inline
        bads: list[int] = []  # and of those that aren't content
        inside = headings = 0
        begun = False
        loose: list[int] = []  # and of those that are never ended
        unclosed = _unclosed(source)
        at = 0

        def shut(n: int) -> None:
            nonlocal inside, headings
            while len(stack) > n:
                tag, hashed, m, o, bad = stack.pop()
                if stack and not bad:
                    stack[-1][1].update(b"\x02" + hashed.digest())
                open_[tag] -= 1
                inside -= tag in ("article", "main")
                headings -= tag in _HEADINGS
                if bad:
                    bads.pop()
                if tag in _INLINE:
                    continue
                outer.pop()
                if loose and loose[-1] == len(stack):
                    loose.pop()
                if not bads and not bad:
                    self.main.append(" ")
                    self.other.append(" ")
                    if tag not in ("html", "body", "article", "main") and (len(self.main) > m + 1 or len(self.other) > o + 1):
                        h = hashed.intdigest() - (1 << 63)
                        self.subtrees.add(h)
                        if tag != "p" and tag not in _HEADINGS:
                            self.blocks.add(h)
                        if h in templates:
                            self.main[m:] = [" "]
                            self.other[o:] = [" "]

        def text(lo: int, hi: int) -> None:
            if not bads and hi > lo:
                piece = source[lo:hi]
                if open_["header"] and not (inside and headings):
                    return
                if "&" in piece:
                    piece = entities.unescape(piece)
                (self.main if inside else self.other).append(piece)
                if stack and (plain := " ".join(piece.split())):
                    stack[-1][1].update(b"\x01" + plain.encode("utf-8", "surrogatepass"))

        last = source.rfind(">") + 1  # every tag before it has an end, so no search goes over the same place twice
        while found := _TOKEN.search(source, at, last):
            text(at, found.start())
            at = found.end()
            tag = found[2] or found[5]
            if not tag:
                if found[0].startswith("<!--") and not found[0].endswith("-->"):
                    at = len(source)
                continue
            tag = tag.lower()
            attributes = found[3] if found[2] else found[6]
            if found[1] or found[4]:
                if open_[tag]:
                    k = len(stack) - 1
                    while stack[k][0] != tag:
                        k -= 1
                    shut(k)
                elif tag == "p":
                    self.main.append(" ")
                    self.other.append(" ")
                continue
            if tag in _RAW:
                end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(source, at)
                at = end.end() if end else len(source)
                continue
            if tag not in _INLINE:
                self.main.append(" ")
                self.other.append(" ")
            if tag in _CLOSES_P or tag in _ENDS:
                ends = {"p"} if tag in _CLOSES_P else _ENDS[tag]
                for k in reversed(outer):
                    if stack[k][0] in ends:
                        shut(k)
                        break
                    if stack[k][0] != "p":
                        break
            bad = _not_content(tag, attributes, inside)
            if tag in ("article", "main", "body") and not bad and not begun and loose:
                shut(loose[0])  # a menu or notice before the article that is never ended doesn't swallow it
            if tag in _VOID or attributes.endswith("/") and tag not in ("p", "div", "span", "a"):
                continue
            kind = _container(tag, attributes)
            if tag not in _PROSE:
                self.containers.add(kind)
            if tag not in _INLINE:
                outer.append(len(stack))
            if bad:
                bads.append(len(stack))
            if found.start() in unclosed:
                loose.append(len(stack))
            stack.append((tag, xxhash.xxh64(kind.encode("utf-8", "surrogatepass")), len(self.main), len(self.other), bad))
            open_[tag] += 1
            inside += tag in ("article", "main")
            headings += tag in _HEADINGS
            begun = begun or (tag in ("article", "main") and not bads)
        tail = source.find("<!", at)
        text(at, len(source) if tail < 0 else tail)
        shut(0)

    @property
    def text(self) -> str:
        """Blocks joined by one space, white space within them one space."""
        main = " ".join("".join(self.main).split())
        return main or " ".join("".join(self.other).split())

    @property
    def layout(self) -> int:
        return xxhash.xxh64_intdigest("\n".join(sorted(self.containers)).encode("utf-8", "surrogatepass")) - (1 << 63)


def page_text(source: str | None, templates: frozenset[int] | set[int] = frozenset()) -> str:
    return Page(source, templates).text if source else ""


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        content, layouts, subtrees, blocks = [], [], [], []
        for source in b.column(2):
            page = Page(source.as_py() or "")
            content.append(xxhash.xxh64_intdigest(page.text.encode("utf-8", "surrogatepass")) - (1 << 63))
            layouts.append(page.layout)
            subtrees.append(list(page.subtrees))
            blocks.append(list(page.blocks))
        columns = [pa.array(layouts, pa.int64()), pa.array(content, pa.int64()), *[pa.array(x, pa.list_(pa.int64())) for x in (subtrees, blocks)]]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns], names=["host", "section", "layout", "content", "subtrees", "blocks"])


def _layouts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        layouts = pa.array([str(Page(source.as_py() or "").layout) for source in b.column(2)], pa.string())
        yield pa.RecordBatch.from_arrays([*b.columns, layouts], names=[*b.schema.names, "layout"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = [page_text(source.as_py(), {t for part in found for t in part.as_py() or ()}) for source, *found in zip(*b.columns[2:], strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], names=["id", "url", "text"])


def host(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def section(url):
    """The first folder of an address; '' for pages at the root."""
    return F.coalesce(F.regexp_extract(url, r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*/([^/?#]+)/", 1), F.lit(""))


#: The parts of a host whose templates are counted: all of it, its sections, its layouts.
_PARTS = ("host", "section", "layout")


def site_templates(pages: DataFrame, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """host, section, html -> host, part, value, templates: hashes of the subtrees that recur on the pages of a part."""
    walked = pages.mapInArrow(_subtrees, "host string, section string, layout long, content long, subtrees array<long>, blocks array<long>")
    rows = staged(walked, "subtrees")
    parts = F.array(*[F.struct(F.lit(p).alias("part"), F.lit("").alias("value") if p == "host" else F.col(p).cast("string").alias("value"), F.col("subtrees" if p == "host" else "blocks").alias("subtrees")) for p in _PARTS])
    dealt = rows.select("host", "content", F.explode(parts).alias("p")).select("host", "p.*", "content")
    by = ["host", "part", "value"]
    totals = dealt.groupBy(*by).agg(F.count_distinct("content").alias("pages"))
    counts = dealt.select(*by, "content", F.explode("subtrees").alias("subtree")).groupBy(*by, "subtree").agg(F.count_distinct("content").alias("n")).filter(F.col("n") >= least)
    often = counts.join(totals, by).filter(F.col("n") >= share * F.col("pages"))
    return often.groupBy(*by).agg(F.collect_list("subtree").alias("templates"))


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", share: float = SHARE, least: int = LEAST) -> DataFrame:
    """For each page the id, the url and ``text``."""
    named, (page, address, source), _ = numbered(pages, (), id_col, url_col, html_col)
    url = F.col(address).cast("string")
    rows = named.select(F.col(page).alias("id"), url.alias("url"), F.col(source).cast("string").alias("html"), host(url).alias("host"), section(url).alias("section"))
    found = staged(site_templates(rows.select("host", "section", "html"), share, least), "templates")
    kind = named.schema[page].dataType.simpleString()
    joined = rows.mapInArrow(_layouts, f"id {kind}, url string, html string, host string, section string, layout string")
    for part in _PARTS:
        by = ["host"] if part == "host" else ["host", part]
        mine = found.filter(F.col("part") == part).select("host", *[F.col("value").alias(c) for c in by[1:]], F.col("templates").alias(f"of_{part}"))
        joined = joined.join(mine, by, "left")
    out = joined.select("id", "url", "html", *[f"of_{part}" for part in _PARTS]).mapInArrow(_texts, f"id {kind}, url string, text string")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text")


def digest(texts: DataFrame) -> DataFrame:
    return texts.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
