"""Main text of web pages by removal of site templates.

Each page is parsed to a tree of elements. For every element of its article that can be
boilerplate, the hash of the subtree (name, class, text, children) is emitted; Spark counts on how
many different articles of a site section (host and first part of the path) each hash occurs.
Subtrees that occur on LEAST_ARTICLES or more are the section's template and are deleted, however
large the section or its host is: pages of other sections change nothing.

Deleted besides are elements whose very name says that they are no article text (nav, footer, aside,
form, script, ..., header included), and those named so by class, id or role: `no_text` reads each
name as words, so that post-comments, comment-thread, cookie-banner and site-footer go while
has-comments and content-sidebar stay. html, body, main and article are never deleted for a class, nor
is what stands around the chosen article, nor a div like article-header that holds the article's h1;
an article is not emptied by class words other than those of comments. What remains of the article
element, or of main, or else of the body, is the text.

Pages that copy one article count once, so that copies do not turn their own article into a
template. Inside an article, only containers (div, section, lists, ...) can be deleted as
templates; its paragraphs and headings always stay, however often they recur. A section of fewer than
LEAST_ARTICLES different articles shows no templates; only names and classes speak there.

Pages are parsed twice, once to count and once to extract. Counts are aggregated before they are
shuffled; a page gets back only those of its own subtrees that are templates, by the digest of its
markup, so no list of a whole site is sent with a page.

Edge cases: NULL or empty html gives an empty text. Markup cut off at the end of a page is dropped.
Pages without a url are a section of their own. Pages without an article use main or the body.
Repeated rows are returned as often as they occur. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from marketlake.llm.common import Scratch, materialize, table

#: A template recurs on so many different articles of a section.
LEAST_ARTICLES = 5
#: Host and first part of the path.
SITE = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*(?:/[^/?#]*(?=/))?)"

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']+|\"[^\"]*\"|'[^']*')*+>|[^>]*(?:>|\Z))",
    re.S,
)
ATTRIBUTE = re.compile(r"([A-Za-z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
SPACE = re.compile(r"\s+")
RAW = frozenset("script style textarea title noscript iframe template xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    """a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike
    strong sub sup time tt u var""".split()
)
NO_TEXT = frozenset(
    """head nav header footer aside form script style noscript template iframe svg button select textarea title
    dialog menu object canvas audio video input""".split()
)
#: Words of class, id or role that name something other than article text.
NO_TEXT_WORDS = frozenset(
    """ad ads adv advert adverts advertisement advertising banner cookie cookies consent notice notices gdpr sidebar
    comment comments disqus menu navbar nav navigation breadcrumb breadcrumbs footer header newsletter subscribe
    signup popup modal overlay share sharing social related promo promotion sponsored sponsor widget toolbar search
    login contentinfo complementary""".split()
)
#: Words of these always name reader comments.
COMMENT_WORDS = frozenset("comment comments disqus".split())
#: Endings after which a name still names the same thing (ad-box, comments-list, related-posts).
BOXES = frozenset(
    """box slot unit area list section block container wrap wrapper inner outer item items thread bar panel panels row
    group message messages text form links link buttons button icons media posts articles stories holder region zone
    top bottom left right desktop mobile""".split()
)
#: Words of a name that tells a state or a layout and not what the element is (has-comments, no-sidebar).
STATES = frozenset("has no not with without is enabled disabled open closed count layout content".split())
NAME_PART = re.compile(r"[a-z]+")
HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
#: Elements that hold the article; no class makes them anything else.
HOLDERS = frozenset("html body main article".split())
CONTAINERS = frozenset("div section ul ol dl table figure center details fieldset".split())
#: A start tag of the key closes an open element among these, as browsers do.
CLOSES = {
    "li": ("li",),
    "dt": ("dt", "dd"),
    "dd": ("dt", "dd"),
    "tr": ("tr", "td", "th"),
    "td": ("td", "th"),
    "th": ("td", "th"),
    "option": ("option",),
}
CLOSE_P = frozenset(
    """address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre
    section table ul""".split()
)
#: Elements that end the block before them even where they are deleted.
BREAKS = CLOSE_P | CONTAINERS | frozenset("aside menu dialog".split())


class Element:
    __slots__ = ("name", "label", "hidden", "marked", "parent", "inside", "blocks", "parts")

    def __init__(self, name: str, label: str, hidden: bool, marked: str, parent: Element | None):
        self.name, self.label, self.parent = name, label, parent
        # no text by name or because it is not shown; the word of its class that says so, or ""
        self.hidden, self.marked = hidden, marked
        # article or main that this element is part of
        self.inside = parent is not None and (parent.inside or parent.name in ("article", "main"))
        self.parts: list[str | Element] = []

    @property
    def dropped(self) -> bool:
        return self.hidden or self.marked != ""


def no_text(name: str) -> str:
    """The word by which a name (of a class, id or role) says that an element is no article text, or "".

    A name is its last word, but for endings like -list; words for comments tell at any place.
    """
    parts = NAME_PART.findall(HUMP.sub("-", name).lower())
    if len(parts) > 1:
        if not STATES.isdisjoint(parts):
            return ""
        for part in parts:
            if part in COMMENT_WORDS:
                return part
        while len(parts) > 1 and parts[-1] in BOXES:
            parts.pop()
    return parts[-1] if parts and parts[-1] in NO_TEXT_WORDS else ""


def attributes(text: str) -> tuple[str, bool, str]:
    """The element's label (class, id, role), whether it is not shown, and the word of the label that names no article text."""
    if not text or text.isspace():
        return "", False, ""
    label, hidden, marked = [], False, ""
    for m in ATTRIBUTE.finditer(text):
        key = m.group(1).lower()
        value = m.group(2) or m.group(3) or m.group(4) or ""
        if key in ("class", "id", "role"):
            label.append(value)
            found = {no_text(name) for name in value.split()} - {""}
            # of several, one for comments counts before others
            marked = min(COMMENT_WORDS & found, default="") or marked or min(found, default="")
        elif key == "hidden" or key == "aria-hidden" and value == "true":
            hidden = True
        elif key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            hidden = True
    return " ".join(label), hidden, marked


def parse(html: str) -> Element:
    """The tree of a page; comments and declarations are left out, raw elements stay empty."""
    root = Element("", "", False, "", None)
    at, here = 0, root
    while True:
        m = TAG.search(html, at)
        if m is None:
            here.parts.append(html[at:])
            return root
        if m.start() > at:
            here.parts.append(html[at : m.start()])
        at = m.end()
        if m.group(2) is None:
            continue
        name = m.group(2).lower()
        if m.group(1):
            if name == "p" or name not in VOID:
                up = here
                while up is not root and up.name != name:
                    up = up.parent
                if up is not root:
                    here = up.parent
            continue
        closed = CLOSES.get(name, ())
        if name in CLOSE_P:
            up = here
            while up is not root and up.name in INLINE:
                up = up.parent
            if up.name == "p":
                here = up.parent
        elif closed:
            up = here
            while up is not root and (up.name in INLINE or up.name == "p"):
                up = up.parent
            while up.name in closed:
                up = up.parent
                here = up
        tail = m.group(3).rstrip(">").rstrip("/")
        label, hidden, marked = attributes(tail)
        new = Element(name, label, hidden or name in NO_TEXT, "" if name in HOLDERS else marked, here)
        here.parts.append(new)
        if name == "h1" and new.inside:  # the title of the article: what holds it is not the head of the site
            up = here
            while up.inside:
                if up.marked == "header":
                    up.marked = ""
                up = up.parent
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(html, at)
            at = end.end() if end else len(html)
        elif name not in VOID and not m.group(3).endswith("/>"):
            here = new


def hashes(root: Element) -> dict[Element, int]:
    """The hash of every element's subtree, children before parents."""
    found: dict[Element, int] = {}
    stack: list[tuple[Element, bool]] = [(root, False)]
    while stack:
        x, ready = stack.pop()
        if not ready:
            stack.append((x, True))
            stack.extend((y, False) for y in x.parts if isinstance(y, Element))
            continue
        key = [x.name, x.label]
        for y in x.parts:
            if isinstance(y, Element):
                key.append(f"\x01{found[y]}")
            elif not y.isspace():
                key.append(" ".join(y.split()))
        found[x] = xxh64_intdigest("\x02".join(key).encode("utf-8", "surrogatepass")) - (1 << 63)
    return found


def outermost(root: Element, name: str, within_marked: bool) -> list[Element]:
    """The outermost elements of a name that are shown."""
    found, stack = [], [root]
    while stack:
        x = stack.pop()
        if x.name == name and not x.dropped:
            found.append(x)
        else:
            inner = (y for y in reversed(x.parts) if isinstance(y, Element))
            stack.extend(y for y in inner if not (y.hidden or y.marked in COMMENT_WORDS if within_marked else y.dropped))
    return found


def n_chars(elements: list[Element]) -> int:
    """Length of the text of elements, without what is dropped."""
    total, stack = 0, list(elements)
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            total += len("".join(x.split()))
        elif not x.dropped:
            stack.extend(x.parts)
    return total


def mains(root: Element) -> list[Element]:
    """The outermost article elements; else main; else the whole page.

    If all of them stand within elements that a class word marks as other text, they are the
    article if they hold more text than the rest of the page.
    """
    found = outermost(root, "article", False)
    if not found:
        rest = outermost(root, "main", False) or [root]
        held = outermost(root, "article", True) or outermost(root, "main", True)
        found = held if held and n_chars(held) > n_chars(rest) else rest
    if n_chars(found) == 0:
        for x in inner(found):
            x.marked = x.marked if x.marked in COMMENT_WORDS else ""
    return found


def inner(elements: list[Element]) -> Iterator[Element]:
    """The elements and all those within them."""
    stack = list(elements)
    while stack:
        x = stack.pop()
        yield x
        stack.extend(y for y in x.parts if isinstance(y, Element))


def removable(x: Element) -> bool:
    """Whether an element may be deleted as a template."""
    if x.name in ("", "html", "body", "article", "main"):
        return False
    return x.name in CONTAINERS if x.inside else x.name not in INLINE


def subtrees(html: str) -> tuple[int, list[int]]:
    """Hash of the page's article, and the distinct hashes of its subtrees that a template may delete."""
    root = parse(html)
    chosen = mains(root)
    may_go = [x for x in inner(chosen) if removable(x) and not x.dropped]
    if not may_go:
        return 0, []
    found = hashes(root)
    article = xxh64_intdigest(",".join(str(found[x]) for x in chosen).encode()) - (1 << 63)
    return article, sorted({found[x] for x in may_go})


def main_text(html: str, templates: frozenset[int] = frozenset()) -> str:
    """The text of a page without its host's templates."""
    root = parse(html)
    found = hashes(root) if templates else {}
    blocks: list[list[str]] = [[]]
    # entries: text, an element to enter, or None where a block ends
    stack: list[str | Element | None] = list(reversed(mains(root)))
    while stack:
        x = stack.pop()
        if x is None:
            blocks.append([])
        elif isinstance(x, str):
            blocks[-1].append(x)
        elif x.dropped or templates and removable(x) and found[x] in templates:
            if x.name in BREAKS:  # it stood between two blocks
                blocks.append([])
        elif x.name in INLINE:
            stack.extend(reversed(x.parts))
        else:
            blocks.append([])
            stack.append(None)
            stack.extend(reversed(x.parts))
    texts = (SPACE.sub(" ", unescape("".join(b))).strip() for b in blocks if b)
    return " ".join(t for t in texts if t)


def with_section(pages: DataFrame) -> DataFrame:
    html = F.coalesce("html", F.lit(""))
    section = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), SITE, 1))
    return pages.select("page_id", "url", section.alias("section"), html.alias("html"), F.md5(html).alias("digest"))


def page_subtrees(pages: DataFrame) -> DataFrame:
    """section, digest, article, subtrees of every different page that has subtrees a template may delete."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(s, d, *subtrees(html)) for s, d, html in zip(batch["section"], batch["digest"], batch["html"])]
            yield pd.DataFrame([x for x in out if x[3]], columns=["section", "digest", "article", "subtrees"])

    found = with_section(pages).select("section", "digest", "html")
    return found.mapInPandas(rows, "section string, digest string, article long, subtrees array<long>").distinct()


def site_templates(seen: DataFrame) -> DataFrame:
    """(section, subtree) of subtrees that recur on different articles of a section."""
    return (
        seen.select("section", "article", F.explode("subtrees").alias("subtree"))
        .distinct()
        .groupBy("section", "subtree")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(f"n >= {LEAST_ARTICLES}")
        .select("section", "subtree")
    )


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text of every row."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [
                main_text(html, frozenset(t) if t is not None else frozenset())
                for html, t in zip(batch["html"], batch["templates"])
            ]
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": texts})

    seen = materialize(page_subtrees(pages))
    own = seen.select("section", "digest", F.explode("subtrees").alias("subtree"))
    hits = own.join(site_templates(seen), ["section", "subtree"]).groupBy("section", "digest").agg(
        F.array_sort(F.collect_set("subtree")).alias("templates")
    )
    # written, so that the join below is planned by the measured size of the table
    known = with_section(pages).join(Scratch(pages.sparkSession).keep(hits), ["section", "digest"], "left")
    return known.select("page_id", "url", "html", "templates").mapInPandas(rows, "page_id long, url string, text string")


def query(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
