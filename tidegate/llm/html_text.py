"""Main text of web pages: site templates are removed by counting element subtrees for each host.

Every page is parsed into a tree (with the end tags that HTML leaves out). Each subtree that may belong to the site's
template is hashed over its tags and words; a subtree that recurs on many pages of its host, of different main text,
is deleted. What stays is read from the page's article (else its main element, else its body), without elements that by
tag, role or class are menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles or reader comments.

Inside an explicit article only containers may be templates, not its paragraphs, headings or lists: a passage that many
articles of a host quote stays.

Class names and ids count only as a whole: one with any word that is neither telling nor neutral ("related-work") says
nothing, and inside an article only containers go by them, while paragraphs, headings, tables and quotations do not,
but for adverts. Elements may be nested to any depth.

Cases: null html reads as empty and gives empty text; broken markup is read as far as it goes; null or odd urls share
the host ''; copies of a page count once as evidence for a template; repeated rows each get their text; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import html as _html
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.llm._common import broadcast_if_small, materialize, shared_dir

#: A subtree is a template if it is on so many different pages of its host, and on such a share of them; or on MANY_PAGES, whatever the share.
MIN_PAGES, SHARE, MANY_PAGES = 5, 0.25, 200

# Kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr keygen frame".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template svg math".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr label".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th"), "option": ("option",), "optgroup": ("option", "optgroup"), "body": ("head",)}
SCOPES = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "tbody": ("table",), "tfoot": ("table",), "option": ("select",), "optgroup": ("select",), "body": ()}
DROPPED = frozenset("head nav footer aside form script style noscript template iframe svg math canvas object embed audio video select button input textarea dialog menu map title fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar status".split())
ADVERTS = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promoted promotion".split())
HINTS = ADVERTS | frozenset("banner cookie cookies consent gdpr notice popup modal overlay newsletter subscribe subscription signup login sidebar widget widgets menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar share sharing social related recommended recommendations comment comments disqus respond replies reply pagination pager toolbar skip search searchform alert dialog hidden".split())
NEUTRAL = frozenset("left right top bottom main primary secondary box list bar block wrapper wrap container section area inner outer item items link links site page global content slot unit panel row col column js is has".split())
CONTAINERS = frozenset("div section aside ul ol nav table header footer form figure details dl menu".split())

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*+)>""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
SPACE = re.compile(r"\s+")


class Node:
    """An element: its tag, attributes (as read, unparsed), and children (elements and strings)."""

    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.children = tag, attrs, []


class Open:
    """The stack of open elements, with the places of each tag, so that no lookup walks a deep stack."""

    def __init__(self, root: Node):
        self.stack, self.at, self.blocks = [root], {}, []

    def push(self, node: Node) -> None:
        k = len(self.stack)
        self.stack.append(node)
        self.at.setdefault(node.tag, []).append(k)
        if node.tag not in INLINE:
            self.blocks.append(k)

    def cut(self, k: int) -> None:
        """Close all elements from place k on."""
        while len(self.stack) > k:
            n = len(self.stack) - 1
            self.at[self.stack.pop().tag].pop()
            if self.blocks and self.blocks[-1] == n:
                self.blocks.pop()

    def last(self, *tags: str) -> int:
        """The greatest place of these tags; 0 if none is open."""
        return max((p[-1] for t in tags if (p := self.at.get(t))), default=0)

    def first(self, after: int, *tags: str) -> int:
        """The least place of these tags beyond another; 0 if there is none."""
        found = [p[i] for t in tags if (p := self.at.get(t)) and (i := bisect_right(p, after)) < len(p)]
        return min(found, default=0)


def parse(page: str) -> Node:
    """The tree of a page."""
    root = Node("#root")
    top = Open(root)
    at, n = 0, len(page)
    last = page.rfind(">") + 1
    while at < n:
        m = TOKEN.search(page, at, last) if at < last else None
        text = page[at : m.start() if m else n]
        if text:
            top.stack[-1].children.append(_html.unescape(text) if "&" in text else text)
        if not m:
            break
        at = m.end()
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        if m[1]:
            k = top.last(tag)
            if k:
                top.cut(k)
            elif tag == "br" or tag == "p":
                top.stack[-1].children.append(Node(tag))
            continue
        if tag in CLOSES_P and top.blocks and top.stack[top.blocks[-1]].tag == "p":
            top.cut(top.blocks[-1])
        if tag in ENDS:
            k = top.first(top.last(*SCOPES[tag]), *ENDS[tag])
            if k:
                top.cut(k)
        node = Node(tag, m[3])
        top.stack[-1].children.append(node)
        if tag in VOID:
            continue
        if tag in RAW:
            if m[3].rstrip().endswith("/") and tag in ("svg", "math"):
                continue
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            if end:
                at = end.end()
            elif tag not in ("svg", "math"):
                at = n
            continue
        if m[3].rstrip().endswith("/") and tag not in INLINE and tag not in CLOSES_P and tag not in ("li", "td", "tr", "body", "html"):
            continue
        top.push(node)
    return root


def attributes(node: Node) -> dict[str, str]:
    return {m[1].lower(): _html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(node.attrs)} if node.attrs.strip() else {}


def boilerplate(node: Node, in_article: bool) -> bool:
    """Whether an element is no part of the main text by its tag, role, class or visibility."""
    tag = node.tag
    if tag in DROPPED or tag == "header" and not in_article:
        return True
    if not node.attrs.strip() or tag in ("html", "body", "main"):
        return False
    a = attributes(node)
    if a.get("role", "").lower() in ROLES or "hidden" in a or a.get("aria-hidden", "").lower() == "true":
        return True
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", ""), re.I):
        return True
    telling = hints(a.get("class", "")) | hints(a.get("id", ""))
    # inside an article, a paragraph, heading, table or quotation goes only as an advert
    return bool(telling if not in_article or tag in CONTAINERS else telling & ADVERTS)


def hints(names: str) -> set[str]:
    """Telling words of class names: of each name that has no words but telling and neutral ones."""
    out: set[str] = set()
    for name in names.split():
        words = set(re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower())) - NEUTRAL
        if words <= HINTS:
            out |= words
    return out


def flat(node: Node, out: list[str], gone=frozenset(), in_article: bool = False, keep_all: bool = False) -> None:
    """Text of a tree into ``out``; '\\n' stands between blocks, inline elements join their neighbours. Trees may be of any depth."""
    stack = [(iter(node.children), in_article, True)]
    while stack:
        children, inside, inline = stack[-1]
        c = next(children, None)
        if c is None:
            stack.pop()
            if not inline:
                out.append("\n")
        elif isinstance(c, str):
            out.append(SPACE.sub(" ", c))
        elif c.tag in VOID or c.tag in RAW:
            if c.tag in ("br", "hr"):
                out.append("\n")
        else:
            inline = c.tag in INLINE
            if not inline:
                out.append("\n")
            if keep_all or not (id(c) in gone or boilerplate(c, inside)):
                stack.append((iter(c.children), inside or c.tag in ("article", "main"), inline))
            elif not inline:
                out.append("\n")


def text_of(node: Node, **how) -> str:
    out: list[str] = []
    flat(node, out, **how)
    return " ".join("".join(out).split())


def find(node: Node, tag: str, gone, in_article: bool = False) -> list[Node]:
    """Outermost elements of a tag that are not in boilerplate."""
    out, stack = [], [(iter(node.children), in_article)]
    while stack:
        children, inside = stack[-1]
        c = next(children, None)
        if c is None:
            stack.pop()
        elif isinstance(c, str) or id(c) in gone or c.tag in RAW:
            continue
        elif c.tag == tag and not boilerplate(c, True):
            out.append(c)
        elif not boilerplate(c, inside):
            stack.append((iter(c.children), inside or c.tag in ("article", "main")))
    return out


def subtrees(root: Node) -> list[tuple[Node, int]]:
    """Elements that may be templates, each with the hash of its tag, its words and the hashes of its children."""
    out, stack = [], [(root, iter(root.children), False, [])]
    while stack:
        node, children, inside, parts = stack[-1]
        c = next(children, None)
        if c is None:
            stack.pop()
            inner = "".join(parts)
            h = xxhash.xxh3_64_intdigest(f"{node.tag} {inner}")
            if stack:
                stack[-1][3].append(f"<{node.tag}>{h if inner else ''}</>")
                inside = stack[-1][2]
                if node.tag not in ("html", "body", "article", "main") and node.tag not in INLINE and (not inside or node.tag in CONTAINERS) and inner:
                    out.append((node, h - (1 << 63)))
        elif isinstance(c, str):
            parts.append(" ".join(c.split()))
        elif c.tag in RAW or c.tag in VOID:
            parts.append(f"<{c.tag}>")
        else:
            stack.append((c, iter(c.children), inside or c.tag in ("article", "main"), []))
    return out


def main_text(page: str | None, templates: frozenset[int] = frozenset()) -> str:
    """The main text of a page of a host with these templates."""
    if not page:
        return ""
    root = parse(page)
    gone = {id(n) for n, h in subtrees(root) if h in templates} if templates else frozenset()
    for tag in ("article", "main", "body"):
        found = find(root, tag, gone)
        text = " ".join(filter(None, (text_of(x, gone=gone, in_article=tag != "body") for x in found)))
        if text:
            return text
    return "" if find(root, "body", gone) or find(root, "article", gone) else text_of(root, gone=gone)


def _page_subtrees(page: Column) -> Column:
    """struct<page: hash of the main text, hashes: of its subtrees>."""

    @F.arrow_udf("struct<page:bigint,hashes:array<bigint>>")
    def page_subtrees(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            page, hashes = [], []
            for p in batch.to_pylist():
                page.append(xxhash.xxh3_64_intdigest(main_text(p)) - (1 << 63))
                hashes.append(sorted({h for _, h in subtrees(parse(p or ""))}))
            yield pa.StructArray.from_arrays([pa.array(page, pa.int64()), pa.array(hashes, pa.list_(pa.int64()))], names=["page", "hashes"])

    return page_subtrees(page)


def _extract(page: Column, templates: Column) -> Column:
    @F.arrow_udf("string")
    def extract_main_text(pages: pa.Array, templates: pa.Array) -> pa.Array:
        return pa.array([main_text(p, frozenset(t or ())) for p, t in zip(pages.to_pylist(), templates.to_pylist(), strict=True)], pa.string())

    return extract_main_text(page, templates)


def host(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1), F.lit(""))


def site_templates(pages: DataFrame, url: str = "url", page: str = "html", min_pages: int = MIN_PAGES, share: float = SHARE, many_pages: int = MANY_PAGES) -> DataFrame:
    """(host, templates): hashes of the subtrees that recur on a host. A host has few: each takes up its share of all the subtrees there."""
    rows = materialize(pages.select(host(F.col(url)).alias("host"), _page_subtrees(F.col(page)).alias("s")).select("host", "s.page", "s.hashes"))
    sizes = rows.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("pages")).filter(F.col("pages") >= min_pages)
    seen = rows.select("host", "page", F.explode("hashes").alias("h")).distinct().groupBy("host", "h").agg(F.count("*").alias("n")).filter(F.col("n") >= min_pages)
    many = seen.join(sizes, "host").filter((F.col("n") >= share * F.col("pages")) | (F.col("n") >= many_pages))
    return many.groupBy("host").agg(F.collect_set("h").alias("templates"))


def extract_pages(pages: DataFrame, keep: list[str], url: str = "url", page: str = "html") -> DataFrame:
    """The kept columns of pages with their main text as ``text``."""
    shared_dir(pages.sparkSession)
    templates = materialize(site_templates(pages, url, page)).select(F.col("host").alias("__host"), F.col("templates").alias("__templates"))
    rows = pages.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(keep)], F.col(page).alias("__page"), host(F.col(url)).alias("__host"))
    out = rows.join(broadcast_if_small(templates, 50_000), "__host", "left").withColumn("__text", _extract(F.col("__page"), F.col("__templates")))
    return out.select(*[F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)], F.col("__text").alias("text"))
