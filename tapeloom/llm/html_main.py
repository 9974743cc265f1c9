"""Main text of web pages, with the templates of their sites removed.

Every block element outside the article has a subtree hash of its tags and texts. The hashes are counted per host in Spark, one
vote per distinct content (the article, or the page if it has none), so that copies of a page don't make its own text a
template; a subtree that recurs on many of them is template and is deleted, wherever it stands outside an article. Inside
articles (article, main, div of class main) these hashes delete nothing; there, containers (div, section, lists, table,
figure, no text blocks) are counted apart, and those on INNER_SHARE of the host's distinct contents are deleted. From the rest, elements
are left out by tag (scripts, menus, forms, ...) and by whole names of their class and id (adverts, notices, comments, ...), and the main element
is read: all articles, else the main, else the body. Where names would leave nothing of a page that has text, tags alone decide.
Text is cut into blocks at block elements; white space inside a block becomes one space; blocks are joined by an empty line.

Null or empty html gives an empty text. A page without a host has its own empty host. Rows that repeat a page_id are
read one by one; an empty table gives no rows; further columns are not read. Unclosed elements end where their parent does, or before the next of
their kind for p, li and other elements whose end tag may be left out. Every step walks a page once, however deep its
elements stand in each other and however many end tags match none. Where a quote in a tag is not closed, its tag ends at the next ">".
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.base import mapped, stored

# fixed values: HTML element kinds
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noscript iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
DROP = frozenset(
    "script style noscript template iframe object embed svg canvas audio video map head title nav menu header footer aside form button input select textarea label "
    "fieldset dialog noembed noframes".split())
#: Names of class and id that mark what is not the article; parts of longer names don't count.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adbox banner promo promotion sponsor sponsored sidebar menu nav navbar navigation breadcrumb breadcrumbs footer "
    "header cookie cookies consent notice popup modal overlay newsletter subscribe signup share sharing social related recommended comment comments disqus "
    "pagination pager toolbar widget login search skip hidden complementary "
    "site-header site-footer page-footer site-nav main-nav main-menu nav-menu side-bar left-sidebar right-sidebar cookie-banner cookie-notice cookie-consent "
    "ad-banner ad-box ad-container ad-slot share-buttons social-links social-share related-articles related-posts comment-list comment-section comments-area "
    "comments-section newsletter-signup search-form login-form skip-link".split())
#: Elements that end an open one of the same kind.
_ENDS = {"p": BLOCK, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
#: Where the search for an open element of the same kind stops.
_FENCE = frozenset("table ul ol dl select article section div main body html nav aside footer header form td th blockquote".split())
#: Elements whose start may end an open one.
_ENDERS = frozenset().union(*_ENDS.values())
_MARKUP = re.compile(r"<(?=[!?]|/?[a-zA-Z])")
_OTHER = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)", re.S)
_TAG = re.compile(r"</?[a-zA-Z](?:[^>\"']|\"[^\"]*\"|'[^']*')*+>", re.S)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_SPACES = re.compile(r"\s+")

#: Elements that hold the page itself and are never template.
WHOLE = frozenset("html body".split())
#: Elements inside an article that may be template.
CONTAINER = frozenset("div section ul ol dl table figure details".split())

#: A subtree is template if it is on so many distinct pages of a host, and on such a share of them.
LEAST_PAGES, LEAST_SHARE = 5, 0.05
#: The same share for containers inside articles.
INNER_SHARE = 0.5


class Node:
    __slots__ = ("tag", "marks", "parts", "code")

    def __init__(self, tag: str, marks: frozenset = frozenset()):
        self.tag, self.marks, self.parts, self.code = tag, marks, [], 0


def _marks(token: str) -> frozenset:
    found = []
    for name, value in _ATTR.findall(token):
        if name.lower() == "hidden" or name.lower() == "aria-hidden" and "true" in value:
            found.append("hidden")
        else:
            found += value.strip("\"'").lower().split()
    return frozenset(found)


class _Open:
    """The elements that are open, with what is needed to close some without looking at all of them."""

    def __init__(self, root: Node):
        self.nodes, self.count, self.levels = [root], {}, [{}]

    def push(self, node: Node) -> None:
        self.nodes.append(node)
        self.count[node.tag] = self.count.get(node.tag, 0) + 1
        if node.tag in _FENCE:
            self.levels.append({})
        if node.tag in _ENDS:  # a fence belongs to the level that it begins
            self.levels[-1][node.tag] = self.levels[-1].get(node.tag, 0) + 1

    def pop(self) -> Node:
        node = self.nodes.pop()
        self.count[node.tag] -= 1
        if node.tag in _ENDS:
            self.levels[-1][node.tag] -= 1
        if node.tag in _FENCE:
            self.levels.pop()
        return node

    def end(self, tag: str) -> None:
        """Close the innermost element of this tag and all in it, if one is open."""
        if self.count.get(tag):
            while self.pop().tag != tag:
                pass

    def make_room(self, tag: str) -> None:
        """Close the element that the start of this one ends, if there is one within the fence."""
        if tag in _ENDERS and any(n and tag in _ENDS[t] for t, n in self.levels[-1].items()):
            while tag not in _ENDS.get(self.pop().tag, ()):
                pass


def _tokens(page: str):
    """(start, end, token) of every tag, comment and declaration; the caller may send the place to go on from."""
    at, loose = 0, False
    while True:
        m = _MARKUP.search(page, at)
        if m is None:
            return
        start = m.start()
        if page[start + 1] in "!?":
            end = _OTHER.match(page, start).end()
        else:
            tag = None if loose else _TAG.match(page, start)
            if tag is None:  # no end outside of quotes: from here on quotes don't count
                loose, close = True, page.find(">", start)
                if close < 0:
                    return
                end = close + 1
            else:
                end = tag.end()
        at = (yield start, end, page[start:end]) or end


def parse(page: str) -> Node:
    """The element tree; texts are parts that are strings, still with their character references."""
    root = Node("")
    held, at, tokens, go_on = _Open(root), 0, _tokens(page), None
    while True:
        try:
            start, end, token = tokens.send(go_on)
        except StopIteration:
            break
        go_on = None
        if start > at:
            held.nodes[-1].parts.append(page[at:start])
        at = end
        if token[1] in "!?":
            if token.startswith("<![CDATA["):
                held.nodes[-1].parts.append(entities.escape(token[9:].removesuffix("]]>"), quote=False))
            continue
        tag = _NAME.match(token)[1].lower()
        if token[1] == "/":
            held.end(tag)
            continue
        held.make_room(tag)
        node = Node(tag, _marks(token) if " " in token or "\n" in token or "\t" in token else frozenset())
        held.nodes[-1].parts.append(node)
        if tag in RAW and not token.endswith("/>"):
            close = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            node.parts.append(page[at:close.start() if close else len(page)])
            at = go_on = close.end() if close else len(page)
        elif tag not in VOID and not token.endswith("/>"):
            held.push(node)
    if at < len(page):
        held.nodes[-1].parts.append(page[at:])
    return root


def _below(node: Node):
    """All nodes, each before those below it, without recursion."""
    todo = [node]
    while todo:
        here = todo.pop()
        yield here
        todo.extend(p for p in reversed(here.parts) if type(p) is Node)


def subtree_codes(root: Node) -> None:
    """Set ``code`` of every node: a 64-bit hash of its tag and all below it."""
    from xxhash import xxh64_intdigest

    for node in reversed(list(_below(root))):
        inner = "".join(f"\x01{p.code:x}" if type(p) is Node else _SPACES.sub(" ", p).strip() for p in node.parts)
        node.code = xxh64_intdigest(f"{node.tag}\x02{inner}") if inner else 0


def _is_article(node: Node) -> bool:
    return node.tag in ("article", "main") or node.tag == "div" and "main" in node.marks


def _outside(root: Node):
    """Block elements that are no article, hold none and are in none."""
    holds = set()
    for node in reversed(list(_below(root))):
        if _is_article(node) or any(type(p) is Node and id(p) in holds for p in node.parts):
            holds.add(id(node))
    todo = [root]
    while todo:
        node = todo.pop()
        if not _is_article(node):
            if id(node) not in holds and node.tag in BLOCK and node.tag not in WHOLE:
                yield node
            todo.extend(p for p in node.parts if type(p) is Node)


def _articles(root: Node) -> list[Node]:
    """The main elements: all articles, else the main, else the page; some may stand in others."""
    chosen = [n for n in _below(root) if n.tag == "article"]
    return chosen or [n for n in _below(root) if _is_article(n)] or [root]


def _outermost(root: Node) -> tuple[list[Node], list[Node]]:
    """The main elements that stand in no other one: (all, those outside of menus, sidebars, comments and the like)."""
    chosen = {id(n) for n in _articles(root)}
    every, seen, todo = [], [], [(root, False)]
    while todo:
        node, hidden = todo.pop()
        if id(node) in chosen:
            every.append(node)
            if not hidden:
                seen.append(node)
            continue
        hidden = hidden or _dropped(node, False)
        todo.extend((p, hidden) for p in reversed(node.parts) if type(p) is Node)
    return every, seen


def _inside(root: Node):
    """Containers inside the main elements that are no article and hold none; none if the page itself is the main element."""
    for start in _outermost(root)[0]:
        if start is root:
            return
        holds = set()
        for node in reversed(list(_below(start))):
            if _is_article(node) or any(type(p) is Node and id(p) in holds for p in node.parts):
                holds.add(id(node))
            elif node.tag in CONTAINER:
                yield node


def content_key(root: Node) -> int:
    """A hash of what main_text reads, templates included; copies of a page have the same."""
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(",".join(f"{n.code:x}" for n in _articles(root)))


def _dropped(node: Node, in_article: bool, by_name: bool = True) -> bool:
    if node.tag in DROP and not (in_article and node.tag == "header"):
        return True
    return by_name and bool(node.marks & MARKS) and node.tag not in ("body", "html", "article", "main")


def main_text(root: Node, template: frozenset | set = frozenset(), inside: frozenset | set = frozenset()) -> str:
    """The text of the main element; ``template`` has the codes of subtrees to delete outside articles, ``inside`` those inside."""
    every, seen = _outermost(root)
    kept = seen or every[:1]
    gone = {id(n) for n in _outside(root) if n.code and n.code in template} if template else set()
    gone |= {id(n) for n in _inside(root) if n.code and n.code in inside} if inside else set()
    return _text(kept, gone, True) or _text(kept, gone, False)


def _text(kept: list[Node], gone: set[int], by_name: bool) -> str:
    blocks, line = [], []

    def close():
        text = _SPACES.sub(" ", "".join(line)).strip()
        if text:
            blocks.append(text)
        line.clear()

    for start in kept:
        todo = [start]
        while todo:
            part = todo.pop()
            if part is None:
                close()
            elif type(part) is str:
                line.append(entities.unescape(part))
            elif part is not start and (_dropped(part, start.tag == "article", by_name) or id(part) in gone):
                line.append(" ")
            elif part.tag == "br":
                line.append(" ")
            elif part.tag in BLOCK or part is start:
                close()
                todo.append(None)
                todo.extend(reversed(part.parts))
            else:
                todo.extend(reversed(part.parts))
    close()
    return "\n\n".join(blocks)


def host_of(url):
    """Lower-case host of a URL, empty if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def site_templates(pages: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE, inner_share: float = INNER_SHARE) -> DataFrame:
    """(host, inner, code): subtrees outside and inside the article that recur on many distinct pages of their host."""

    def lists(values):
        cuts = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.array([c for v in values for c in v], np.uint64).view(np.int64)))

    def kernel(batch):
        keys, outer, inner = [], [], []
        for page in batch.column(1).to_pylist():
            root = parse(page or "")
            subtree_codes(root)
            keys.append(content_key(root))
            outer.append(list({n.code for n in _outside(root) if n.code} | {0}))  # 0: the page itself
            inner.append(list({n.code for n in _inside(root) if n.code}))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(keys, np.uint64).view(np.int64)), lists(outer), lists(inner)], ["host", "key", "outer", "inner"])

    votes = mapped(pages.select(host_of("url").alias("host"), F.col("html").alias("text")), kernel, "host string, key long, outer array<long>, inner array<long>")
    side = lambda name: F.transform(name, lambda c: F.struct(F.lit(name == "inner").alias("inner"), c.alias("code")))
    # of copies whose rest differs, the union votes once
    votes = votes.select("host", "key", F.explode(F.concat(side("outer"), side("inner"))).alias("x")).select("host", "key", "x.inner", "x.code").distinct()
    counts = stored(votes.groupBy("host", "inner", "code").agg(F.count("*").alias("n")).where(F.col("n") >= least_pages), "subtrees")
    total = counts.where("code = 0").select("host", F.col("n").alias("pages"))
    least = F.when(F.col("inner"), inner_share).otherwise(least_share) * F.col("pages")
    return counts.where("code <> 0").join(total, "host").where(F.col("n") >= least).select("host", "inner", "code")


def extract_pages(pages: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE, inner_share: float = INNER_SHARE) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages`` (page_id, url, html)."""
    codes = lambda inner: F.collect_set(F.when(F.col("inner") == inner, F.col("code"))).alias("inner_codes" if inner else "codes")
    templates = site_templates(pages, least_pages, least_share, inner_share).groupBy(F.col("host").alias("of")).agg(codes(False), codes(True))
    # written, so that its size is known: a small list is broadcast, a large one meets the pages in a join that splits hot hosts
    templates = stored(templates, "templates")
    rows = pages.select("page_id", "html", "url", host_of("url").alias("host")).join(templates, F.col("host") == F.col("of"), "left")

    def kernel(batch):
        out = []
        unsigned = lambda codes: {c & 0xFFFFFFFFFFFFFFFF for c in codes or ()}
        for page, codes, inner in zip(*(batch.column(i).to_pylist() for i in (1, 3, 4)), strict=True):
            root = parse(page or "")
            if codes or inner:
                subtree_codes(root)
            out.append(main_text(root, unsigned(codes), unsigned(inner)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())],
                                         ["page_id", "url", "text", "n_chars"])

    kind = dict(pages.dtypes)["page_id"]
    return mapped(rows.select("page_id", F.col("html").alias("text"), "url", "codes", "inner_codes"), kernel, f"page_id {kind}, url string, text string, n_chars long")
