"""Main text of web pages by composite text density."""

from __future__ import annotations

import math
import re
from collections import defaultdict
from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import struct, text_batches

# HTML element lists.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template svg math iframe object canvas textarea select title".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that end an open paragraph, item or cell of the kinds on the right, as browsers do.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("html body table ul ol dl td th div section article aside nav header footer main form blockquote".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PROSE = HEADINGS | frozenset("p pre blockquote li dt dd td th caption figcaption".split())
DROP = frozenset("nav header footer aside button menu dialog head".split())
#: Words in class, id or role that speak for side matter; how much of the page's text a node holds can speak against it.
MARKS = frozenset(
    "ad ads advert advertisement adverts sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs header masthead footer "
    "sidebar aside widget related recommended share sharing social comment comments disqus respond replies reply discussion cookie cookies consent notice "
    "notices alert gdpr newsletter subscribe signup login popup modal overlay toolbar pagination pager tags copyright legal disclaimer search contentinfo complementary banner".split()
)
#: Those that count for an article element, whose classes often list its subjects.
COMMENTS = frozenset("comment comments disqus reply replies".split())
#: Those that may as well name a part of an article.
PARTS = frozenset("related recommended header banner discussion respond notice notices alert tags copyright legal disclaimer search".split())
SURE, MAYBE, THREAD = 1, 2, 3  # what Node.mark says: side matter by its words, maybe a part of the article, readers' comments
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)", re.S)
#: A tag with an open quote: it ends at the next angle bracket, whatever the quotes say.
LOOSE = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)")
ATTR = re.compile(r"(?:^|[\s\"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
WORD = re.compile(r"[a-z]+")
RESULT = struct("text string, n_chars long")


class Node:
    __slots__ = ("tag", "parent", "items", "drop", "chars", "tags", "link_chars", "link_tags", "sum", "density", "mark", "held")

    def __init__(self, tag: str, parent: Node | None, drop: bool = False, mark: int = 0):
        self.tag, self.parent, self.drop, self.mark = tag, parent, drop or mark > 0, mark
        self.items: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.sum = self.density = 0.0
        self.held = False


def _dropped(tag: str, attrs: str) -> tuple[bool, int]:
    """Whether an element is no text of the page in any case, and what its words say of it."""
    if tag in DROP:
        return True, 0
    mark = SURE if tag == "form" else 0
    if not attrs or tag in ("html", "body", "main"):
        return False, mark
    marks, found = MARKS if tag != "article" else COMMENTS, set()
    for name, value in ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
            return True, 0
        if name in ("class", "id", "role") and tag not in HEADINGS:
            found.update(w for w in WORD.findall(value) if w in marks)
    if found & COMMENTS:
        return False, THREAD
    return False, mark or (0 if not found else MAYBE if found <= PARTS else SURE)


def judge(root: Node) -> None:
    """Keep marked nodes that hold most of the page's text outside links, but for readers' comments.

    Beside an article element that holds a quarter of as much they stay side matter.
    """
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [c for c in node.items if not isinstance(c, str) and (not c.drop or c.mark)]
    if not any(n.mark for n in order):
        return
    plain: dict[int, int] = {}
    for node in reversed(order):
        plain[id(node)] = 0 if node.tag == "a" else sum(len(c.strip()) if isinstance(c, str) else plain.get(id(c), 0) for c in node.items)
    article = max((plain[id(n)] for n in order if n.tag in ("article", "main") and not n.drop), default=0)
    for node in order:
        if node.mark in (SURE, MAYBE) and 2 * plain[id(node)] > plain[id(root)] and plain[id(node)] > 4 * article:
            node.drop = False


def restore(article: Node) -> None:
    """Keep parts inside the article whose words may be its own, unless they are mostly links."""
    stack = [article]
    while stack:
        for c in stack.pop().items:
            if isinstance(c, str):
                continue
            if c.drop and c.mark == MAYBE:
                chars, links = _text_and_links(c)
                c.drop = 2 * links > chars
            if not c.drop:
                stack.append(c)


def _text_and_links(node: Node) -> tuple[int, int]:
    chars = links = 0
    stack = [(node, False)]
    while stack:
        x, link = stack.pop()
        link = link or x.tag == "a"
        for c in x.items:
            if isinstance(c, str):
                chars += len(c.strip())
                links += len(c.strip()) if link else 0
            elif not c.drop:
                stack.append((c, link))
    return chars, links


class Open:
    """The open elements by name, in all and since the last one that bounds its parts, so that no end tag has to look for what is not there."""

    def __init__(self, root: Node):
        self.node, self.all = root, defaultdict(int)
        self.scopes = [defaultdict(int)]
        self.bounds = [root.tag]

    def push(self, node: Node) -> None:
        self.all[node.tag] += 1
        self.scopes[-1][node.tag] += 1
        if node.tag in SCOPE:
            self.scopes.append(defaultdict(int))
            self.bounds.append(node.tag)
        self.node = node

    def pop(self) -> Node:
        node = self.node
        if node.tag in SCOPE:
            self.scopes.pop()
            self.bounds.pop()
        self.scopes[-1][node.tag] -= 1
        self.all[node.tag] -= 1
        self.node = node.parent
        return node

    def end(self, tag: str) -> bool:
        """Close the nearest open element of a name; an inline one only inside its block."""
        if not (self.all if tag in BLOCK else self.scopes[-1])[tag]:
            return False
        while self.pop().tag != tag:
            pass
        return True

    def end_near(self, tags: tuple[str, ...]) -> None:
        """Close the nearest open element of these kinds, if it is inside the block at hand."""
        here = self.scopes[-1]
        if self.bounds[-1] in tags or any(here[t] for t in tags):
            while self.pop().tag not in tags:
                pass


def parse(html: str) -> Node:
    """A tree of elements and text; script-like elements are skipped, missing end tags are supplied.

    An end tag closes the nearest open element of its name, up to the block around it; other end
    tags count for nothing. A block start ends an open paragraph. A page that breaks off ends
    there. From a tag on whose quotes do not close, quotes count for nothing. The time is
    proportional to the page, whatever it holds.
    """
    root = Node("#root", None)
    here, at, end, token = Open(root), 0, len(html), TOKEN
    text_at = 0
    while at < end:
        start = html.find("<", at)
        m = token.match(html, start) if start >= 0 else None
        if start >= 0 and m is None:
            if html[start + 1 : start + 2].isalpha() or html[start + 1 : start + 2] == "/":
                token = LOOSE
                m = token.match(html, start)
            elif token is LOOSE:
                m = TOKEN.match(html, start)
            if m is None:
                at = start + 1
                continue
        text = html[text_at : start if m else end]
        if text:
            here.node.items.append(unescape(text))
        if m is None:
            break
        at = text_at = m.end()
        slash, tag, attrs = m.groups()
        if tag is None:
            if m[0].startswith("<![CDATA["):
                here.node.items.append(m[0][9:].removesuffix("]]>"))
            continue
        tag = tag.lower()
        if slash:
            if not here.end(tag) and tag in ("p", "br"):
                here.node.items.append(Node(tag, here.node))
            continue
        if tag in RAW:
            if not attrs.rstrip().endswith("/"):
                close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(html, at)
                at = text_at = close.end() if close else end
            continue
        if tag in BLOCK:
            if tag not in ("li", "td", "th", "tr") or here.node.tag == "p":
                here.end_near(("p",))
            if tag in CLOSES:
                here.end_near(CLOSES[tag])
        node = here.node
        child = Node(tag, node, *_dropped(tag, attrs))
        if tag in ("article", "main") and not child.drop:
            up = node  # what holds the article is no side matter, whatever its class says
            while up is not None and up.tag not in DROP and up.tag != "article" and not up.held:
                up.drop, up.held = False, True
                up = up.parent
        node.items.append(child)
        if tag not in VOID and not attrs.endswith("/"):
            here.push(child)
    else:
        if text_at < end:
            here.node.items.append(unescape(html[text_at:]))
    return root


def weigh(root: Node) -> tuple[float, Node]:
    """Set counts, densities and density sums bottom-up; dropped subtrees count for nothing.

    Composite density of a node: C/T times the logarithm of (C/LC)(T/LT) to the base
    ln(C LC / (C - LC) + C_body LC_body / C_body + e): C characters, T tags, L those in links.
    """
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [c for c in node.items if not isinstance(c, str) and not c.drop]
    for node in reversed(order):
        link = node.tag == "a"
        for c in node.items:
            if isinstance(c, str):
                node.chars += len(c.strip())
            elif not c.drop:
                node.chars += c.chars
                node.tags += c.tags + 1
                node.link_chars += c.link_chars
                node.link_tags += c.link_tags + (c.tag == "a")
        if link:
            node.link_chars = node.chars
    body = next((n for n in order if n.tag == "body"), root)
    share = body.link_chars / max(1, body.chars)
    for node in reversed(order):
        c, t, lc, lt = node.chars, max(1, node.tags), node.link_chars, max(1, node.link_tags)
        if c:
            base = math.log(c * lc / max(1, c - lc) + share * c + math.e)
            inside = (c / max(1, lc)) * (t / lt)
            node.density = c / t * math.log(max(1.0, inside)) / math.log(max(base, 1.0001)) if inside > 0 else 0.0
        node.sum = sum(k.density for k in node.items if not isinstance(k, str) and not k.drop)
    return body.density, body


def main_node(root: Node) -> Node:
    """The subtree of the article; what is beside it in there is dropped.

    The body's maximum density sum leads to the paragraphs' parent. An ``article`` or ``main``
    element on or over it is the article. Else the threshold is the least density on the path
    below the body. Of what stands beside the path prose stays if its density reaches the threshold or
    its links are few, a bare block if it is as dense as the densest node of the path; of what
    stands below the node, lists and boxes of links go.
    """
    _, body = weigh(root)
    best, stack = body, [body]
    while stack:
        node = stack.pop()
        if node.sum > best.sum:
            best = node
        stack += [c for c in node.items if not isinstance(c, str) and not c.drop]
    path = [best]
    while path[-1] is not body and path[-1].parent is not None:
        path.append(path[-1].parent)
    for node in path:
        if node.tag in ("article", "main"):
            restore(node)
            return node
    if best is not body:
        restore(best)
    below = [n.density for n in path[:-1] or path]
    threshold, on = min(below), set(map(id, path))
    for node in path[1:]:
        _beside(node, on, threshold, max(below))
    stack = [best]
    while stack:
        for c in stack.pop().items:
            if not isinstance(c, str) and not c.drop:
                c.drop = c.density < threshold and c.tag in BLOCK and c.tag not in PROSE and 2 * c.link_chars > c.chars
                stack.append(c)
    return path[-1]


def _beside(node: Node, path: set[int], threshold: float, most: float) -> None:
    """Drop the blocks beside the path that are no part of the article, and headings right before them."""
    kept = True
    for c in reversed(node.items):
        if isinstance(c, str) or c.drop or c.tag not in BLOCK:
            continue
        if id(c) in path:
            kept = True
        elif c.tag in HEADINGS:
            c.drop = not kept
        elif c.chars:
            prose = _prose(c)
            kept = c.density >= (threshold if prose else most) and 2 * c.link_chars <= c.chars or prose and 4 * c.link_chars < c.chars
            c.drop = not kept


def _prose(node: Node) -> bool:
    stack = [node]
    while stack:
        x = stack.pop()
        if x.tag in PROSE:
            return True
        stack += [c for c in x.items if not isinstance(c, str) and not c.drop]
    return False


def blocks(node: Node) -> list[str]:
    """Text of the blocks below a node in page order, white space inside made one space."""
    out: list[str] = []
    part: list[str] = []

    def flush() -> None:
        text = " ".join("".join(part).split())
        part.clear()
        if text:
            out.append(text)

    stack: list[Node | str | None] = [node]
    while stack:
        x = stack.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            part.append(x)
        elif x.drop and x is not node:
            if x.tag in BLOCK:
                flush()
        elif x.tag == "br":
            part.append(" ")
        else:
            block = x.tag in BLOCK
            if block:
                flush()
                stack.append(None)
            stack.extend(reversed(x.items))
    flush()
    return out


def extract(html: str | None) -> str:
    """Main text of a page: its blocks joined by newlines, empty for null, empty and text-free pages."""
    if not html:
        return ""
    root = parse(html)
    judge(root)
    text = "\n".join(blocks(main_node(root)))
    if not text:  # all of it stands in something that its class marks as side matter
        stack = [root]
        while stack:
            node = stack.pop()
            node.drop = node.tag in DROP
            node.chars = node.tags = node.link_chars = node.link_tags = 0
            stack += [c for c in node.items if not isinstance(c, str)]
        text = "\n".join(blocks(main_node(root)))
    return text


@F.pandas_udf(RESULT)
def _extract(pages: pd.Series) -> pd.DataFrame:
    texts = [extract(x) for x in pages]
    return pd.DataFrame({"text": texts, "n_chars": [len(x) for x in texts]})


def extract_text(df: DataFrame, html: str | Column = "html", out: str = "main") -> DataFrame:
    """Add a struct column ``out`` (text, n_chars) with the main text of a column of whole pages.

    Row by row, without a shuffle; memory for one page's tree at a time. A column of the name
    ``out`` is replaced; equal pages give equal texts.
    """
    text_batches(df.sparkSession)
    return df.withColumn(out, _extract(F.col(html) if isinstance(html, str) else html))
