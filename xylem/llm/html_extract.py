"""Operator 6: the main text of web pages by tree scoring.

The page becomes a tree (void elements, implied ends of paragraphs and list items, stray end tags). Each paragraph of at least ``LEAST_CHARS``
characters earns points: one, one more for each comma, and one for each 100 characters, three at most. They go in full to its parent,
in half to its grandparent, and divided by three times the level to the ancestors above, ``LEVELS`` in all. Text that stands in a ``div``, ``section``, ``article`` or ``main``
itself, between its blocks, is a paragraph too, whose parent that element is. A container starts with points for its tag, and for words in its
class and id. Its score is discounted by its link density, the share of its characters inside links. The container with the best score and those of its siblings that
score well enough, or are paragraphs that read like text, are kept; their text is given line by line. In a page none of whose paragraphs is so long,
paragraphs of any length count, and text in ``body`` or outside all tags.

A page takes time in proportion to its length, however broken its markup is: nothing is scanned again for each open element or each tag.
A tag whose quotes are never closed ends with its first ``>``, and from there on quotes in tags don't count; what follows the last ``>`` is text.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick

LEAST_CHARS, LEVELS = 25, 5
#: A sibling is kept from this share of the best score on, and from this score on.
SIBLING_SHARE, SIBLING_LEAST = 0.2, 10.0

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("script style noscript template iframe object svg head select button textarea".split())
BLOCK = frozenset("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody td tfoot th thead tr ul".split())
PARAGRAPH = frozenset(("p", "pre", "td", "blockquote", "li", "dd"))
#: Elements whose own text, outside the blocks in them, is a paragraph in them; the latter only where there are no long paragraphs.
HOLDS_TEXT, HOLDS_SHORT_TEXT = frozenset(("div", "section", "article", "main")), frozenset(("div", "section", "article", "main", "body", "center", "html"))
TAG_POINTS = {"article": 10, "main": 10, "div": 5, "section": 3, "pre": 3, "td": 3, "blockquote": 3, "address": -3, "ol": -3, "ul": -3, "dl": -3, "dd": -3, "dt": -3, "li": -3, "form": -3, "nav": -25, "footer": -25, "aside": -15, "header": -10, "h1": -5, "h2": -5, "h3": -5, "h4": -5, "h5": -5, "h6": -5, "th": -5}
#: An end tag is implied by these starts while the element is the innermost of its kind.
CLOSES = {"li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "tr": frozenset(("tr", "td", "th")), "td": frozenset(("td", "th")), "th": frozenset(("td", "th")), "option": frozenset(("option",))}
SCOPE = frozenset("ul ol dl table body html article section div td th".split())
_BARRIER = SCOPE - {"td", "th"}
_ITEM = _BARRIER | frozenset().union(*CLOSES.values())
_GOOD = re.compile(r"article|body|content|entry|main|page|post|text|blog|story", re.I)
_BAD = re.compile(r"\bads?\b|banner|combx|comment|contact|foot|masthead|meta|nav|promo|related|scroll|share|shoutbox|sidebar|sponsor|social|tags|widget|menu", re.I)
_OTHER = r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>?"
_TOKEN = re.compile(_OTHER + r"""|</?([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|[^<]++|<""", re.S)
_UNQUOTED = re.compile(_OTHER + r"|</?([a-zA-Z][^\s/>]*+)([^>]*+)>|[^<]++|<", re.S)
_LETTER = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
_NAMED = re.compile(r"""\b(?:class|id)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "parent", "children", "points", "names", "chars", "commas", "linked", "own", "candidate", "paragraph", "item")

    def __init__(self, tag: str, parent: Node | None, names: str = ""):
        self.tag, self.parent, self.names = tag, parent, names
        self.children: list = []
        self.points = 0.0
        #: Characters and commas in all, characters in links, and (characters, commas) outside the blocks in it.
        self.chars = self.commas = self.linked = 0
        self.own = (0, 0)
        self.candidate = False
        #: The open paragraph that a block closes here, and the innermost element that may end an implied end's search.
        self.paragraph = self if tag == "p" else None if parent is None or tag in SCOPE else parent.paragraph
        self.item = self if parent is None or tag in _ITEM else parent.item


def parse(page: str) -> tuple[Node, str | None]:
    """The tree of a page and its title. Texts in it have entities resolved."""
    root = node = Node("html", None)
    open_tags = Counter(("html",))
    title, at, n, last = None, 0, len(page), page.rfind(">")
    match = _TOKEN.match

    def leave(to: Node) -> Node:
        """Close what is open below ``to``."""
        x = node
        while x is not to:
            open_tags[x.tag] -= 1
            x = x.parent
        return to

    while at < n:
        if at > last:  # no tag ends any more
            node.children.append(entities.unescape(page[at:]))
            break
        m = match(page, at)
        token, tag = m.group(), m.group(1)
        if token == "<" and match is _TOKEN.match and page[at + 1 : at + 3].lstrip("/")[:1] in _LETTER:
            match = _UNQUOTED.match  # a tag with an open quote, or one that ends nowhere
            continue
        at = m.end()
        if tag is None:
            if token[0] != "<" or token == "<":
                node.children.append(entities.unescape(token))
            elif token.startswith("<![CDATA["):
                node.children.append(token[9:-3] if token.endswith("]]>") else token[9:])
            continue
        tag = tag.lower()
        if token[1] == "/":
            if tag == "p":
                seek = node.paragraph
            elif open_tags[tag]:
                seek = node
                while seek.tag != tag:
                    seek = seek.parent
            else:
                seek = None
            if seek is not None and seek.parent is not None:
                node = leave(seek.parent)
            continue
        if tag in ("script", "style", "textarea", "title", "noscript", "iframe", "template"):
            end = re.compile(rf"</{tag}\s*+>", re.I).search(page, at)
            if tag == "title" and title is None:
                title = _SPACE.sub(" ", entities.unescape(page[at : end.start() if end else n])).strip()
            at = end.end() if end else n
            continue
        if tag == "html":
            continue
        if tag in BLOCK and node.paragraph is not None:
            node = leave(node.paragraph.parent)
        if tag in CLOSES:
            seek = node.item
            while seek.tag not in _BARRIER and seek.tag not in CLOSES[tag] and seek.parent is not None:
                seek = seek.parent.item
            if seek.tag in CLOSES[tag] and seek.parent is not None:
                while seek.tag in CLOSES[tag] and seek.parent is not None:
                    seek = seek.parent
                node = leave(seek)
        names = " ".join("".join(x) for x in _NAMED.findall(m.group(2))) if m.group(2) else ""
        child = Node(tag, node, names)
        node.children.append(child)
        if tag not in VOID and not (m.group(2) or "").rstrip().endswith("/"):
            node = child
            open_tags[tag] += 1
    return root, title or None


def _walk(root: Node) -> list[Node]:
    """All nodes but dropped ones, each before its children."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if node.tag in DROPPED:
            continue
        out.append(node)
        stack += [c for c in reversed(node.children) if isinstance(c, Node)]
    return out


def _text(node: Node) -> list[str]:
    """The lines of a node's text."""
    lines, words, stack = [], [], [node]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            words.append(x)
        elif x is None or x.tag in ("br", "hr"):
            line = _SPACE.sub(" ", "".join(words)).strip()
            if line:
                lines.append(line)
            words = []
        elif x.tag not in DROPPED:
            block = x.tag in BLOCK
            if block:
                stack.append(None)
            stack += reversed(x.children)
            if block:
                stack.append(None)
    line = _SPACE.sub(" ", "".join(words)).strip()
    return [*lines, line] if line else lines


def start_points(node: Node) -> float:
    points = float(TAG_POINTS.get(node.tag, 0))
    if node.names:
        points += 25 * bool(_GOOD.search(node.names)) - 25 * bool(_BAD.search(node.names))
    return points


def _measure(nodes: list[Node]) -> None:
    """Each node's characters, commas and linked characters, from its children's; white space around a piece of text doesn't count."""
    for node in reversed(nodes):
        own = commas = 0
        for c in node.children:
            if isinstance(c, str):
                text = _SPACE.sub(" ", c).strip()
                k = text.count(",")
                node.chars, node.commas, own, commas = node.chars + len(text), node.commas + k, own + len(text), commas + k
            elif c.tag not in DROPPED:
                node.chars += c.chars
                node.commas += c.commas
                node.linked += c.chars if c.tag == "a" else c.linked
                if c.tag not in BLOCK:
                    own, commas = own + c.own[0], commas + c.own[1]
        node.own = (own, commas)


def score(root: Node) -> list[Node]:
    """Give every container its points and characters; the candidates, in document order."""
    nodes = _walk(root)
    _measure(nodes)
    for least, holders in ((LEAST_CHARS, HOLDS_TEXT), (1, HOLDS_SHORT_TEXT)):
        for node in nodes:
            if node.tag in PARAGRAPH:
                chars, commas, up = node.chars, node.commas, node.parent
            elif node.tag in holders:
                (chars, commas), up = node.own, node
            else:
                continue
            if chars < least:
                continue
            points, level = 1 + commas + min(chars // 100, 3), 0
            while up is not None and level < LEVELS:
                if not up.candidate:
                    up.candidate = True
                    up.points += start_points(up)
                up.points += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
                up, level = up.parent, level + 1
        if found := [x for x in nodes if x.candidate]:
            return found
    return []


def final(node: Node) -> float:
    return node.points * (1 - density(node))


def density(node: Node) -> float:
    return node.linked / node.chars if node.chars else 0.0


def extract(page: str | None) -> tuple[str | None, str, float, str | None, float]:
    """(title, text, score, tag of the best container, its link density); a page without text has score 0."""
    if not page:
        return None, "", 0.0, None, 0.0
    root, title = parse(page)
    candidates = score(root)
    if not candidates:
        return title, "", 0.0, None, 0.0
    best = max(candidates, key=final)
    if best.parent is None:
        kept = [best]
    else:
        least, kept = max(SIBLING_LEAST, SIBLING_SHARE * final(best)), []
        for x in best.parent.children:
            if not isinstance(x, Node) or x.tag in DROPPED:
                continue
            if x is best or x.candidate and final(x) + (SIBLING_SHARE * final(best) if x.names and x.names == best.names else 0) >= least:
                kept.append(x)
            elif x.tag == "p":
                text = " ".join(_text(x))
                if len(text) > 80 and density(x) < 0.25 or text and density(x) == 0 and re.search(r"\.( |$)", text):
                    kept.append(x)
    return title, "\n".join(line for x in kept for line in _text(x)), final(best), best.tag, density(best)


_OUT = "page_id long, url string, title string, text string, score double, container string, link_density double"


def _extract(batches):
    for batch in batches:
        done = [extract(x) if x is not None else (None,) * 5 for x in batch.column(2).to_pylist()]
        columns = list(zip(*done)) if done else [()] * 5
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.float64(), pa.string(), pa.float64())))], names=["page_id", "url", "title", "text", "score", "container", "link_density"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, title, text, score, container, link_density), one row for each row of ``pages``, in one pass without a shuffle.

    A null page gives nulls, an empty one an empty text. Ties go to the container that begins first. Null and repeated ids pass through; further
    columns are dropped; an empty table gives an empty result.
    """
    return pick(pages, "page_id", "url", "html").select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(_extract, _OUT)


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
