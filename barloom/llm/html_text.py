"""Main text of web pages by tree scoring.

The page becomes a tree.  Every paragraph gives points for its length and its commas to its parent,
half to the grandparent, a third to the next, and so on; a container's points are discounted by the
share of its text that stands in links.  The best container and those of its siblings that look like
text are kept, without the parts that are never article text.

Words in a class or id only make an element doubtful, as a sidebar's name may stand on the wrapper of
the whole page.  Doubtful elements are dropped if they hold neither the page's article nor much of its
text; those kept for their amount of text alone give lower points.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.tokens import byte_balanced

SCHEMA = "page_id long, url string, text string, n_chars long"
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?"
    r"|<(?P<raw>script|style|noscript|template|textarea|svg|iframe|title)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|(?P<text>[^<]+|<)",
    re.I | re.S,
)
#: One attribute after the other: a name, and a value if there is one.
_ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_OPEN_END = re.compile(r"<!--(?!.*-->\Z)|<(script|style|noscript|template|textarea|svg|iframe|title)\b(?!.*</\1\s*>\Z)", re.I | re.S)
_SPLIT = re.compile(r"[^a-z0-9]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: An opening tag of a set ends an open element of the same set, but not beyond the nearest element named.
_ENDS = (
    (frozenset({"li"}), frozenset({"ul", "ol", "menu"})),
    (frozenset({"dt", "dd"}), frozenset({"dl"})),
    (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    (frozenset({"tr"}), frozenset({"table"})),
    (frozenset({"option"}), frozenset({"select"})),
)
NEVER = frozenset("head nav footer aside form button select dialog menu object canvas audio video".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert dialog form".split())
WORDS = frozenset(
    "ad ads adsense banner sidebar sidenav menu nav navbar navigation topbar footer disqus notice notices alert consent gdpr promo "
    "promoted promotion related share sharing social subscribe popup modal overlay breadcrumb breadcrumbs widget login signup "
    "pagination pager masthead toolbar copyright discussion replies respond skip".split()
)
STARTS = ("comment", "advert", "sponsor", "cookie", "newsletter", "sidebar")
#: Unwanted only outside an article.
OUTER = frozenset({"header"})
PARAGRAPH = frozenset("p pre blockquote td li dd".split())
SIBLING = 0.2
LINKS = 0.3
#: Points that paragraphs in a doubtful element keep; readers' replies may be far longer than the article.
DOUBT, REPLY = 0.25, 0.1
REPLIES = frozenset("disqus discussion replies respond".split())
#: Ancestors that a paragraph gives points to; further ones would get less than a sixty-fourth of them.
ANCESTORS = 64
#: Shares of the page's paragraph points that keep a doubtful element, and one with an article or main heading inside.
SHARE, NAMED = 0.25, 0.1


class _Node:
    __slots__ = ("children", "links", "parent", "points", "size", "skip", "tag", "trust", "weak", "worth")

    def __init__(self, tag: str, parent: _Node | None, trust: float):
        self.tag, self.parent, self.trust = tag, parent, trust
        self.skip = trust == 0 or (parent is not None and parent.skip)
        self.children: list = []
        self.points = self.size = self.links = self.worth = 0.0
        self.weak = 1.0


def _trust(tag: str, attrs: str, in_article: bool) -> float:
    """0 for what is never article text, less than 1 for an element with a doubtful class or id."""
    if tag in NEVER or (tag in OUTER and not in_article):
        return 0.0
    if not attrs or tag in ("html", "body"):
        return 1.0
    trust = 1.0
    for m in _ATTR.finditer(attrs):
        key = m[1].lower()
        value = (m[2] or m[3] or m[4] or "").lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true"):
            return 0.0
        if key == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                return 0.0
        elif key == "role":
            if value in ROLES:
                return 0.0
        elif key in ("class", "id"):
            for word in _SPLIT.split(value):
                if word in REPLIES or word.startswith("comment"):
                    trust = REPLY
                elif word in WORDS or word.startswith(STARTS) or (word in OUTER and not in_article):
                    trust = min(trust, DOUBT)
    return max(trust, DOUBT) if tag in ("article", "main") else trust


def _tokens(page: str):
    """Tokens of the page.  What follows the last ``>`` can hold no tag, so it is not searched for any."""
    end = page.rfind(">") + 1
    m = None
    for m in _TOKEN.finditer(page, 0, end):
        yield m
    if end < len(page) and not (m is not None and m["text"] is None and m["tag"] is None and _OPEN_END.match(m[0])):
        tail = re.split("<[!?]", page[end:], maxsplit=1)[0]  # a comment that never ends takes the rest
        if tail:
            yield {"text": tail}


def parse(page: str) -> _Node:
    root = _Node("html", None, 1.0)
    at, open_tags = root, {}
    for m in _tokens(page):
        text = m["text"]
        if text is not None:
            at.children.append(html.unescape(text) if "&" in text else text)
            continue
        if m["tag"] is None:
            continue
        tag = m["tag"].lower()
        if m["end"]:
            if open_tags.get(tag):
                while at.tag != tag:
                    open_tags[at.tag] -= 1
                    at = at.parent
                open_tags[tag] -= 1
                at = at.parent or root
            elif tag == "br":
                at.children.append(" ")
            continue
        if tag == "br":
            at.children.append(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                at.children.append(_Node("hr", at, 1.0))
            continue
        if tag in ("html", "body") and open_tags.get(tag):
            continue
        if tag in BLOCKS and open_tags.get("p"):  # a block ends an open paragraph, with what is open inside
            up = at
            while up.tag != "p" and up.tag not in ("td", "th", "div", "section", "article"):
                up = up.parent
            if up.tag == "p":
                while at is not up:
                    open_tags[at.tag] -= 1
                    at = at.parent
                open_tags["p"] -= 1
                at = at.parent
        for ends, fence in _ENDS:
            if tag in ends and any(open_tags.get(x) for x in ends):
                up = at
                while up is not root and up.tag not in ends and up.tag not in fence:
                    up = up.parent
                if up.tag in ends:
                    while at is not up:
                        open_tags[at.tag] -= 1
                        at = at.parent
                    open_tags[up.tag] -= 1
                    at = up.parent
        node = _Node(tag, at, _trust(tag, m["attrs"], bool(open_tags.get("article"))))
        at.children.append(node)
        if not m["attrs"].endswith("/") or tag in BLOCKS:
            open_tags[tag] = open_tags.get(tag, 0) + 1
            at = node
    return root


def _walk(root: _Node):
    """Nodes, children first; no recursion, as pages may nest deeply."""
    stack = [(root, False)]
    while stack:
        node, seen = stack.pop()
        if seen:
            yield node
            continue
        stack.append((node, True))
        stack.extend((c, False) for c in reversed(node.children) if isinstance(c, _Node))


def _measure(nodes: list[_Node]) -> None:
    """Text, linked text and a paragraph's own points (worth) of each node."""
    commas: dict[int, int] = {}
    for node in nodes:
        if node.skip:
            continue
        node.size = node.links = node.worth = 0.0
        own = 0
        n_commas = 0
        inner = False  # has blocks inside
        for c in node.children:
            if isinstance(c, str):
                own += len(c.strip())
                n_commas += c.count(",") + c.count("、") + c.count("،")
            elif not c.skip:
                node.size += c.size
                node.links += c.links
                if c.tag in BLOCKS:
                    inner = True
                else:
                    n_commas += commas.get(id(c), 0)
        node.size += own
        commas[id(node)] = n_commas
        if node.tag == "a":
            node.links = node.size
        text = own if inner else node.size
        if text and (node.tag in PARAGRAPH or (node.tag in BLOCKS and own)):
            node.worth = (1 + n_commas + text / 100) * (1 - node.links / max(node.size, 1))


def _settle(nodes: list[_Node]) -> None:
    """Drops doubtful elements that hold neither the article nor much of the text."""
    weight: dict[int, float] = {}  # paragraph points inside
    sure: dict[int, float] = {}  # of these, outside doubtful elements
    mains, named = set(), set()  # nodes that hold a main, or also an article or main heading
    for node in nodes:
        if node.skip:
            continue
        inside = [c for c in node.children if not isinstance(c, str) and not c.skip]
        weight[id(node)] = node.worth + sum(weight[id(c)] for c in inside)
        sure[id(node)] = node.worth + sum(sure[id(c)] for c in inside if c.trust == 1)
        if node.tag == "main" or any(id(c) in mains for c in inside):
            mains.add(id(node))
        if any(id(c) in named or (c.tag in ("article", "h1") and c.trust == 1) for c in inside):
            named.add(id(node))
    total = weight.get(id(nodes[-1]), 0.0)
    below = set()  # doubtful elements and what they hold
    outside = 0.0  # the greatest article that is in no doubtful element
    for node in reversed(nodes):
        if node.trust < 1 or (node.parent is not None and id(node.parent) in below):
            below.add(id(node))
        elif not node.skip and node.tag in ("article", "main"):
            outside = max(outside, sure[id(node)])
    for node in reversed(nodes):
        if node.parent is not None:
            node.skip |= node.parent.skip
            node.weak = node.parent.weak
        if node.skip or node.trust == 1:
            continue
        own = weight[id(node)]
        if id(node) in mains or (id(node) in named and own >= NAMED * total):
            node.skip = own < outside
        elif own and own >= SHARE * total:
            node.weak *= node.trust
        else:
            node.skip = True


def _score(root: _Node) -> None:
    nodes = list(_walk(root))
    _measure(nodes)
    if any(0 < node.trust < 1 for node in nodes):
        _settle(nodes)
        _measure(nodes)
    for node in nodes:
        if node.worth and not node.skip:
            points = node.worth * node.weak
            up, share = node.parent, 1
            while up is not None and share <= ANCESTORS:
                up.points += points / share
                up, share = up.parent, share + 1


def _blocks(nodes: list[_Node], least: float = 0.0) -> list[str]:
    """Lines of the nodes, without elements weaker than ``least``."""
    out: list[str] = []
    line: list[str] = []

    def end():
        text = " ".join("".join(line).split())
        if text:
            out.append(text)
        line.clear()

    stack: list = list(reversed(nodes))
    while stack:
        node = stack.pop()
        if isinstance(node, str):
            line.append(node)
        elif node is None:
            end()
        elif not node.skip and node.weak >= least:
            block = node.tag in BLOCKS
            if block:
                end()
                stack.append(None)
            stack.extend(reversed(node.children))
    end()
    return out


def _weakest(best: _Node) -> float:
    """How weak a part of the best container may be: its weaker parts go unless they outweigh the rest."""
    inside = [node for node in _walk(best) if node.worth and not node.skip]
    weaker = sum(node.worth * node.weak for node in inside if node.weak < best.weak)
    return best.weak if sum(node.worth * node.weak for node in inside) >= 2 * weaker else 0.0


def main_text(page: str | None) -> str:
    """Blocks of the main text, one to a line; empty where there is none."""
    if not page:
        return ""
    root = parse(page)
    _score(root)
    best, most = None, 0.0
    for node in _walk(root):
        if not node.skip and node.points and node.tag in BLOCKS | {"html"}:
            points = node.points * (1 - node.links / max(node.size, 1))
            if points > most:
                best, most = node, points
    if best is None:
        return "\n".join(_blocks([root]))
    up = best.parent
    while up is not None and up.tag not in ("article", "main"):
        up = up.parent
    if up is not None and not up.skip and up.links <= LINKS * up.size:
        best = up  # the page itself names the container
    least = _weakest(best)
    if best.parent is None or best.tag in ("article", "body", "main"):
        return "\n".join(_blocks([best], least))
    keep = []
    for sibling in best.parent.children:
        if sibling is best:
            keep.append(sibling)
        elif isinstance(sibling, _Node) and not sibling.skip and sibling.size:
            few_links = sibling.links <= LINKS * sibling.size
            if few_links and (sibling.points >= SIBLING * most or sibling.tag in PARAGRAPH or re.fullmatch("h[1-6]", sibling.tag)):
                keep.append(sibling)
    return "\n".join(_blocks(keep, least))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for each row of ``pages``.

    Null and empty pages give an empty text; null ids and urls stay null, repeated rows are extracted
    each, other columns are ignored, an empty table gives no rows.  White space inside a block is one
    space, blocks are joined by one line feed in page order, character references are decoded.  One
    pass without a shuffle; memory is bounded by the longest single page.
    """

    def run(batches):
        for batch in batches:
            for part in byte_balanced(batch, "html"):
                found = pa.array([main_text(x) for x in part.column("html").to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), found, pc.utf8_length(found).cast(pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    return pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"),
    ).mapInArrow(run, SCHEMA)
