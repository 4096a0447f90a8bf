"""6. HTML extraction by composite text density.

A tolerant parser builds the tree of a page. Elements that hold no text of the page (scripts, styles, controls, hidden ones) go at once. Menus, headers, footers,
sidebars, notices, adverts, forms and reader comments, known by tag, role or class, go unless the page's text lies in them: a weak sign
(a class, a form) is overruled by more than half of the text outside links or by the page's only article, a strong one (nav, header, footer,
aside, comments) by nine tenths of that text. Headings and paragraphs in the header of an article belong to the article. A word that also names subjects (related, legal, share, rating) is a
soft sign: it counts only where the element is mostly links, has no paragraph or heading with text, or lies outside the densest subtree.

Every node then gets its composite text density: characters per tag, scaled down the more of them are link text. A node's density sum adds up the densities of its
children. The search starts at the node with the largest sum; the least density on the path from it to the body is the
threshold. Below every node that reaches the threshold the one with the
largest sum is marked, and the smallest subtree that covers all marked ones is taken; in it, blocks beside the marked ones that are mostly text of several links are left out.
All text of what is taken is returned, block by block.

Null, empty and markup-free pages: the empty text, or the text itself. Unclosed tags, tags cut off at the end and references cut short
are taken as browsers take them. Repeated rows, and null ids, give results of their own; columns named as a result are replaced, others don't matter. Ties of sums go to the outer, then
to the first node. An empty table gives an empty one. A page is one row's work, linear in its length, however deep its tags are nested.
"""

from __future__ import annotations

import html as html_lib
import math
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from huespan.llm.common import unused

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("caption legend summary tbody td tfoot th thead tr html body".split())
#: An opening tag closes an open one of these, up to the nearest of the tags that bound it.
SAME = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
SCOPE = frozenset("article aside body button div footer form header html main nav section table td th ul ol dl li blockquote".split())
# What holds no text of the page, and what holds it only by mistake.
EMPTY = frozenset("head script style noscript template iframe object svg canvas select option button input textarea audio video map title".split())
ASIDE = frozenset("nav header footer aside dialog menu".split())
IN_HEAD = frozenset("meta link title base script style noscript template".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tablist".split())
_SOFT_WORDS = "side|share|sharing|social|related|recommend\\w*|search|copyright|legal|disclaimer|skip|tags?|rating"
SOFT_ONLY = re.compile(rf"(?:^|[\s_-])(?:{_SOFT_WORDS})(?:$|[\s_-])")
HARD = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adverts?|adsense|sponsor\w*|promo\w*|banners?|sidebars?|menus?|nav\w*|breadcrumbs?|footer|header|masthead|comments?|commentlist|disqus|replies|respond|cookies?|consent|gdpr|notices?|alerts?|warnings?|popups?|modal|overlay|newsletter|subscri\w+|signup|widgets?|toolbar|pagination|pager|login)(?:$|[\s_-])"
)
#: Who wrote it and when, in the header of an article.
BYLINE = re.compile(r"(?:^|[\s_-])(?:by-?lines?|authors?|meta|date-?lines?|dates?|time|timestamp|posted|published|updated)(?:$|[\s_-])")
COMMENTS = re.compile(r"(?:^|\s)(?:[\w-]*[_-])?(?:comments?|commentlist|disqus|replies|respond)(?:[_-](?:area|list|section|thread|wrap|wrapper|container|block|box|body|form|content))?(?:$|\s)")
#: Parts of a class that say something about the page, not what the element is: no-sidebar, with-header, tag-travel, comments-open.
MODIFIED = re.compile(
    r"(?:^|(?<=[\s_-]))(?:no|not|non|with|without|has|hide|category|tag(?![_-]+(?:cloud|links?|list)(?![^\s_-])))[_-]\S*|(?<!\S)\S+[_-](?:enabled|disabled|open|closed|on|off)(?!\S)"
)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_TELLING = re.compile("class|id|role|hidden|style")
#: A comment ends as browsers have it, at "-->" or "--!>", or at once.
_COMMENT = r"<!--(?:-?>|.*?--!?>)|"
# Quantifiers are possessive, so stray quotes cost one look more, not one for each way to pair them.
_REST = re.compile(
    r"<(script|style|noscript|template|iframe|textarea|title|xmp|noembed|noframes)(?=[\s/>])(?:(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*+>).*?(?:</\1(?=[\s/>])[^>]*+(?:>|\Z)|\Z)|<(/?)([a-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-z][^\s/>]*)([^>]*)>|<[!?][^>]*>|</[^>]*>|<[a-z!/?][^>]*\Z|<!--.*\Z",
    re.DOTALL | re.IGNORECASE,
)
_TOKEN = re.compile(_COMMENT + _REST.pattern, re.DOTALL | re.IGNORECASE)
#: How sure a sign is that an element isn't the page's text, and the share of that text, in tenths, from which the sign is overruled.
SOFT, WEAK, STRONG = 1, 2, 3
OVERRULED = {SOFT: 5, WEAK: 5, STRONG: 9}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


class Node:
    __slots__ = ("tag", "parent", "items", "junk", "empty", "byline", "own", "chars", "tags", "link_chars", "link_tags", "density", "sum")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent = tag, parent
        self.items: list[Node | str] = []  # children and stretches of text, in order
        self.junk, self.empty, self.byline, self.own = 0, False, False, -1
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.sum = 0.0

    def kids(self) -> list[Node]:
        return [x for x in self.items if isinstance(x, Node)]


def _judged(node: Node, attrs: str) -> None:
    """Sets junk and empty from an element's tag and attributes."""
    tag = node.tag
    node.empty = tag in EMPTY
    node.junk = STRONG if tag in ASIDE else WEAK if tag == "form" else 0
    if not attrs or not _TELLING.search(low := attrs.lower()):
        return
    for name, a, b, c in _ATTR.findall(low):
        value = a or b or c
        if name == "hidden" and value != "until-found" or name == "aria-hidden" and value == "true" or name == "style" and HIDDEN.search(value):
            node.empty = True
        elif name == "role" and value in ROLES:
            node.junk = WEAK if value in ("form", "search") else STRONG
        elif name in ("class", "id"):
            node.byline = node.byline or BYLINE.search(value) is not None
            if tag not in ("article", "main") and (HARD.search(value) or SOFT_ONLY.search(value)):
                plain = MODIFIED.sub("", value)
                hard = WEAK if HARD.search(plain) else SOFT if SOFT_ONLY.search(plain) else 0
                node.junk = max(node.junk, STRONG if COMMENTS.search(plain) else hard)


def parse(page: str) -> Node:
    """The whole tree of a page, junk and empty elements marked.

    Open elements are a stack; for each tag the places on it are kept, so closing one costs what it closes."""
    root = Node("body", None)
    stack = [root]
    places: dict[str, list[int]] = {}
    scopes: list[int] = []

    def last(tags: Iterable[str]) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def close(at: int) -> None:
        while len(stack) > at:
            gone = stack.pop().tag
            places[gone].pop()
            if gone in SCOPE:
                scopes.pop()

    def text(s: str) -> None:
        if s:
            if places.get("head") and s.strip():
                close(places["head"][-1])
            stack[-1].items.append(html_lib.unescape(s) if "&" in s else s)

    at, closing = 0, max(page.rfind("-->"), page.rfind("--!>"))
    while m := (_TOKEN if at <= closing else _REST).search(page, at):  # beyond the last end of a comment none is looked for
        text(page[at : m.start()])
        at = m.end()
        name = m[3] or m[6]
        if name is None:
            continue
        tag, attrs = name.lower(), m[4] or m[7] or ""
        if tag in ("html", "body"):
            continue
        if (m[2] or m[5]) == "/":
            if found := places.get(tag):
                close(found[-1])
            continue
        if tag not in IN_HEAD and places.get("head"):
            close(places["head"][-1])
        if tag in CLOSES_P and places.get("p") and places["p"][-1] > (scopes[-1] if scopes else 0):
            close(places["p"][-1])
        if tag in SAME:
            same, bound = SAME[tag]
            if (of := last(same)) > last(bound):
                close(of)
        node = Node(tag, stack[-1])
        stack[-1].items.append(node)
        if tag in VOID:
            continue
        _judged(node, attrs)
        if attrs.rstrip().endswith("/") and (node.empty or node.junk):
            continue
        places.setdefault(tag, []).append(len(stack))
        if tag in SCOPE:
            scopes.append(len(stack))
        stack.append(node)
    text(page[at:])
    return root


def _order(root: Node) -> list[Node]:
    """Nodes, parents before children."""
    out = [root]
    for n in out:
        out.extend(n.kids())
    return out


def _length(n: Node) -> int:
    """Characters of a node's own text, which stays as it is parsed."""
    if n.own < 0:
        n.own = sum([len(" ".join(x.split())) for x in n.items if isinstance(x, str)])
    return n.own


def prune(root: Node) -> Node:
    """Drops empty and junk elements, less those that hold the page's text; what stood there parts the text around it."""
    for n in _order(root):
        n.items = [Node("hr", n) if isinstance(x, Node) and x.empty else x for x in n.items]
    nodes = _order(root)
    if not any(n.junk for n in nodes):
        return root
    plain: dict[int, int] = {}  # characters outside links
    clear: dict[int, int] = {}  # of them, those outside junk
    most: dict[int, int] = {}  # and those of the largest article of a subtree that no strong sign is around
    free: dict[int, int] = {}  # articles with clear text below a node, none of them in junk
    within = {id(root): 0}  # the strongest sign around a node
    linked: dict[int, int] = {}  # characters of links, and whether a paragraph or heading of it has text outside links; both for soft signs
    told: dict[int, bool] = {}
    any_soft = any(n.junk == SOFT for n in nodes)
    for n in nodes:
        for k in n.kids():
            within[id(k)] = max(within[id(n)], k.junk)
    article = lambda n: n.tag in ("article", "main")
    for n in reversed(nodes):
        kids, own = n.kids(), 0 if n.tag == "a" else _length(n)
        plain[id(n)] = own + sum(plain[id(k)] for k in kids) if n.tag != "a" else 0
        clear[id(n)] = own + sum(clear[id(k)] for k in kids if not k.junk) if n.tag != "a" else 0
        most[id(n)] = max(plain[id(n)] if article(n) and within[id(n)] < STRONG else 0, *(most[id(k)] for k in kids), 0)
        free[id(n)] = sum(free[id(k)] + (article(k) and clear[id(k)] > 0) for k in kids if not k.junk)
        if not any_soft:
            continue
        linked[id(n)] = sum(linked[id(k)] for k in kids) + (_length(n) + sum(plain[id(k)] for k in kids) if n.tag == "a" else 0)
        told[id(n)] = any(told[id(k)] for k in kids) or (n.tag == "p" or n.tag in HEADINGS) and plain[id(n)] > 0
    # Without an article outside junk, the largest one overrules the weak signs around it.
    if not free[id(root)] and most[id(root)]:
        held, signs = root, 0
        while held is not None:
            signs, held.junk = signs + held.junk, 0
            held = next((k for k in held.kids() if most[id(k)] == most[id(root)]), None) if not article(held) else None
        if signs:
            return prune(root)
    soft: dict[int, Node] = {}
    todo = [(root, root)]  # a node, and the article around it
    while todo:
        n, around = todo.pop()
        around = n if article(n) else around
        for at, k in enumerate(n.items):
            if not isinstance(k, Node):
                continue
            if k.junk and (free[id(around)] or 10 * plain[id(k)] <= OVERRULED[k.junk] * plain[id(around)]):
                if k.junk == SOFT and told[id(k)] and linked[id(k)] <= plain[id(k)]:
                    soft[id(k)] = k
                    todo.append((k, around))
                    continue
                heads = _lead(k) if k.tag == "header" and _in_article(n) else []
                k = n.items[at] = Node("hr" if not heads else "div", n)  # noqa: PLW2901
                k.items = [*heads]
                for h in heads:
                    h.parent = k
            else:
                todo.append((k, around))
    if soft:
        _drop_outside(root, soft)
    return root


def _drop_outside(root: Node, soft: dict[int, Node]) -> None:
    """Drops the elements that lie outside the subtree that is the densest without them; of equals the innermost counts."""
    parents = {id(k.parent): k.parent for k in soft.values()}
    whole = {key: n.items for key, n in parents.items()}
    for n in parents.values():
        n.items = [x for x in n.items if id(x) not in soft]
    best = max(reversed(measure(root)), key=lambda n: n.sum)
    for key, n in parents.items():
        n.items = whole[key]
    held = {id(n) for n in _order(_block(best))}
    for n in parents.values():
        n.items = [Node("hr", n) if id(x) in soft and id(x) not in held else x for x in n.items]


def _in_article(n: Node | None) -> bool:
    return n is not None and (n.tag in ("article", "main") or n.tag in ("div", "section") and n.parent is not None and n.parent.tag in ("article", "main"))


def _lead(header: Node) -> list[Node]:
    """Headings and paragraphs of an article's header, without bylines and what is in links."""
    out, todo = [], [header]
    while todo:
        n = todo.pop()
        if n.tag in HEADINGS or n.tag == "p" and not n.byline and any(_length(x) for x in _order(n) if x.tag != "a"):
            out.append(n)
        elif not (n.byline or n.junk and n is not header):
            todo.extend(reversed(n.kids()))
    return out


def measure(root: Node) -> list[Node]:
    """Counts, densities and density sums of every node; the nodes, parents before children."""
    nodes = _order(root)
    for n in reversed(nodes):
        kids = n.kids()
        n.chars = _length(n) + sum(k.chars for k in kids)
        n.tags = len(kids) + sum(k.tags for k in kids)
        n.link_chars = n.chars if n.tag == "a" else sum(k.link_chars for k in kids)
        n.link_tags = sum(k.link_tags + (k.tag == "a") for k in kids)
    c_body, l_body = max(1, root.chars), root.link_chars
    for n in nodes:
        c, t, lc, lt = n.chars, max(1, n.tags), n.link_chars, n.link_tags
        if c:
            base = math.log(c / max(1, c - lc) * lc + l_body / c_body * c + math.e)
            n.density = c / t * math.log(max(c / max(1, lc) * t / max(1, lt), 1.0000001)) / math.log(max(base, 1.0000001)) if base > 1 else c / t
    for n in nodes:
        n.sum = sum(k.density for k in n.kids()) + sum(1.0 for x in n.items if isinstance(x, str) and x.strip())
    return nodes


def main_node(root: Node) -> Node:
    """The subtree that holds the main text."""
    nodes = measure(root)
    best = max(nodes, key=lambda n: n.sum)  # the first of equals, so the outer one
    path, up = [], best
    while up is not None:
        path.append(up)
        up = up.parent
    threshold = min(n.density for n in path)
    return _covering(nodes, _block(best), threshold)


def _block(node: Node) -> Node:
    """What is more than a block's inline part."""
    while node.parent is not None and node.tag not in ("article", "main", "div", "section", "td", "body"):
        node = node.parent
    return node


def _covering(nodes: list[Node], best: Node, threshold: float) -> Node:
    """The smallest block that covers best and every other subtree marked, without blocks of several links between these."""
    # The largest sum below each node.
    top: dict[int, tuple[float, Node]] = {}
    for n in reversed(nodes):
        top[id(n)] = max([(n.sum, n), *(top[id(k)] for k in n.kids())], key=lambda x: x[0])
    marked, todo = {id(best)}, [nodes[0]]
    while todo:
        n = todo.pop()
        if id(n) in marked or n.density < threshold or not n.chars:
            continue
        marked.add(id(top[id(n)][1]))
        todo.extend(n.kids())
    holds: dict[int, int] = {}  # marked nodes in each subtree
    for n in reversed(nodes):
        holds[id(n)] = (id(n) in marked) + sum(holds[id(k)] for k in n.kids())
    cover, down = nodes[0], nodes[0]
    while down is not None:
        cover = down
        down = None if id(cover) in marked else next((k for k in cover.kids() if holds[id(k)] == holds[id(nodes[0])]), None)
    cover = _block(cover)
    todo = [cover]
    while todo:
        n = todo.pop()
        if id(n) in marked:
            continue
        for at, k in enumerate(n.items):
            if isinstance(k, Node):
                if holds[id(k)]:
                    todo.append(k)
                elif k.tag in BLOCK and k.density < threshold and k.link_tags > 2 and 2 * k.link_chars > k.chars:
                    n.items[at] = Node("hr", n)
    return cover


def blocks(node: Node) -> list[str]:
    """Texts of the blocks of a subtree in page order, white space turned into single spaces; empty ones are left out."""
    out: list[str] = []
    buffer: list[str] = []

    def flush() -> None:
        if s := " ".join("".join(buffer).split()):
            out.append(s)
        buffer.clear()

    todo: list[Node | str | None] = [node]
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            buffer.append(x)
        elif x.tag == "br":
            buffer.append(" ")
        elif x.tag in BLOCK:
            flush()
            todo.append(None)
            todo.extend(reversed(x.items))
        else:
            todo.extend(reversed(x.items))
    flush()
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    return "\n".join(blocks(main_node(prune(parse(page)))))


def extract_text(pages: DataFrame, html: str = "html", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns in keep (all but html by default), text and n_chars, its number of code points."""
    keep = [c for c in (pages.columns if keep is None else keep) if c not in (html, text, "n_chars")]
    rows = pages.select(*[pages[c] for c in keep], pages[html].cast("string").alias(unused(pages, "page")))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(x.as_py()) for x in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())], [*keep, text, "n_chars"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]), f"`{text}` string, n_chars long"])
    return rows.mapInArrow(work, schema)
