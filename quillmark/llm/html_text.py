"""Main text of web pages by composite text density.

For every node of the body: C characters of text (white space collapsed), L of them inside links, T tags below it, K of
them links. Its density is the characters a tag, corrected for links: C / T * log(C / L * T / K) to the base
ln(C / (C - L) * L + share * C + e), where share is the body's L / C and counts of 0 stand as 1; a node without text has
density 0. A node's sum is that of its children's densities; of a block that holds no other, its own; of words in a
line (which are no subtree of their own), 0.

The node of the greatest sum is looked for (of equals the outermost; nodes in parts that their tag, role or class names
as menu, footer, comments and so on are passed over). The threshold is the least density on the path from it to the body.
From the body down, each node at or above the threshold marks the node of greatest sum below it, if that has at least a
tenth of the greatest sum of all (a single line of plain text is dense as well); the content is the smallest subtree
that holds all marked nodes, or the <main> that has it in one of several articles. Blocks in it that lie under the threshold and hold no marked node go if most of their text is
links, if they are a short line at the end that says whose rights are reserved (but for paragraphs in an <article>), or if
they are no paragraphs, headings, quotations, articles or the like and stand outside of the kept blocks; named parts go last.

A class name is sure if it is made of words for such parts and for containers alone (`comment-list`). It is in doubt if it
has other words as well (`cookie-recipes`), if the part holds the page's <h1> or <main>, or if an <article> has a name of its
own beside it (`entry nav-below`); what is in doubt stays if it holds the node of the greatest sum, so that densities decide,
and goes otherwise. Words on the state of a part (`has-sidebar`, `comments-enabled`) name nothing.

Parsing closes unclosed and misnested tags as browsers do, in time that grows with the page: open tags are found by
name, and what a tag that is never ended costs is bounded. Rows: a null or empty page has empty text; pages of any length
and depth are read whole; repeated rows repeat; a null page_id or url is kept; other columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Nothing in them is markup; all but the last three end the page's text if they are never closed.
_RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
_BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
#: Tags that close an open <p>, and end an unclosed <svg> or <math>.
_CLOSES_P = frozenset("address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: For a tag that opens: the open tags it closes, and those beyond which none is closed.
_SIBLINGS = {
    "li": ("li", "ul ol menu"), "dd": ("dd dt", "dl"), "dt": ("dd dt", "dl"), "option": ("option", "select"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"),
    "tbody": ("thead tbody tr td th", "table"), "tfoot": ("thead tbody tr td th", "table"), "thead": ("thead tbody tr td th", "table"),
}
_SIBLINGS = {tag: (closes.split(), ends.split()) for tag, (closes, ends) in _SIBLINGS.items()}
#: End tags of others do not reach out of these.
_SCOPES = frozenset("table td th caption".split())
_TABLE = frozenset("table tbody thead tfoot tr td th caption".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Blocks that an article is made of: they stay however short they are.
_PROSE = _HEADINGS | frozenset("article details summary p pre blockquote li dd dt td th tr tbody table ul ol dl figure figcaption br hr hgroup".split())
_DROP_TAGS = frozenset("nav footer aside form button select dialog menu fieldset object embed canvas audio video map head svg template noscript".split())
_DROP_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words of class names that name a part wherever they stand, and those that do only alone or as site-..., page-..., ....
_DROP_WORDS = frozenset("ad ads advert adverts advertisement advertising adbox adsense adslot breadcrumb breadcrumbs comment comments commentlist disqus cookie cookies consent gdpr footer masthead menu menus nav navbar navigation promo promoted promotion related recommended recommendations sidebar sidenav sponsor sponsored sponsors subscribe subscription newsletter signup pagination pager tagcloud paywall".split())
_DROP_NAMES = frozenset("banner banners header notice notices notification popup modal overlay share sharing social side login search searchbox toolbar topbar widget widgets skip tags alert respond replies reply".split())
_PREFIXES = frozenset("site page global top main masthead".split())
#: Words beside those of a part that leave its name sure: containers, places, kinds of entries.
_CONTAINERS = frozenset("area section list box block wrapper wrap container content inner outer body item items group panel bar row col column unit slot space zone top bottom left right main primary secondary header heading title links link text posts post articles article stories story form message policy banner notice popup modal overlay dialog module component region holder site page global desktop mobile widget widgets social share reply respond thread threads author meta count above below before after inline sticky fixed bordered".split())
#: Words at the start and at the end of a class name that speak of a state, and names of an article itself.
_STATES = frozenset("no not has with without is hide show js".split())
_STATE_ENDS = frozenset("enabled disabled open opened closed allowed on off".split())
_OWN_NAMES = frozenset("entry hentry post article story single content main".split())
_SURE, _DOUBT = 2, 1
#: Characters of a line that may say whose rights are reserved.
_SHORT = 300
_RIGHTS = re.compile(r"©|\(c\)\s|copyright|all rights reserved", re.I)

_OPENING = re.compile(r"</?[A-Za-z][^\s/>]*+|<!--|<!\[CDATA\[|<[!?/]")
_STOP = re.compile(r"[>\"']")
_ATTR = re.compile(r"(?<![^\s=\"'/])([^\s=\"'/]++)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"']++))")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_SPACE = re.compile(r"\s+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_SPLIT = re.compile(r"[^a-z0-9]+")
#: Part of the greatest sum that a marked node needs.
LEAST_SHARE = 0.1


class Node:
    __slots__ = ("attrs", "best", "chars", "children", "density", "depth", "doubt", "drop", "link_chars", "links", "marked", "parent", "tag", "tags", "total")

    def __init__(self, tag: str, parent: "Node | None", attrs: str = ""):
        self.tag, self.parent, self.attrs = tag, parent, attrs
        self.depth = parent.depth + 1 if parent else 0
        self.children: list[Node | str] = []
        self.doubt = self.drop = self.marked = False

    def nodes(self) -> list["Node"]:
        return [c for c in self.children if isinstance(c, Node)]


def _class_names(tag: str, value: str) -> int:
    """Whether class names or an id name a part that is no article: _SURE, _DOUBT or 0."""
    found, own = 0, False
    for token in _CAMEL.sub("-", value).lower().split():
        words = [w for w in _SPLIT.split(token) if w and not w.isdigit()]
        if not words or len(words) > 1 and (words[0] in _STATES or words[-1] in _STATE_ENDS):
            continue
        own |= _OWN_NAMES.issuperset(words)
        if not _DROP_WORDS.isdisjoint(words):
            sure = all(w in _DROP_WORDS or w in _CONTAINERS for w in words)
            found = max(found, _SURE + (len(words) == 1) if sure else _DOUBT)
        elif words[-1] in _DROP_NAMES and (len(words) == 1 or _PREFIXES.issuperset(words[:-1])):
            found = max(found, _SURE)
    # An article that has a name of its own isn't a part by a name of several words.
    return _DOUBT if found == _SURE and own and tag == "article" else min(found, _SURE)


def _named(tag: str, attrs: str) -> int:
    """Whether the attributes name a part that is no article: _SURE, _DOUBT or 0."""
    found, control = 0, False
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        low = value.lower()
        if name == "role" and low in _DROP_ROLES or name == "style" and _HIDDEN.search(low) or name == "aria-hidden" and low == "true":
            return _SURE + 1
        control |= name == "for" and tag == "label"
        if name in ("class", "id") and tag not in ("html", "body", "main") and tag not in _HEADINGS:
            found = max(found, _class_names(tag, value))
    return _SURE + 1 if control or attrs and re.search(r"(?:^|\s)hidden(?:\s|$)", _ATTR.sub(" ", attrs)) else found


class _Tags:
    """Tags of a page in order: (start, end, name, is an end tag, attributes); comments and the like have no name."""

    def __init__(self, page: str):
        self.page, self.spare = page, 4 * len(page)
        self.last = {c: page.rfind(c) for c in ">\"'"}

    def end(self, at: int) -> int:
        """Where a tag ends whose name ends at `at`, past its quoted values; -1 if it doesn't end."""
        page, first = self.page, at
        while self.spare > 0 and (m := _STOP.search(page, at)):
            at = m.end()
            if m[0] == ">":
                self.spare -= at - first
                return at
            if self.last[m[0]] < at:  # the quote isn't closed
                break
            at = page.index(m[0], at) + 1
        self.spare -= at - first
        return page.find(">", first) + 1 or -1

    def next(self, at: int) -> tuple[int, int, str, bool, str] | None:
        page = self.page
        while m := _OPENING.search(page, at):
            start, sign = m.start(), m[0]
            if sign == "<!--":
                end = page.find("-->", m.end())
                return start, end + 3 if end >= 0 else len(page), "", False, ""
            if sign == "<![CDATA[":
                end = page.find("]]>", m.end())
                return start, end + 3 if end >= 0 else len(page), "", False, page[m.end() : end if end >= 0 else len(page)]
            if self.last[">"] < m.end():
                return (start, len(page), "", False, "") if sign in ("<!", "<?", "</") else None
            if sign in ("<!", "<?", "</"):
                return start, page.index(">", start) + 1, "", False, ""
            end = self.end(m.end())
            if end > 0:
                closing = sign[1] == "/"
                return start, end, sign[1 + closing :].lower(), closing, page[m.end() : end - 1]
            at = m.end()
        return None


def parse(page: str) -> Node:
    """A tree of nodes and strings (character references decoded) below a node `#root`."""
    root = node = Node("#root", None)
    tags, at, body = _Tags(page), 0, None
    opened: dict[str, list[Node]] = {}

    def depth(names) -> int:
        return max((opened[t][-1].depth for t in names if opened.get(t)), default=0)

    def close(to: Node) -> None:
        """Closes all open nodes down to and with `to`."""
        nonlocal node
        while node is not to:
            opened[node.tag].pop()
            node = node.parent
        opened[node.tag].pop()
        node = node.parent

    def text(piece: str) -> None:
        if piece:
            node.children.append(html.unescape(piece) if "&" in piece else piece)

    while found := tags.next(at):
        start, end, tag, closing, attrs = found
        text(page[at:start])
        at = end
        if not tag:
            if attrs:
                node.children.append(attrs)
            continue
        if closing:
            if tag in ("html", "body") or not opened.get(tag):
                continue
            target = opened[tag][-1]
            if tag in _TABLE or target.depth > depth(_SCOPES):
                close(target)
            continue
        if tag in _RAW:
            m = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
            at = (page.find(">", m.end()) + 1 or len(page)) if m else len(page)
            continue
        if tag == "html" or tag == "body" and body:
            continue
        if tag == "body" or opened.get("head") and tag not in ("meta", "link", "base", "noscript", "template"):
            while node is not root:
                close(node)
        if tag in _CLOSES_P:
            for foreign in ("svg", "math"):
                if opened.get(foreign) and opened[foreign][0].depth > depth(_SCOPES):
                    close(opened[foreign][0])
            if opened.get("p") and opened["p"][-1].depth > depth(_SCOPES):
                close(opened["p"][-1])
        if tag in _SIBLINGS:
            closes, ends = _SIBLINGS[tag]
            border = depth(ends)
            inner = [opened[t][-1] for t in closes if opened.get(t) and opened[t][-1].depth > border]
            if inner:
                close(min(inner, key=lambda x: x.depth))
        child = Node(tag, node, attrs)
        node.children.append(child)
        body = child if tag == "body" else body
        if tag not in _VOID and not (attrs.endswith("/") and tag not in _BLOCK):
            opened.setdefault(tag, []).append(child)
            node = child
    text(page[at:])
    return root


def walk(root: Node) -> list[Node]:
    """All nodes, parents first; no recursion, as pages may nest without bound."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(reversed(node.nodes()))
    return out


def weigh(nodes: list[Node]) -> None:
    """Density and density sum of each node. nodes: a body and all below it, parents first."""
    for node in reversed(nodes):
        node.chars = node.link_chars = node.tags = node.links = 0
        for c in node.children:
            if isinstance(c, str):
                node.chars += len(_SPACE.sub(" ", c).strip())
            else:
                node.chars += c.chars
                node.link_chars += c.link_chars
                node.tags += c.tags + 1
                node.links += c.links + (c.tag == "a")
        if node.tag == "a":
            node.link_chars = node.chars
    share = nodes[0].link_chars / max(nodes[0].chars, 1)
    for node in reversed(nodes):
        node.density = 0.0
        if node.chars:
            c, l, t, k = node.chars, max(node.link_chars, 1), max(node.tags, 1), max(node.links, 1)
            base = math.log(c / max(c - node.link_chars, 1) * l + share * c + math.e)
            node.density = c / t * math.log(max(c / l * t / k, 1.0)) / math.log(base)
        inner = node.nodes()
        holds_block = any(c.tag in _BLOCK and c.tag not in _VOID for c in inner)
        node.total = sum(c.density for c in inner) if holds_block else node.density if node.tag in _BLOCK else 0.0


def _drop_named(nodes: list[Node]) -> None:
    """Marks the parts that are named as no article, or may be; a header is one unless it heads an article or section."""
    inside = {nodes[0]: False}
    leads = set()  # what holds an <h1> or <main>
    for node in reversed(nodes):
        if node.tag in ("h1", "main") or node in leads:
            leads.update((node, node.parent))
    for node in nodes[1:]:
        held = inside[node.parent] or node.parent.tag in ("article", "main", "section")
        inside[node] = held
        name = _named(node.tag, node.attrs)
        if name == _SURE and node in leads:
            name = _DOUBT
        node.drop = node.parent.drop or node.tag in _DROP_TAGS or node.tag == "header" and not held or name >= _SURE
        node.doubt = name == _DOUBT and not node.drop


def _find_best(nodes: list[Node]) -> None:
    """The node of greatest sum in each subtree, the outermost of equals."""
    for node in reversed(nodes):
        node.best = node
        for c in node.nodes():
            if not c.drop and c.best.total > node.best.total:
                node.best = c.best


def choose(root: Node) -> tuple[Node, float]:
    """The content's subtree and the threshold; its marked nodes are marked."""
    body = next((n for n in walk(root) if n.tag == "body"), root) if root.tag == "#root" else root
    nodes = walk(body)
    weigh(nodes)
    _drop_named(nodes)
    _find_best(nodes)
    if any(node.doubt for node in nodes):  # parts in doubt go unless they hold the greatest sum
        up = body.best
        while up is not body:
            up.doubt = False
            up = up.parent
        for node in nodes[1:]:
            node.drop |= node.doubt or node.parent.drop
        _find_best(nodes)
    threshold, up = body.best.density, body.best
    while up is not body:
        up = up.parent
        threshold = min(threshold, up.density)
    stack = [body]
    while stack:
        node = stack.pop()
        if node.density >= threshold and not node.drop:
            node.best.marked |= node.best.total >= LEAST_SHARE * body.best.total
            if node.best is not node:
                stack.extend(node.nodes())
    content = None
    for node in nodes:
        if node.marked:
            if content is None:
                content = node
                continue
            other = node
            while other is not content:
                if other.depth >= content.depth:
                    other = other.parent
                else:
                    content = content.parent
    # A <main> of several articles is content as a whole.
    up = content = content or body
    while up is not body and up.tag != "article":
        up = up.parent
    if up.tag == "article" and up.parent.tag == "main" and any(c.tag == "article" and c is not up and not c.drop for c in up.parent.nodes()):
        content = up.parent
    return content, threshold


def prune(content: Node, threshold: float) -> None:
    """Drops the blocks under the threshold that belong to no article."""
    nodes, up = walk(content), content
    while up.parent is not None and up.tag != "article":
        up = up.parent
    kept = _PROSE if up.tag == "article" else frozenset()  # an article may say whose rights are reserved
    holds = dict.fromkeys(nodes, False)
    for node in reversed(nodes):
        holds[node] = node.marked or any(holds[c] for c in node.nodes())
    def claims(c: Node) -> bool:
        """A short line on whose rights are reserved."""
        return c.chars < _SHORT and not c.nodes() and bool(_RIGHTS.search(" ".join(blocks_of(c))))

    for node in nodes:
        blocks = [c for c in node.nodes() if c.tag in _BLOCK and not c.drop]
        sure = [c.density >= threshold or holds[c] or c.tag in _PROSE for c in blocks]
        first, last = (sure.index(True), len(sure) - sure[::-1].index(True)) if True in sure else (0, len(sure))
        at_end = True  # only such lines come after it
        for i in range(len(blocks) - 1, -1, -1):
            c = blocks[i]
            if not c.chars:
                continue
            low = c.density < threshold and not holds[c]
            says = (low or at_end) and claims(c)
            if low:
                c.drop = 2 * c.link_chars > c.chars and c.links > 1 or says and c.tag not in kept and (at_end or c.tag != "p") or not sure[i] and not first <= i < last
            at_end &= says


def blocks_of(node: Node) -> list[str]:
    """Texts of the blocks below a node in page order, white space collapsed, empty ones left out."""
    blocks, run = [], []

    def close() -> None:
        if run and (s := _SPACE.sub(" ", "".join(run)).strip()):
            blocks.append(s)
        run.clear()

    stack: list[tuple[Node | str, bool]] = [(node, False)]
    while stack:
        item, leaving = stack.pop()
        if isinstance(item, str):
            run.append(item)
            continue
        if item.tag in _BLOCK:
            close()
        if not leaving:
            stack.append((item, True))
            stack.extend((c, False) for c in reversed(item.children) if isinstance(c, str) or not c.drop)
    close()
    return blocks


def main_text(page: str | None) -> str:
    if not page:
        return ""
    content, threshold = choose(parse(page))
    prune(content, threshold)
    return " ".join(blocks_of(content))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array([main_text(h.as_py()) for h in batch["html"]], pa.string())], ["page_id", "url", "text"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return rows.mapInArrow(run, "page_id long, url string, text string")
