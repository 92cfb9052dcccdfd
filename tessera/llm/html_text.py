"""HTML extraction by composite text density.

A page is parsed into a tree, and subtrees that are never article text (menus, headers, footers, sidebars, scripts,
styles) are left out by element. A form, or a container whose class, id or role is the name of a sidebar, menu, share bar and so on (``boilerplate_name``), is left out only if it holds
no article or main element (one that is not itself in such a container, if there is any) and, on a page that has none of these with text, is not on the
path to the densest node of the whole page. Headings, paragraphs and sections inside an article are not left out by such names. But any element whose
whole name says comments, adverts or notices is left out, inside articles too, unless an article element that is in no such container is in it; its density never counts.

For every node left, the characters per tag, adjusted for links, give its density (``composite``); the sum over its
children its density sum. The node of the largest sum is the core; the least density on its path to the body is the
threshold; every subtree that reaches it adds its own node of largest sum, and the smallest subtree over all of these
is selected. A short heading is not dense, nor is a short paragraph, so the subtree takes in what its author bound it to: the article or main
element around it, or else a parent that adds nothing but headings and paragraphs that are not mostly links.

Defined results: null or empty html, or a page without text, gives an empty text; a page without a
body element counts as its own body; broken or unclosed markup is closed as browsers do, in short;
ties go to the earlier node; repeated rows give repeated results; extra columns are dropped; an empty
table gives an empty result. One narrow map over the pages, linear in the length of a page.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import portions, table

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|</?([a-zA-Z][^\s/>]*)[^>]*>|<[!?/][^>]*>?""", re.S)
#: Attributes one after another, so a name inside another one's value is not read as a name.
_ATTR = re.compile(r"""([^\s/>=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
#: Elements that start and end a block of text.
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
#: A start tag of the key closes the open elements named, if they are nearer than the walls.
_CLOSES = {k: (frozenset(v.split()), frozenset(w.split())) for keys, v, w in (
    ("li", "li", "ul ol menu"), ("dt dd", "dt dd", "dl"), ("tr", "tr td th", "table"), ("td th", "td th", "tr table"),
    ("thead tbody tfoot", "thead tbody tfoot tr td th", "table"), ("option optgroup", "option", "select"),
) for k in keys.split()}
_ENDS_P = _BLOCK - {"li", "dd", "dt", "td", "th", "tr", "tbody", "thead", "tfoot", "body", "html", "option", "optgroup", "legend", "caption"}
_P_WALLS = frozenset("article aside blockquote body button caption dd details div dl dt fieldset figcaption figure footer form header html li main nav ol section table td th tr ul".split())

#: Never article text.
_OUT = frozenset("script style noscript template iframe object embed svg canvas audio video nav footer aside button select textarea input label dialog menu search head title noembed noframes".split())
#: Left out unless they hold the article: forms, and of these containers those with a name of _OUT_WORDS; the last two only outside articles.
_FORMS = frozenset("form fieldset".split())
_NAMED = frozenset("div ul ol dl table center figure details section article".split())
_OUT_WORDS = frozenset(
    "nav navbar navigation menu menubar footer sidebar aside ad ads advert adverts advertisement advertising adsbygoogle banner promo promotion sponsor sponsored "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login signin search share sharing social "
    "related recommended recommendations breadcrumb breadcrumbs pagination pager comment comments commentlist disqus respond replies discussion complementary contentinfo "
    "toolbar widget masthead copyright disclaimer paywall skip".split()
)
#: Of these the ones that say comments, adverts and notices: left out on any element.
_STRONG_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsbygoogle promo promotion sponsor sponsored cookie cookies consent gdpr banner notice notices "
    "comment comments commentlist disqus respond replies paywall taboola outbrain".split()
)
#: On paragraphs, headings and sections these may be part of what the article says.
_VAGUE_WORDS = frozenset("notice notices respond replies".split())
#: May stand beside such a word in a name, as in main-menu or comment-list.
_BESIDE = frozenset(
    "site page main post article entry top bottom left right box bar list area block container wrapper wrap inner outer section panel slot unit module group item items links buttons form "
    "reader readers user users visitor visitors customer guest google facebook fb eu cc content body text thread native inline sticky mobile desktop".split()
)
_ARTICLES = frozenset("article main".split())
_PROSE = frozenset("p blockquote figure pre".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup header".split())


class Node:
    __slots__ = ("tag", "parent", "parts", "out", "inside", "chars", "tags", "links", "link_tags", "density", "total", "kids", "doubtful", "named", "strong")

    def __init__(self, tag: str, parent: Node | None, out: bool):
        self.tag, self.parent, self.out = tag, parent, out
        self.inside = parent is not None and (parent.inside or parent.tag in _ARTICLES)  # of an article
        self.doubtful = False  # left out unless it holds the article
        self.named = parent is not None and parent.named  # in a container named as boilerplate
        self.strong = parent is not None and parent.strong  # in one named as comments, adverts or notices
        self.parts: list = []  # texts and nodes, in page order
        self.chars = self.tags = self.links = self.link_tags = 0
        self.density = self.total = 0.0
        self.kids: list[Node] = []


def attributes(text: str) -> dict[str, str]:
    """The attributes of a tag, names in lower case; of repeated ones the first counts."""
    out: dict[str, str] = {}
    for m in _ATTR.finditer(text):
        out.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
    return out


def boilerplate_name(name: str, words: frozenset[str] = _OUT_WORDS) -> bool:
    """Whether a whole class, id or role says boilerplate: one of its words is in ``words``, and the others say it too or are words like box and list."""
    found = [w.lower() for w in _WORD.findall(name) if not w.isdigit()]
    return any(w in words for w in found) and all(w in _OUT_WORDS or w in words or w in _BESIDE for w in found)


def _left_out(tag: str, attrs: dict[str, str], parent: Node) -> bool:
    if parent.out or tag in _OUT:
        return True
    if tag == "header" or parent.tag == "header":  # an article's own header keeps its headings
        inside = parent.inside or parent.tag in _ARTICLES
        if not inside or tag not in _HEADINGS and tag != "div":
            return True
    return "hidden" in attrs and tag not in ("body", "html", "article", "main")


def _named(tag: str, attrs: dict[str, str], node: Node) -> bool:
    """Whether a container is named as boilerplate."""
    if not attrs or tag not in _NAMED or node.inside and tag in ("section", "article"):
        return False
    return any(boilerplate_name(name) for name in _names(attrs))


def _names(attrs: dict[str, str]) -> Iterator[str]:
    return (name for key in ("class", "id", "role") for name in attrs.get(key, "").split())


def _strongly_named(tag: str, attrs: dict[str, str]) -> bool:
    """Whether an element of any kind but the page and its main part is named as comments, adverts or notices; one that is no container by more than the word notice."""
    words = _STRONG_WORDS if tag in _NAMED and tag != "section" else _STRONG_WORDS - _VAGUE_WORDS
    return bool(attrs) and tag not in ("html", "body", "main") and any(boilerplate_name(name, words) for name in _names(attrs))


def parse(html: str) -> Node:
    """The tree of a page; texts are decoded."""
    root = Node("#root", None, False)
    top, at, end, opened = root, 0, len(html), Counter()

    def close(upto: Node) -> Node:
        """End the open elements up to and including one; its parent is open then."""
        x = top
        while x is not upto:
            opened[x.tag] -= 1
            x = x.parent
        opened[x.tag] -= 1
        return x.parent

    while at < end:
        m = _TOKEN.search(html, at)
        if m is None:
            top.parts.append(unescape(html[at:]))
            break
        if m.start() > at:
            top.parts.append(unescape(html[at : m.start()]))
        at, tag = m.end(), (m[2] or m[4] or "").lower()
        if not tag:
            continue
        if m[1] or html.startswith("</", m.start()):
            if opened[tag] and tag not in ("body", "html"):
                up = top
                while up.tag != tag:
                    up = up.parent
                top = close(up)
            continue
        closes, walls = _CLOSES.get(tag, ((), ()))
        if tag in _ENDS_P:
            closes, walls = ("p",), _P_WALLS
        if any(opened[x] for x in closes):
            up = top
            while up is not root and up.tag not in walls and up.tag not in closes:
                up = up.parent
            if up.tag in closes:
                top = close(up)
        if tag in ("body", "html") and opened[tag]:
            continue
        attrs = attributes(m[3]) if m[3] else {}
        node = Node(tag, top, _left_out(tag, attrs, top))
        if not node.out:
            strong = _strongly_named(tag, attrs)
            own = strong or _named(tag, attrs, node)
            node.doubtful, node.named, node.strong = own or tag in _FORMS, own or node.named, strong or node.strong
        top.parts.append(node)
        if tag in _RAW:
            stop = re.compile(f"</{re.escape(tag)}(?=[\\s/>])[^>]*>?", re.I).search(html, at)
            at = stop.end() if stop else end
        elif tag not in _VOID and (not (m[3] or "").endswith("/") or tag in ("p", "div", "span", "a", "b", "i")):
            top = node
            opened[tag] += 1
    return root


def _path(node: Node | None) -> Iterator[Node]:
    while node is not None:
        yield node
        node = node.parent


def _measure(root: Node) -> list[Node]:
    """Counts of every node that is kept, children before parents; returns the nodes in page order."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        node.kids = [x for x in node.parts if isinstance(x, Node) and not x.out]
        todo += reversed(node.kids)
    for node in reversed(order):
        node.chars = sum(len(" ".join(x.split())) for x in node.parts if isinstance(x, str)) + sum(x.chars for x in node.kids)
        node.tags = sum(x.tags + 1 for x in node.kids)
        if node.tag == "a":
            node.links, node.link_tags = node.chars, 1
        else:
            node.links, node.link_tags = sum(x.links for x in node.kids), sum(x.link_tags for x in node.kids)
    return order


def composite(chars: int, tags: int, links: int, link_tags: int, share: float) -> float:
    """Composite text density: C / T * log_b(C / LC * T / LT), with b = ln(C / (C - LC) * LC + share * C + e).

    ``links`` are characters and ``link_tags`` tags of links, ``share`` is that of link characters in the body. Counts
    below one count as one. Where b is less than e it is e, since on a page without links it would go to 1;
    a node with more link tags and characters than its own has density 0.
    """
    if not chars:
        return 0.0
    t, lc, lt = max(1, tags), max(1, links), max(1, link_tags)
    b = max(e, log(chars / max(1, chars - links) * links + share * chars + e))
    return chars / t * max(0.0, log(chars * t / (lc * lt)) / log(b))


def _weigh(order: list[Node], body: Node) -> None:
    """Composite density of every node, and the sum over its children (a leaf: its own)."""
    share = body.links / max(1, body.chars)
    for node in order:
        node.density = composite(node.chars, node.tags, node.links, node.link_tags, share)
    for node in order:
        node.total = sum(x.density for x in node.kids) if node.kids else node.density


def _plain_total(node: Node) -> float:
    """The density sum without children named as comments, adverts or notices."""
    kids = [x for x in node.kids if not x.strong]
    return sum(x.density for x in kids) if kids else node.density if not node.kids else 0.0


def _leave_out(order: list[Node], body: Node) -> None:
    """Mark as left out what is doubtful and does not hold the article."""
    articles = [x for x in order if x.tag in _ARTICLES and x.chars]
    held = [x for x in articles if not x.named] or [x for x in articles if not x.strong]
    if not held:  # the densest, of what is not named as comments, adverts or notices
        plain = [x for x in order if not x.strong and x.chars > sum(y.chars for y in x.kids if y.strong)]
        inner = {id(y) for x in plain for y in x.kids if not y.strong}
        leaves = [x for x in plain if id(x) in inner] or plain
        held = [max(leaves, key=_plain_total)] if leaves else articles
    stay: set[int] = set()
    for node in held:
        for x in _upto(node, body):
            if id(x) in stay:
                break
            stay.add(id(x))
    for node in order:
        if node.doubtful and id(node) not in stay:
            node.out = True


def select(root: Node) -> Node | None:
    """The smallest subtree over the core and all parts that reach the threshold, with its headings; None without text."""
    body = next((x for x in _walk(root) if x.tag == "body"), root)
    order = _measure(body)
    if not body.chars:
        return None
    _weigh(order, body)
    if any(x.doubtful for x in order):
        _leave_out(order, body)
        order = _measure(body)
        if not body.chars:
            return None
        _weigh(order, body)
    core = max(order, key=lambda x: x.total)  # the first of equals
    threshold = min(x.density for x in _upto(core, body))
    best: dict[int, Node] = {}
    for node in reversed(order):
        best[id(node)] = max([node, *(best[id(x)] for x in node.kids)], key=lambda x: x.total)
    marked, todo = {id(core)}, [body]
    while todo:
        node = todo.pop()
        if node.density >= threshold - 1e-9 and node is not core:
            marked.add(id(best[id(node)]))
            todo += node.kids
    below: dict[int, int] = {}
    for node in reversed(order):
        below[id(node)] = (id(node) in marked) + sum(below[id(x)] for x in node.kids)
    over = body
    while id(over) not in marked:
        held = [x for x in over.kids if below[id(x)] == len(marked)]
        if not held:
            break
        over = held[0]
    return _with_headings(over, body)


def _with_headings(node: Node, body: Node) -> Node:
    """The article or main element around a selected node; without one, the highest parent that adds headings and paragraphs only."""
    for x in _upto(node, body):
        if x.tag in _ARTICLES:
            return x
    while node is not body and node.parent is not None and _only_prose_beside(node):
        node = node.parent
    return node


def _only_prose_beside(node: Node) -> bool:
    beside = [x for x in node.parent.parts if x is not node and (x.strip() if isinstance(x, str) else not x.out and x.chars)]
    return bool(beside) and all(not isinstance(x, str) and (x.tag in _HEADINGS or x.tag in _PROSE and 3 * x.links < x.chars) for x in beside)


def _walk(root: Node) -> Iterator[Node]:
    todo = [root]
    while todo:
        node = todo.pop()
        yield node
        todo += [x for x in reversed(node.parts) if isinstance(x, Node) and not x.out]


def _upto(node: Node, body: Node) -> Iterator[Node]:
    for x in _path(node):
        yield x
        if x is body:
            return


def extract(html: str | None) -> str:
    """The main text of a page: blocks joined by two line ends."""
    if not html:
        return ""
    top = select(parse(html))
    if top is None:
        return ""
    blocks, run = [], []

    def flush() -> None:
        text = " ".join("".join(run).split())
        if text:
            blocks.append(text)
        run.clear()

    todo: list = [top]
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            run.append(x)
        elif x.out:
            run.append(" " if x.tag not in _BLOCK else "")
            if x.tag in _BLOCK:
                flush()
        elif x.tag in ("br", "wbr", "img"):
            run.append("" if x.tag == "wbr" else " ")
        else:
            if x.tag in _BLOCK:
                flush()
                todo.append(None)
            todo += reversed(x.parts)
    flush()
    return "\n\n".join(blocks)


def extract_pages(df: DataFrame, id_cols: tuple[str, ...] = ("page_id", "url"), html_col: str = "html") -> DataFrame:
    """(ids, text, n_chars): the main text of every whole page."""
    own = df.select(*map(F.col, id_cols), F.col(html_col))
    out = T.StructType([*own.schema[:-1], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for whole in batches for x in portions(whole, whole.num_columns - 1)):
            texts = [extract(h) for h in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=out.names)

    return own.mapInArrow(run, out).withColumn("n_chars", F.length("text").cast("long"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: the main text of every page."""
    return extract_pages(table(spark, sf_dir, "pages"))
