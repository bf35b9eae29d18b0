"""Main text of web pages by composite text density.

The page is parsed into a tree, and elements that never show text of the page's own
(scripts, styles, forms, hidden parts) go.  Every node gets its composite text density:
characters per tag, times a logarithm of its characters per linked character and tags
per link, whose base grows with the share of linked text.  The node with the greatest
sum of its children's densities holds the main text.

The least density on the path from it to the body is the threshold.  Walking up that
path, a part that stands beside it belongs to the text too if its density reaches the
threshold and its sum a share of the best one; so do headings before it.

A part whose tag, class, id or role says that it is a menu, header, footer, sidebar,
notice, advert or comment section counts as all linked: its density is nothing.  And a sum inside an ``article`` element counts
ARTICLE times.  So names settle what densities can't, such as comments longer than the
article; pages without any such name are judged by density alone.

Formatting elements (``b``, ``br`` and the like) are part of their text, not tags.
Text is joined as a reader sees it: character references decoded, white space in a
block one space, blocks joined by one space.

Edge cases: null and empty pages and pages without text give an empty text; an empty
table gives an empty one; unclosed and stray tags are repaired as browsers do for the
common cases; a comment or tag that never ends runs to the page's end; ties in the sum
go to the first node of the page; repeated rows give repeated results; long and deep
pages take time in proportion to their length; other columns play no part.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from marginalia.llm.common import small_batches, table

# Element names by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
GONE = frozenset("head script style noscript template iframe svg math canvas object select button textarea form dialog title audio video map".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
SAME = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "thead": ({"tbody", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"})}
# Words in a class, id or role that name what isn't main text, or is.
ASIDE = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars side rail widget widgets footer foot header masthead topbar toolbar comment comments commentlist disqus reply replies respond discussion social share sharing related recommended newsletter subscribe subscription signup login popup modal overlay pagination pager tags copyright contentinfo complementary search hidden".split())
SIDES = frozenset("nav footer aside menu".split())
FRAMES = frozenset("html body main article".split())
COMMENTS = frozenset("comment comments commentlist disqus reply replies respond discussion".split())
HEADS = frozenset("header masthead topbar".split())
MAIN = frozenset("article main content post entry story body text".split())

TAG = re.compile(r"""<!--(?:.*?-->|.*)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)(?:>|$)|<[!?/][^>]*+(?:>|$)""", re.S)
NAMED = re.compile(r"""(?:^|\s)(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/]|$)""", re.I)
SPLIT = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")
SPACE = re.compile(r"\s+")
TITLE = re.compile("h[1-6]|hgroup|header")
#: A part beside the best subtree has this share of its sum at least, and at most this share of its text in links.
SHARE, LINKED = 0.2, 0.3
#: How often a sum inside an ``article`` counts; the share of a page's text that no part beside the main text has.
ARTICLE, WHOLE = 10, 0.95


class Node:
    __slots__ = ("tag", "parent", "kids", "marks", "chars", "tags", "link_chars", "link_tags", "density", "total", "holds", "framed", "aside")

    def __init__(self, tag: str, parent: Node | None, marks: frozenset) -> None:
        self.tag, self.parent, self.marks = tag, parent, marks
        self.kids: list[Node | str] = []
        self.framed: str | None = None  # the article or main element that it is or stands in
        self.aside = False


def marks_of(attributes: str) -> frozenset:
    """The words of class, id and role, in lower case; ``!hidden`` if the element isn't shown."""
    if not attributes.strip():
        return frozenset()
    out = set()
    for name, a, b, c in NAMED.findall(attributes):
        name, value = name.lower(), a or b or c
        if name in ("class", "id", "role"):
            out.update(w.lower() for w in SPLIT.split(value) if w)
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            out.add("!hidden")
    return frozenset(out)


class Open:
    """The open elements, with their places by tag, so that closing one never walks the tree."""

    def __init__(self, root: Node) -> None:
        self.path, self.places, self.walls = [root], {}, [0]

    def last(self, tag: str) -> int:
        """The place of the innermost open element of that tag, 0 if there is none."""
        found = self.places.get(tag)
        return found[-1] if found else 0

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.path))
        if node.tag not in INLINE and node.tag != "p":
            self.walls.append(len(self.path))
        self.path.append(node)

    def cut(self, place: int) -> None:
        """Close the element at ``place`` and all inside it."""
        while len(self.path) > place > 0:
            tag = self.path.pop().tag
            self.places[tag].pop()
            if self.walls[-1] == len(self.path):
                self.walls.pop()

    def make_way(self, tag: str) -> None:
        """Close what can't hold a new element of that tag."""
        if tag in CLOSES_P and self.last("p") > self.walls[-1]:
            self.cut(self.last("p"))
        if tag in SAME:
            ends, stops = SAME[tag]
            stop = max(map(self.last, stops))
            inner = [places[i] for e in ends if (places := self.places.get(e)) and (i := bisect_right(places, stop)) < len(places)]
            if inner:
                self.cut(min(inner))


def parse(page: str) -> Node:
    """The tree below a root; text nodes are decoded strings."""
    root = Node("#root", None, frozenset())
    at, path = 0, Open(root)

    def text(upto: int) -> None:
        if upto > at:
            s = page[at:upto]
            path.path[-1].kids.append(unescape(s) if "&" in s else s)

    while m := TAG.search(page, at):
        text(m.start())
        at = m.end()
        closing, tag = m[1] or m[4], (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if closing:
            path.cut(path.last(tag))
            continue
        path.make_way(tag)
        attributes = m[3] if m[2] else m[6]
        here = path.path[-1]
        node = Node(tag, here, marks_of(attributes or ""))
        here.kids.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            s = page[at : end.start() if end else len(page)]
            node.kids.append(unescape(s) if tag in ("title", "textarea") else s)
            at = end.end() if end else len(page)
        elif tag not in VOID and not (attributes or "").endswith("/"):
            path.push(node)
    text(len(page))
    return root


def length(s: str) -> int:
    return len(s) - s.count(" ") - s.count("\n") - s.count("\t") - s.count("\r")


def walk(root: Node) -> list[Node]:
    """The nodes of a subtree in page order."""
    order, todo = [], [root]
    while todo:
        n = todo.pop()
        order.append(n)
        todo += [k for k in reversed(n.kids) if isinstance(k, Node)]
    return order


def prune(root: Node) -> None:
    """Take out what never is text of the page."""
    for n in walk(root):
        n.kids = [" " if isinstance(k, Node) and (k.tag in GONE or "!hidden" in k.marks) else k for k in n.kids]


def weigh(root: Node, names: bool = True) -> list[Node]:
    """Count characters and tags of every node, without those marked aside; nodes in page order."""
    order = walk(root)
    for n in order:
        own = n.tag if names and n.tag in ("article", "main") else None
        n.framed = "article" if own == "article" else n.parent.framed or own if n is not root else own
    for n in reversed(order):
        n.chars = n.tags = n.link_chars = n.link_tags = 0
        n.holds = {"article": 1, "main": 1, "h1": 2}.get(n.tag, 0)
        for k in n.kids:
            if isinstance(k, str):
                n.chars += length(k)
                continue
            n.holds |= k.holds
            if not k.aside:
                n.chars += k.chars
                n.tags += k.tags + (k.tag not in INLINE or k.tag == "a")
                n.link_chars += k.chars if k.tag == "a" else k.link_chars
                n.link_tags += k.link_tags + (k.tag == "a")
    return order


def beside(order: list[Node], body: Node) -> None:
    """Mark as ``aside`` the nodes that say they aren't main text, and all in them.

    A part that holds the article, or WHOLE of the page's text, can't be beside it,
    whatever its name; a header inside the article holds its title.
    """
    for n in order:
        n.aside = n is not body and n.parent is not None and n.parent.aside
        if n.aside or n is body or n.tag in FRAMES and not n.marks & COMMENTS:
            continue
        named = n.marks & ASIDE
        if named and n.marks & MAIN and not named & COMMENTS:
            named = frozenset()  # as in "content-header"
        within = n.framed is not None
        top = not within and bool(n.tag == "header" or named & HEADS)
        title = n.tag == "header" or bool(named) and named <= HEADS
        told = top or n.tag in SIDES or named and not (within and title)
        frame = 1 if top or n.tag in SIDES or named & COMMENTS else 3
        n.aside = bool(told) and not (n.holds & frame or n.chars > WHOLE * body.chars)


def density(chars: int, tags: int, link_chars: int, link_tags: int, share: float) -> float:
    """Composite text density; ``share`` is that of linked characters in the body.

    The logarithm takes one more than the ratio, so that a single letter has a density,
    and the base's logarithm is 1 at least: with next to no links on a page the density
    of long and short texts would else be alike.
    """
    if not chars:
        return 0.0
    tags, links, linked, plain = max(1, tags), max(1, link_tags), max(1, link_chars), max(1, chars - link_chars)
    base = math.log(math.log(chars / plain * link_chars + share * chars + math.e))
    return chars / tags * math.log(1 + chars / linked * tags / links) / max(1.0, base)


def densities(order: list[Node], body: Node) -> None:
    """Density of each node, and the sum over its children; a node without children is its own sum."""
    share = body.link_chars / max(1, body.chars)
    for n in reversed(order):
        n.density = density(n.chars, n.tags, n.link_chars, n.link_tags, share)
        kids = [k for k in n.kids if isinstance(k, Node) and k.tag not in INLINE and not k.aside]
        n.total = (sum(k.density for k in kids) if kids else n.density) * (ARTICLE if n.framed == "article" else 1)


def main_node(root: Node, names: bool = True) -> Node | None:
    """The subtree of the greatest density sum, widened along its path to what belongs to it; none without text."""
    body = next((n for n in walk(root) if n.tag == "body"), root)
    inside = weigh(body, names)
    if names:
        beside(inside, body)
        inside = [n for n in weigh(body) if not n.aside]
    densities(inside, body)
    blocks = [n for n in inside if n.tag not in INLINE and n.total > 0]
    if not blocks:
        return None
    best = max(blocks, key=lambda n: n.total)
    path = [best]
    while path[-1] is not body:
        path.append(path[-1].parent)
    threshold, least = min(n.density for n in path), SHARE * best.total
    articles = best.framed == "article"  # then only another article can belong to it
    share = body.link_chars / max(1, body.chars)
    for child, up in zip(path, path[1:]):
        framed, seen, kept = up.framed == "article", False, []
        for k in up.kids:
            seen |= k is child
            if isinstance(k, str):
                n = length(k)
                d = density(n, 1, 0, 0, share)
                good = not n or d >= threshold and d >= least and not articles
            else:
                reaches = not k.aside and (k.framed == "article" or not articles) and k.density >= threshold and k.total >= least and k.link_chars <= LINKED * k.chars
                good = reaches or not (k.aside or seen) and TITLE.fullmatch(k.tag) is not None
            if k is child or good or framed:
                kept.append(k)
        up.kids = kept
    return path[-1]


def linked(n: Node) -> bool:
    """A block that is little more than links, as menus without a name are."""
    return n.link_tags >= 3 and n.link_chars > 0.7 * n.chars and n.tag not in INLINE


def text_of(top: Node) -> str:
    out: list[str] = []
    todo: list[Node | str] = [top]
    while todo:
        k = todo.pop()
        if isinstance(k, str):
            out.append(k)
        elif k.aside:
            out.append(" ")
        elif k.tag in INLINE:
            todo += reversed(k.kids)
        elif k is top or k.framed or k.tag == "body" or not linked(k):
            out.append(" ")
            todo += [" ", *reversed(k.kids)]
        else:
            out.append(" ")
    return SPACE.sub(" ", "".join(out)).strip()


def main_text(page: str | None, names: bool = True) -> str:
    """The main text; without ``names`` tags, classes, ids and roles tell nothing and density alone decides."""
    if not page:
        return ""
    root = parse(page)
    prune(root)
    best = main_node(root, names)
    return "" if best is None else text_of(best)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""
    out = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches):
        for b in batches:
            texts = [main_text(h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], schema=out)

    small_batches(pages.sparkSession)
    return pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), pages[html_col].alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
