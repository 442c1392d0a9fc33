"""Main text of web pages by tree scoring.

The page is read into a tree, in time linear in its length.  Every paragraph passes points for its length and its commas to
its ancestors, half of them with each step up; a container's points are discounted by the share of
its text that stands in links.  The container with most points, or all that are marked as articles, and
what stands around them without being mostly links are the article, whatever its length; menus, forms,
notices and the like are left out.

What a class or id calls a notice, a menu or related is taken for one outside the container, and inside it only if it is mostly links:
authors name sections so.  Reader comments inside are told by their build: items alike, by named people, beside a longer text.
"""

from __future__ import annotations

import bisect
import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of HTML: elements without content, those whose content is not markup, those that end a block.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noframes xmp template".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th"
    " thead tr ul caption".split()
)
#: Start tags that end an open element of the first kind, as far up as the second kind.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}), "tbody": ({"tbody", "thead", "tr", "td", "th"}, {"table"}), "body": ({"head"}, {"html"}),
}
_ENDS_P = BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "body", "html", "caption", "legend", "summary"}
#: Elements that never hold text of the article.
DROPPED = frozenset(
    "head script style noscript template iframe object embed svg canvas audio video map nav header footer aside form"
    " button select option textarea input label fieldset dialog menu search title noframes xmp".split()
)
#: Words in a class, id or role that mark what is beside the article wherever it stands.
_BESIDE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|cookies?|gdpr|popup|modal|newsletter|subscri\w*|paywall|navbar|breadcrumbs?|pagination|pager"
    r"|sidebar|masthead|toolbar|comments?|commentlist|disqus|respond|login|signup|complementary|contentinfo|hidden)(?:$|[\s_-])",
    re.I,
)
#: Those that do so outside the article only, or where they hold mostly links.
_SUSPECT = re.compile(
    r"(?:^|[\s_-])(?:banner|consent|notices?|alert|overlay|nav|navigation|menu|toc|side|aside|footer|header|discussion|replies|reviews?"
    r"|social|share|sharing|related|recommended|widget|search|copyright|legal|disclaimer)(?:$|[\s_-])",
    re.I,
)
#: Those that name a person who writes.
_PERSON = re.compile(r"(?:^|[\s_-])(?:author|avatar|commenter|nick|nickname|poster|reply|users?|username)(?:$|[\s_-])", re.I)
_HEADINGS = frozenset(("h1", "h2", "h3"))
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|rel|itemprop|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"?|'[^']*'?|[^\s>]+))?", re.I)
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    __slots__ = ("tag", "parent", "children", "beside", "suspect", "person", "kind", "points", "text", "linked", "speaks", "headed")

    def __init__(self, tag: str, parent: Node | None, attributes: str = ""):
        self.tag, self.parent = tag, parent
        self.children: list[Node | str] = []
        self.points, self.text, self.linked = 0.0, 0, 0
        self.speaks = self.headed = False
        self.beside, self.suspect, self.person, self.kind = tag in DROPPED, False, False, ""
        for name, value in _ATTRIBUTE.findall(attributes):
            self._note(name.lower(), html.unescape(value.strip("\"'")))

    def _note(self, name: str, value: str) -> None:
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and _UNSEEN.search(value)):
            self.beside = True
        if name == "class":
            self.kind = value
        if name in ("class", "id", "role") and self.tag not in ("html", "body", "article", "main"):
            self.beside = self.beside or bool(_BESIDE.search(value))
            self.suspect = self.suspect or bool(_SUSPECT.search(value))
        if name in ("class", "id", "rel", "itemprop"):
            self.person = self.person or bool(_PERSON.search(value))

    def inner(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node) and not c.beside]


class _Open:
    """The open elements of a page, with the depths of each tag, so that no tag has to be looked for."""

    def __init__(self, root: Node):
        self.line, self.depths, self.blocks = [root], {}, [0]

    def last(self, tags) -> int:
        """The depth of the innermost of ``tags`` that is open; 0 if none is."""
        return max((d[-1] for t in tags if (d := self.depths.get(t))), default=0)

    def push(self, node: Node) -> None:
        self.depths.setdefault(node.tag, []).append(len(self.line))
        if node.tag in BLOCK:
            self.blocks.append(len(self.line))
        self.line.append(node)

    def close(self, depth: int) -> None:
        """End the element at ``depth`` and all inside it."""
        while len(self.line) > depth:
            node = self.line.pop()
            self.depths[node.tag].pop()
            if node.tag in BLOCK:
                self.blocks.pop()

    def end(self, tag: str) -> None:
        depth = self.last((tag,))
        # An end tag inside a cell or block does not close what is around it.
        if depth and (tag in BLOCK or depth > self.blocks[-1]):
            self.close(depth)

    def close_for(self, tag: str) -> None:
        """End what a start tag ends without an end tag."""
        kinds, limits = _CLOSES.get(tag, ((), ()))
        if tag in _ENDS_P:
            kinds, limits = {*kinds, "p"}, {*limits, "td", "th", "li", "table", "button"} - set(kinds)
        if self.last(kinds):
            limit = self.last(limits)
            above = [d[bisect.bisect_right(d, limit)] for k in kinds if (d := self.depths.get(k)) and d[-1] > limit]
            if above:
                self.close(min(above))


def parse(page: str) -> Node:
    """A tree of ``page``; end tags that are missing or have no start are taken as browsers take them."""
    root = Node("#root", None)
    opened = _Open(root)
    at = 0
    while at < len(page):
        found = _TOKEN.search(page, at)
        # A "<" that begins no tag is text.
        if text := page[at : found.start() if found else len(page)]:
            opened.line[-1].children.append(html.unescape(text))
        if not found:
            break
        at, tag = found.end(), (found[2] or "").lower()
        if not tag:
            continue
        if found[1]:
            opened.end(tag)
            continue
        opened.close_for(tag)
        child = Node(tag, opened.line[-1], found[3])
        child.parent.children.append(child)
        if tag in RAW:
            end = re.compile(f"</{re.escape(tag)}(?=[\\s/>])[^>]*(?:>|\\Z)", re.I).search(page, at)
            if text := page[at : end.start() if end else len(page)]:
                child.children.append(text)
            at = end.end() if end else len(page)
        elif tag not in VOID:
            opened.push(child)  # also after "<p/>": the slash means nothing on elements of HTML
    return root


def blocks(top: Node, left_out) -> list[tuple[str, Node]]:
    """Texts of the blocks below ``top`` in page order, white space as single spaces, with their elements.

    ``left_out`` tells of an element whether to pass over it.
    """
    found: list[tuple[str, Node]] = []
    held: list[str] = []

    def flush(owner: Node) -> None:
        if text := " ".join("".join(held).split()):
            found.append((text, owner))
        held.clear()

    todo: list[tuple[Node | str, Node, bool]] = [(top, top, False)]
    while todo:
        item, owner, closing = todo.pop()
        if isinstance(item, str):
            held.append(item)
        elif closing:
            flush(item)
        elif item is not top and left_out(item):
            if item.tag in BLOCK:
                flush(owner)
        else:
            inner = item if item.tag in BLOCK or item is top else owner
            if inner is item:
                flush(owner)
                todo.append((item, owner, True))
            elif item.tag == "br":
                held.append(" ")
            todo += [(child, inner, False) for child in reversed(item.children)]
    return found


def _in_order(root: Node, inner=Node.inner) -> list[Node]:
    """All elements below ``root`` and itself, parents first."""
    todo, order = [root], []
    while todo:
        node = todo.pop()
        order.append(node)
        todo += reversed(inner(node))
    return order


def _measure(order: list[Node]) -> None:
    """Text, linked text, and whether people and headings are in it, of all elements."""
    for node in reversed(order):
        kids = node.inner()
        node.text = sum(len(c.strip()) for c in node.children if isinstance(c, str)) + sum(c.text for c in kids)
        node.linked = node.text if node.tag == "a" else sum(c.linked for c in kids)
        node.speaks = node.person or any(c.speaks for c in kids)
        node.headed = node.tag in _HEADINGS or any(c.headed for c in kids)


def _density(node: Node) -> float:
    return node.linked / node.text if node.text else 0.0


def _score(root: Node, left_out) -> None:
    """Points of all containers for the paragraphs that are not left out."""
    for text, owner in blocks(root, left_out):
        # A paragraph is worth something in itself, so that a page of very short ones has an article too.
        points = 1 + text.count(",") + min(len(text) / 100, 3)
        step, share = owner if owner.tag in ("div", "section", "article", "main", "body", "#root") else owner.parent, 1.0
        while step is not None and share > 0.05:
            step.points += points * share
            step, share = step.parent, share / 2


def _mark_threads(container: Node, order: list[Node]) -> None:
    """Take reader comments out of ``container``: items alike, by people, without headings, that are the lesser part of its text.

    Articles inside an article are such items by the rules of HTML, whoever wrote them.
    """
    for node in order:
        alike: dict[tuple[str, str], list[Node]] = {}
        for child in node.inner():
            if child.tag in ("div", "li", "article", "section", "blockquote", "tr", "dd") and not child.headed:
                alike.setdefault((child.tag, child.kind), []).append(child)
        for (tag, _), items in alike.items():
            nested = tag == "article" and container.tag == "article"
            by_people = len(items) > 1 and (node.person or all(i.speaks for i in items))
            if (nested or by_people) and 2 * sum(i.text for i in items) < container.text:
                for item in items:
                    item.beside = True


#: Text of which this share stands in links is not of the article, unless inside its container.
LINKED = 0.33


def main_text(page: str | None) -> str:
    """The article of a page, its blocks joined by two line feeds; empty where there is none."""
    root = parse(page or "")
    order = _in_order(root)
    _measure(order)
    _score(root, lambda n: n.beside or n.suspect)
    if not any(n.points for n in order):  # all of it stands in what looks like a menu
        _score(root, lambda n: n.beside)
    containers = [n for n in order if n.tag in BLOCK or n.parent is None]
    for node in containers:
        node.points *= 1 - _density(node)
    marked = [n for n in containers if n.tag in ("article", "main") and n.text]
    best = max(marked or containers, key=lambda n: n.points)
    if best.points <= 0:
        return ""
    whole, path, top = _outline(order, {n for n in marked if n is best or _density(n) < LINKED} or {best}, bool(marked))
    for container in whole:
        _mark_threads(container, _in_order(container))
    kept = _kept(top, whole, path, bool(marked))
    return "\n\n".join(text for text, owner in blocks(top, lambda n: n.beside or n not in kept) if kept[owner])


def _outline(order: list[Node], chosen: set[Node], marked: bool) -> tuple[set[Node], set[Node], Node]:
    """The chosen containers that are in no other one, the elements around them, and the one to read: the page, or,
    if containers are marked, the nearest around all of them; what is farther off is not of the article by the page's own word.
    """
    within: dict[Node, bool] = {}
    for node in order:
        within[node] = node.parent is not None and (within[node.parent] or node.parent in chosen)
    whole = {n for n in chosen if not within[n]}
    held = dict.fromkeys(order, 0)
    for node in reversed(order):
        held[node] += node in whole
        if node.parent is not None:
            held[node.parent] += held[node]
    path = {n for n in order if held[n] and n not in whole and not within[n]}
    top = order[0]
    if marked:
        top = next((n for n in reversed(order) if n in path and held[n] == len(whole)), top)
    return whole, path, top


def _kept(top: Node, whole: set[Node], path: set[Node], marked: bool) -> dict[Node, bool]:
    """For every element to look into, whether blocks of its own belong to the article."""
    kept: dict[Node, bool] = {}
    light: dict[Node, bool] = {}  # outside the containers: whether something on the way from the path down is not mostly links
    inside: set[Node] = set()
    todo = [top]
    while todo:
        node = todo.pop()
        if node in path or (node is top and node not in whole):
            inline = [c for c in node.children if isinstance(c, str) or not (c.beside or c.tag in BLOCK)]
            text = sum(len(c.strip()) if isinstance(c, str) else c.text for c in inline)
            kept[node] = sum(c.linked for c in inline if not isinstance(c, str)) < LINKED * text
        elif node in whole or node.parent in inside:
            listed = node.tag in ("ul", "ol", "dl", "table") and _density(node) > 0.8
            # Lists of links are references in what the page marks as its article, elsewhere they are menus.
            if node not in whole and (node.suspect and _density(node) >= LINKED or listed and not marked):
                continue
            inside.add(node)
            kept[node] = True
        else:
            if node.suspect or node.tag in ("ul", "ol", "dl", "table") and _density(node) > 0.8:
                continue
            kept[node] = light[node] = light.get(node.parent, False) or _density(node) < LINKED
        todo += node.inner()
    return kept


def _extract(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for frame in frames:
        texts = [main_text(page.as_py()) for page in frame.column(0)]
        lengths = pa.array([len(t) for t in texts], pa.int64())
        names = [*frame.schema.names[1:], "text", "n_chars"]
        yield pa.RecordBatch.from_arrays([*frame.columns[1:], pa.array(texts, pa.string()), lengths], names)


def extract(pages: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep`` of ``pages`` with ``text`` and ``n_chars`` of the whole ``html`` of every row.

    Null and empty pages, and pages without text outside menus and the like, have the empty text.
    Repeated rows come back repeated; ``keep`` may hold any column but one called ``text`` or ``n_chars``.
    """
    rows = pages.select(F.col("html").cast("string").alias("_html"), *keep)
    kinds = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:]), "text string, n_chars bigint"])
    return rows.mapInArrow(_extract, kinds)
