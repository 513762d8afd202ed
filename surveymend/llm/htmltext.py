"""Main text of web pages by composite text density over every DOM node.

A page becomes a tree; what is never read (scripts, styles, controls, media) is left out. Every node's density is its
characters for each tag, lowered by link characters and link tags; a node's sum is that of the densities of its blocks,
runs of inline content counting as blocks. The subtree of the largest sum is the best one, and the least density on the
path from it to the body is the threshold.

* Elements, roles and names are evidence, which weighs densities and never decides alone: a navigation or a part called
  ``comments`` counts a small share of its density, an article twice its own. A name counts if all its words speak of
  layout: ``ad-slot`` does, ``ad-hoc-networks`` doesn't.
* The content begins with the best subtree and grows to the outermost part around it whose weighed density is at least
  ``GROW`` of the best one's. Parts after it belong to it if they reach ``NEAR`` of the threshold, where text that is bare
  in a box, as none of the content's is, counts little; parts before it, if they are articles, or have ``LIKE`` of its sum; also the heading that repeats the
  page's title, with blocks between that reach the threshold. In a page without inner structure, what stands before that
  heading is left out.
* Inside the content, parts with evidence against them are left out if their weighed density is below the threshold, and
  so are lists and sections of mostly links whose entries are as short as menus' (``MENU``). Nothing else is.

Null and empty pages, and pages without text, give an empty text. Of equal sums, the first in page order, which is the
outermost, is chosen. Repeated rows give repeated results, an empty table none, and other columns are ignored. Long, wide
and deep pages are read whole, in time proportional to their length.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, out_batch, ready

#: Comments; tags with well-formed attributes, or else up to the next >; declarations; text.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(/?)([A-Za-z][A-Za-z0-9:-]*+)((?:\s*+(?:/|[^\s\"'<>/=]++(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s\"'<>]++))?+))*+\s*+(?=>)|[^>]*+)(?:>|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)|[^<]++|<",
    re.DOTALL,
)
_NAMED = re.compile(r"(?:^|[\s\"'])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
# Element names by what they mean here (fixed values of the markup language).
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe svg math xmp noembed noframes".split())
_DROP = _RAW | frozenset("head button select option datalist object canvas audio video".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var br wbr img".split())
_ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul body".split())
_SELF = {"li": ("ul", "ol", "menu"), "dd": ("dl",), "dt": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_BOXES = frozenset("div section body html center main article header footer nav aside form".split())
_LISTS = frozenset("div section ul ol table dl".split())
# Words of names (fixed values): of parts that aren't content, of boxes that aren't, though paragraphs may be, of parts that
# may be, and of layout, which say nothing else.
_NOT = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promoted promotion breadcrumb breadcrumbs sidebar cookie cookies consent gdpr popup modal comment comments commentlist disqus newsletter signup subscribe pagination pager navbar navigation nav footer masthead".split())
_TOLD = frozenset("notice notices alert banner".split())
_MAYBE = _TOLD | frozenset("menu share sharing social respond skip login overlay discussion replies related recommended header topbar side aside search widget toolbar".split())
_LAYOUT = frozenset("list box bar area section wrap wrapper container block item items form panel row col column group holder slot unit module region link links icon icons button buttons thread title head body inner outer left right top bottom main primary secondary site page post posts article entry content global sticky fixed mobile desktop widget js ui wp".split())
#: What the density of a part counts: by its element, by a role or a sure name, and by a name that may mean anything.
_ELEMENTS = {"nav": 0.05, "footer": 0.05, "form": 0.1, "menu": 0.1, "dialog": 0.05, "header": 0.2, "aside": 0.2, "article": 2.0, "main": 1.25}
SURE, UNSURE = 0.05, 0.9
#: The share of the best density that content around it has; of the threshold that a part after it has; of the largest sum
#: that a part before it has; and characters for each link that menus have at most.
GROW, NEAR, LIKE, MENU = 0.9, 0.25, 0.25, 24
#: What the density of a part after the content counts if its text is bare and the content's isn't; and the share of the
#: threshold that parts of doubtful names have at least.
OTHER, DOUBT = 0.02, 0.5


class Node:
    __slots__ = ("tag", "parts", "parent", "block", "key", "drop", "own", "weight", "chars", "tags", "link_chars", "link_tags", "density", "total", "wide")

    def __init__(self, tag: str, parent: Node | None, drop: bool = False, own: float = 1.0):
        self.tag, self.parent, self.drop, self.own, self.parts = tag, parent, drop, own, []
        self.block = self if parent is None or tag not in _INLINE else parent.block
        # Inline elements are closed within their block.
        self.key = tag if self.block is self else (id(self.block), tag)
        self.weight = own if parent is None else own * parent.weight


def _speaks(name: str, tag: str) -> float:
    """What a class or id says: a name counts only if all its words are of layout, and it may be content if only a word of
    doubtful meaning stands alone."""
    words = [w for w in re.split(r"[^a-z0-9]+", name) if w and not w.isdigit()]
    told = [w for w in words if w in _NOT or w in _MAYBE]
    if not told or any(w not in _LAYOUT and w not in _NOT and w not in _MAYBE for w in words):
        return 1.0
    return SURE if len(words) > 1 or words[0] in _NOT or words[0] in _TOLD and tag != "p" else UNSURE


def _evidence(tag: str, attributes: str, opened: dict) -> float:
    """The weight of an element's density by its tag, role and names."""
    inside = opened.get("article", 0)
    out = _ELEMENTS.get(tag, 1.0)
    if tag == "aside" and inside or tag == "header" and (inside or opened.get("main", 0) or opened.get("section", 0)):
        out = 1.0
    if attributes and tag not in ("body", "main", "article"):
        for m in _NAMED.finditer(attributes):
            value = (m[2] or m[3] or m[4] or "").lower()
            if m[1].lower() == "role":
                out = min(out, SURE) if value.strip() in _ROLES else out
            else:
                out = min([out, *(_speaks(name, tag) for name in value.split())])
    return out


def tree(page: str) -> tuple[Node, str]:
    """The page's nodes and its title; elements left open are closed by their parents, by a new block (paragraphs) or a sibling (items)."""
    root = Node("html", None)
    at, pos, end, title = root, 0, len(page), ""
    opened: dict = {}
    scan = _TOKEN.match

    def close(upto: Node) -> Node:
        n = at
        while True:
            opened[n.key] -= 1
            if n is upto:
                return n.parent
            n = n.parent

    while pos < end:
        m = scan(page, pos)
        pos = m.end()
        tag = m[2]
        if tag is None:
            if page[m.start()] != "<" or m.end() - m.start() == 1:
                at.parts.append(m[0])
            continue
        tag = tag.lower()
        if m[1]:
            key = (id(at.block), tag) if tag in _INLINE else tag
            if opened.get(key, 0):
                up = at
                while up.key != key:
                    up = up.parent
                at = close(up)
            continue
        if tag == "html":
            continue
        if tag in _ENDS_P:
            if at.block.tag == "p":
                at = close(at.block)
        elif tag in _SELF and opened.get(tag, 0):
            up = at
            while up is not root and up.tag not in _SELF[tag]:
                if up.tag == tag:
                    at = close(up)
                    break
                up = up.parent
        node = Node(tag, at, at.drop or tag in _DROP, _evidence(tag, m[3], opened))
        at.parts.append(node)
        closed = m[3][-1:] == "/" and (len(m[3]) == 1 or m[3][-2] in " \t\n\r\"'")
        if tag in _VOID or closed:
            continue
        if tag in _RAW:
            ends = re.compile(rf"</{tag}\s*>", re.IGNORECASE).search(page, pos)
            if tag == "title" and not title:
                title = page[pos : ends.start() if ends else end]
            pos = ends.end() if ends else end
            continue
        opened[node.key] = opened.get(node.key, 0) + 1
        at = node
    return root, title


def _preorder(root: Node) -> list[Node]:
    out, todo = [], [root]
    while todo:
        n = todo.pop()
        if n.drop:
            continue
        out.append(n)
        todo.extend(x for x in reversed(n.parts) if not isinstance(x, str))
    return out


def composite(chars: int, tags: int, link_chars: int, link_tags: int, share: float) -> float:
    """Characters for each tag, lowered by links; share: link characters of the page for each of its characters."""
    if not chars:
        return 0.0
    base = chars / max(chars - link_chars, 1) * link_chars + share * chars + math.e
    return chars / max(tags, 1) * math.log(max(chars / max(link_chars, 1) * (max(tags, 1) / max(link_tags, 1)), 1.0) + 1) / math.log(base)


def _blocks(n: Node) -> Iterator[Node | list]:
    """Children that are or hold blocks, and runs of text and inline children that line breaks or those end."""
    run: list = []
    for x in n.parts:
        if isinstance(x, str):
            run.append(x)
        elif x.tag == "br" or not x.drop and x.wide:
            if run:
                yield run
                run = []
            if x.tag != "br":
                yield x
        elif not x.drop:
            run.append(x)
    if run:
        yield run


def measure(nodes: list[Node]) -> None:
    """Characters, tags, link characters, link tags, density and sum of nodes in preorder."""
    for n in reversed(nodes):
        n.chars = n.tags = n.link_chars = n.link_tags = 0
        # Inline elements that hold no block are no subtree of their own.
        n.wide = n.block is n and n.tag != "br"
        for x in n.parts:
            if isinstance(x, str):
                n.chars += len(x.strip())
            elif not x.drop:
                n.wide |= x.wide
                n.chars += x.chars
                n.tags += x.tags + 1
                n.link_chars += x.link_chars
                n.link_tags += x.link_tags
        if n.tag == "a":
            n.link_chars, n.link_tags = n.chars, n.link_tags + 1
    share = nodes[0].link_chars / max(nodes[0].chars, 1)
    for n in nodes:
        n.density = composite(n.chars, n.tags, n.link_chars, n.link_tags, share)
    for n in nodes:
        n.total = 0.0
        for b in _blocks(n):
            if isinstance(b, Node):
                n.total += b.weight * b.density
            else:
                inner = [x for x in b if not isinstance(x, str)]
                chars = sum(len(x.strip()) if isinstance(x, str) else x.chars for x in b)
                n.total += n.weight * composite(chars, sum(x.tags + 1 for x in inner), sum(x.link_chars for x in inner), sum(x.link_tags for x in inner), share)


def _path(n: Node | None) -> list[Node]:
    out = []
    while n is not None:
        out.append(n)
        n = n.parent
    return out


def _words(n: Node) -> str:
    out, todo = [], [n]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif not x.drop:
            todo.extend(reversed(x.parts))
    return " ".join(entities.unescape("".join(out)).split())


def _heading(nodes: list[Node], title: str) -> Node | None:
    """The heading that the title repeats most of, of equals the one of higher rank; else the first of first rank."""
    title = " ".join(entities.unescape(title).split()).lower()
    best, most, first = None, (0, 0), None
    for n in nodes:
        if n.tag in _HEADINGS and n.chars and n.weight >= UNSURE:
            said = _words(n).lower()
            if n.tag == "h1" and first is None:
                first = n
            like = (min(len(said), len(title)), -int(n.tag[1]))
            if title and (said in title or title in said) and like > most:
                best, most = n, like
    return best or first


def _fits(n: Node | str, threshold: float) -> bool:
    """A part without evidence against it that reaches the threshold and isn't mostly links."""
    return not isinstance(n, str) and not n.drop and n.own >= UNSURE and n.density >= threshold and n.link_chars * 2 <= n.chars


def _made_of(roots: list[Node]) -> dict[str, int]:
    """Characters of text by the element of the block that holds them."""
    out: dict[str, int] = {}
    todo = list(roots)
    while todo:
        n = todo.pop()
        for x in n.parts:
            if isinstance(x, str):
                if k := len(x.strip()):
                    out[n.block.tag] = out.get(n.block.tag, 0) + k
            elif not x.drop:
                todo.append(x)
    return out


def _alike(n: Node, kinds: dict[str, int]) -> bool:
    """Whether a part could go on with the text: most of its own stands in paragraphs, lists, tables or other blocks that say
    what they hold, or bare in boxes as some of the text does."""
    mine = _made_of([n])
    bare = sum(k for tag, k in mine.items() if tag in _BOXES and tag not in kinds)
    return 2 * bare <= sum(mine.values())


def _grown(best: Node) -> Node:
    """The outermost part around the best one that is nearly as dense, by what its own evidence says of it."""
    out = best
    for n in _path(best)[1:]:
        if out.tag == "body":
            break
        if n.density * n.own >= GROW * best.density:
            out = n
    return out


def _main_kinds(core: Node, heading: Node | None) -> dict[str, int]:
    """The kinds of blocks in the part of a page that holds its heading, or has the largest sum, and in parts like it."""
    parts = [x for x in core.parts if not isinstance(x, str) and not x.drop]
    way = _path(heading)
    best = next((x for x in parts if x in way), None) or max(parts, key=lambda x: x.total, default=core)
    if best.tag in _HEADINGS:
        best = max((x for x in parts if x.tag not in _HEADINGS), key=lambda x: x.total, default=best)
    leaf = not any(not isinstance(x, str) and not x.drop and x.wide for x in best.parts)
    return _made_of([x for x in parts if x.tag == best.tag] if leaf else [best])


def _stray(x: Node, kinds: dict[str, int], threshold: float) -> bool:
    """Whether a part's text is bare, as the content's isn't, and not dense enough all the same."""
    return bool(x.chars) and not _alike(x, kinds) and OTHER * x.density < threshold


def _begin(kinds: dict[str, int], way: list[Node], threshold: float) -> None:
    """In a page without inner structure, leave out what stands before its heading (``way`` leads from it to the content) and
    is less dense than some part behind it, or stray."""
    for up, child in zip(way[1:], way, strict=False):
        at = up.parts.index(child)
        behind = max((x.density for x in up.parts[at:] if not isinstance(x, str) and not x.drop), default=0.0)
        for x in up.parts[:at]:
            if not isinstance(x, str) and not x.drop and x.tag not in _INLINE and (x.density < min(behind, threshold) or x.density < behind and x.tag not in _BOXES or _stray(x, kinds, threshold)):
                x.drop = True


def _end(core: Node, kinds: dict[str, int], path: list[Node], threshold: float) -> None:
    """In such a page, leave out stray parts at its end."""
    for x in reversed(core.parts):
        if isinstance(x, str) and not x.strip() or not isinstance(x, str) and (x.drop or not x.chars):
            continue
        if isinstance(x, str) or x in path or not _stray(x, kinds, threshold):
            return
        x.drop = True


def content(root: Node, title: str) -> tuple[list[Node], Node, float]:
    """The subtrees to read in page order, the best one, and the threshold."""
    nodes = _preorder(root)
    measure(nodes)
    best = max((n for n in nodes if n.wide), key=lambda n: n.total)
    path = _path(best)
    threshold = min(n.density for n in path)
    core = _grown(best)
    path = path[path.index(core) :]
    heading = _heading(nodes, title)
    before: list[Node] = []
    if heading is not None:
        way = _path(heading)
        if core in way:
            if core.parent is None or core.tag == "body":
                _begin(_main_kinds(core, heading), way[: way.index(core) + 1], threshold)
        else:
            shared = next(n for n in path if n in set(way))
            mine, theirs = path[: path.index(shared)], way[: way.index(shared)]
            top = shared.parts
            a, b = top.index(theirs[-1]), top.index(mine[-1])
            if a < b:  # the heading comes first
                before = [heading]
                for up, child in zip(theirs[1:], theirs, strict=False):
                    before += [x for x in up.parts[up.parts.index(child) + 1 :] if _fits(x, threshold)]
                before += [x for x in top[a + 1 : b] if _fits(x, threshold)]
                for up, child in reversed(list(zip(mine[1:], mine, strict=False))):
                    before += [x for x in up.parts[: up.parts.index(child)] if _fits(x, threshold)]
    after: list[Node] = []
    kinds = _made_of([core])
    if core.parent is None or core.tag == "body":
        _end(core, _main_kinds(core, heading), path, threshold)
    else:
        row = core.parent.parts
        at = row.index(core)
        first = [x for x in row[:at] if _fits(x, threshold) and _alike(x, kinds) and (x.tag == core.tag == "article" or x.total >= LIKE * best.total)]
        before = before or first
        after = [x for x in row[at + 1 :] if _fits(x, 0.0) and x.chars and (x.density >= NEAR * threshold if _alike(x, kinds) else OTHER * x.density >= threshold)]
    return [*before, core, *after], best, threshold


def text_of(page: str | None) -> str:
    """The main text: blocks in page order, white space within and between them as one space."""
    if not page:
        return ""
    roots, best, threshold = content(*tree(page))
    kept = set(map(id, _path(best)))
    out: list[str] = []
    todo: list = [x for n in reversed(roots) for x in (n, " ")]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(entities.unescape(x) if "&" in x else x)
            continue
        if x.drop:
            continue
        block = x.tag not in _INLINE or x.tag == "br"
        if id(x) not in kept:
            if x.own < UNSURE:
                weak = x.own * x.density < threshold
            else:
                weak = x.own == UNSURE and x.tag != "p" and x.density < DOUBT * threshold
            if weak and x.tag not in _HEADINGS:
                continue
            # Only branches of blocks are weighed; a paragraph's own inline parts stay with it.
            if x.tag in _LISTS and x.link_chars * 2 > x.chars and x.density < threshold and x.chars <= MENU * x.link_tags:
                continue
        if block:
            out.append(" ")
            todo.append(" ")
        todo.extend(reversed(x.parts))
    return " ".join("".join(out).split())


_OUT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    ready(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [text_of(p) for p in batch.column("html").to_pylist()]
            yield out_batch(_OUT, {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": texts, "n_chars": [len(t) for t in texts]})

    return mapped(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html"), run, "page_id long, url string, text string, n_chars long")
