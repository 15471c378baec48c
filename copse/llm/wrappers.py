"""Main text of web pages through wrappers inferred per host.

A page's markup is read into a tree of block elements and text. Its token stream is folded:
neighbouring groups of equal elements become one repeated group. The folded streams of a
host are then aligned with each other: where they agree elements are merged, equal text stays
template, text against other text becomes a slot, and an element that only one side has becomes
optional or, next to an equal group, one more repetition. What results is a regular expression
without unions, the host's wrapper. Each of its slots counts the pages, characters and characters in
links that it has taken.

The wrapper decides the text. From its root one descends into the element whose slots hold half or
more of all text that varies, as long as it is no repetition, no part of a text (a paragraph, a list) and no varying
heading is left outside. Names break ties: of the elements on that way an article (or main) element is taken, and one
that lies elsewhere if it holds a quarter. Each page is then matched with the wrapper, and what its
element of that place holds is its main text; the slots and constants of an article are taken whole, of
another element without what is template. Menus, headers, footers, sidebars, notices, adverts, forms,
scripts, styles and comments inside are known by element, role, class and id.

All pages of a host take part. Each task aligns the pages that it reads, and partial wrappers are
aligned FAN by FAN until a host has one, so a host with a third of all pages is no single task.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from copse.llm._shared import drop_tables, table, written

SALTS, LEAST_PAGES, GROUP, DEEP, FAN, BROADCAST_BYTES = 16, 8, 4, 100, 8, 4 << 20
MOST_ITEMS, HOSTS = 100, 500

# Fixed values of HTML: elements without content, with raw content, within a line, and those that end an open element.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul li dd dt".split()
)
SIBLING = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tbody", "thead", "tr", "td", "th"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dd": {"dl"}, "dt": {"dl"}, "option": {"select"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}}
PARTS = frozenset("p li ul ol dl dt dd h1 h2 h3 h4 h5 h6 blockquote pre figure".split())  # parts of a text, never all of it
# Fixed values of this operator: elements, roles and words of class or id that hold no main text.
NO_TEXT = frozenset("head script style noscript template iframe object svg canvas nav aside form button select textarea menu dialog footer noembed noframes title search".split())
NO_ROLE = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar status".split())
NO_WORD = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adbox banner banners breadcrumb breadcrumbs comment comments commentlist consent "
    "cookie cookies copyright disclaimer discussion disqus footer gdpr login masthead menu menus modal nav navbar navigation newsletter notice notices notification "
    "overlay pager pagination popup promo promoted promotion recommended related replies reply respond rail share sharing sidebar sidenav signup skip social sponsor "
    "sponsored sponsors subscribe subscription teaser toolbar topbar widget widgets".split()
)
HEADER_WORD = frozenset("header head masthead".split())
# Words that say where a part of the page stands and may be compounded with the ones above: main-nav, related-posts, share-buttons.
LAYOUT = frozenset(
    "site page main top bottom left right upper lower global primary secondary block blocks section container wrapper wrap box list area bar links link post posts "
    "article articles entry button buttons form item items inner outer column col row first last mobile desktop text".split()
)

_MARKUP = re.compile(
    r"""<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|</(?P<end>[a-zA-Z][^\s/>]*)[^>]*>|<(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*+)>|<(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)>""",
    re.S,
)
_ATTR = re.compile(r"""(class|id|role|hidden|aria-hidden|style|itemprop)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
_LETTERS = re.compile(r"[^\d]*")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


@lru_cache(20_000)
def signature(tag: str, attrs: str) -> tuple[str, str]:
    """The element as a token of the stream (names up to their first digit), and its kind: '' plain, 'out' no main text, 'main', 'article', 'header'.

    'word ' before a kind says that a name bars the element; :func:`settle` decides.
    """
    a = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(attrs)} if attrs else {}
    names = " ".join(x for x in (a.get("class", ""), a.get("id", "")) if x)
    sig = tag + "".join(sorted({"." + _LETTERS.match(x)[0] for x in names.split()}))  # what follows a digit is made by a program
    tokens = [{w.lower() for w in _WORDS.findall(x)} for x in names.split()]
    role = a.get("role", "").lower()
    hidden = "hidden" in a or a.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", a.get("style", ""))
    if tag in NO_TEXT or role in NO_ROLE or hidden:
        return sig, "out"
    if tag == "article" or a.get("itemprop", "").lower() == "articlebody":
        kind = "article"
    elif tag == "main" or role == "main":
        kind = "main"
    elif tag == "header" or named(tokens, HEADER_WORD) and tag not in ("html", "body") and not re.fullmatch(r"h[1-6]", tag):
        kind = "header"
    else:
        kind = ""
    return sig, "word " + kind if named(tokens, NO_WORD) and tag not in ("html", "body", "main") else kind


def named(tokens: list[set[str]], words: frozenset[str]) -> bool:
    """Whether a whole name of class or id is one of the words, or a compound of them and words of layout only."""
    return any(t & words and t <= words | NO_WORD | LAYOUT for t in tokens)


def barred(kind: str) -> bool:
    return kind == "out" or kind.startswith("word ")


class Node:
    """An element: its token, kind and children, which are nodes or text ``(string, characters in links)``."""

    __slots__ = ("sig", "tag", "kind", "children")

    def __init__(self, tag: str, sig: str, kind: str):
        self.tag, self.sig, self.kind, self.children = tag, sig, kind, []


def parse(page: str) -> Node:
    """The tree of block elements of any markup, however broken."""
    root = Node("#", "#", "")
    stack, text, links, in_link, at = [root], [], 0, 0, 0
    flat: dict[str, int] = {}  # open elements that lie too deep for a node; they only end blocks

    def flush():
        nonlocal links
        if text:
            words = " ".join(html.unescape("".join(text)).split())
            if words:
                stack[-1].children.append((words, min(links, len(words))))
            text.clear()
        links = 0

    def close(names, scope=frozenset()):
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in names:
                flush()
                del stack[i:]
                return
            if stack[i].tag in scope:
                return

    n = len(page)
    while at < n:
        m = _MARKUP.search(page, at)
        piece = page[at : m.start() if m else n]
        if piece:
            text.append(piece)
            links += len(piece) if in_link else 0
        if not m:
            break
        at = m.end()
        tag = (m["tag"] or m["tag2"] or m["end"] or "").lower()
        if not tag:
            continue
        if m["end"]:
            if tag == "a":
                in_link = 0
            elif tag in INLINE:
                pass
            elif tag == "br":
                text.append(" ")
            elif flat.get(tag):
                flat[tag] -= 1
                flush()
            else:
                close({tag})
            continue
        attrs = m["attrs"] or m["attrs2"] or ""
        if tag in RAW and not attrs.endswith("/"):
            end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
            stop = page.find(">", end.start()) if end else -1
            at = n if stop < 0 else stop + 1
            continue
        if tag in ("br", "wbr"):
            text.append(" " if tag == "br" else "")
        elif tag in INLINE and not barred(signature(tag, attrs)[1]):
            if tag == "a":
                in_link = 1
        elif tag in VOID:
            if tag == "hr":
                close({"p"})
                flush()
        else:
            flush()
            if tag in CLOSES_P:
                close({"p"}, {"table", "td", "th", "button", "object"})
            if tag in SIBLING:
                close(SIBLING[tag], SCOPE[tag])
            sig, kind = signature(tag, attrs)
            if len(stack) > DEEP and (not kind or any(barred(x.kind) for x in stack) or len(stack) > 2 * DEEP):
                flat[tag] = flat.get(tag, 0) + 1
                continue
            node = Node(tag, sig, kind)
            stack[-1].children.append(node)
            if not attrs.endswith("/") or tag not in INLINE:
                stack.append(node)
    flush()
    settle(root)
    return root


def settle(root: Node) -> None:
    """Decide which elements with a name like 'sidebar' are out.

    An element that holds the page's only article (or else main element) stays, and where there
    is none, one that holds more than half of the page's text outside links.
    """

    def weight(node: Node) -> int:
        return 0 if node.kind == "out" else sum(max(0, len(c[0]) - 2 * c[1]) if isinstance(c, tuple) else weight(c) for c in node.children)

    def ways(node: Node, kind: str, above: list[Node]) -> Iterator[list[Node]]:
        """From the root to each element of the kind that no element of the kind holds."""
        if node.kind == "out":
            return
        above = [*above, node]
        if node.kind.removeprefix("word ") == kind:
            yield above
        else:
            for c in node.children:
                if isinstance(c, Node):
                    yield from ways(c, kind, above)

    def all_of(node: Node) -> Iterator[Node]:
        yield node
        for c in node.children:
            if isinstance(c, Node):
                yield from all_of(c)

    def free(way: list[Node]) -> bool:
        return not any(x.kind.startswith("word ") for x in way)

    soft = [x for x in all_of(root) if x.kind.startswith("word ")]
    if not soft:
        return
    keep: list[Node] = []
    found = list(ways(root, "article", [])) or list(ways(root, "main", []))
    if found:
        if not any(free(way) for way in found):
            keep = max(found, key=lambda way: weight(way[-1]))
    else:
        total = weight(root)
        keep = [x for x in soft if 2 * weight(x) > total]
    kept = {id(x) for x in keep}
    for x in soft:
        x.kind = x.kind.removeprefix("word ") if id(x) in kept else "out"


# A wrapper is nested lists, so that it can be written as JSON: ["#", digest, characters, in links, pages] is a text (or
# repeated ones, by a digest of all), a slot if its digest is 0; ["e", token, kind, items] is an element and ["g", items] a group; an item is [least, most, node], most 0 for
# any number. An element whose items became too many has them by tag alone: their tokens end in ".*".


def token(node: list) -> str:
    """What two nodes must share to be aligned."""
    return "#" if node[0] == "#" else node[1] if node[0] == "e" else "(" + " ".join(token(x[2]) for x in node[1]) + ")"


def skeleton(node: Node) -> list:
    """The folded stream of an element; elements without main text are leaves."""
    if barred(node.kind):
        return ["e", node.sig, "out", []]
    items = [[1, 1, ["#", xxhash.xxh3_64_intdigest(c[0]) or 1, len(c[0]), c[1], 1] if isinstance(c, tuple) else skeleton(c)] for c in node.children]
    return ["e", node.sig, node.kind, folded(items)]


def _joined(a: list, b: list, same: bool) -> list:
    """The item that either of two neighbours with the same token is a repetition of."""
    return [min(a[0], b[0]), 0, merged(a[2], b[2], same)]


def folded(items: list) -> list:
    """Neighbouring repetitions, of one element or of a group of up to GROUP, as one repeated item."""
    out: list = []
    for x in items:
        if out and token(out[-1][2]) == token(x[2]):
            out[-1] = _joined(out[-1], x, True)
        else:
            out.append(x)
    for size in range(2, GROUP + 1):
        names = [token(x[2]) for x in out]
        if not any(names[i : i + size] == names[i + size : i + 2 * size] for i in range(len(names) - 2 * size + 1)):
            continue
        i, folding = 0, []
        while i < len(out):
            reps = 1
            while names[i : i + size] == names[i + reps * size : i + (reps + 1) * size] and len(names[i : i + size]) == size:
                reps += 1
            if reps > 1:
                part = ["g", out[i : i + size]]
                for k in range(1, reps):
                    part = merged(part, ["g", out[i + k * size : i + (k + 1) * size]], True)
                folding.append([1, 0, part])
                i += reps * size
            else:
                folding.append(out[i])
                i += 1
        out = folding
    return out


def merged(a: list, b: list, same: bool = False) -> list:
    """Two nodes with the same token as one; ``same`` says that both are of one page."""
    if a[0] == "#":
        if same:  # one after the other: equal on pages where both are
            return ["#", a[1] and b[1] and xxhash.xxh3_64_intdigest(f"{a[1]} {b[1]}") or 0, a[2] + b[2], a[3] + b[3], max(a[4], b[4])]
        return ["#", a[1] if a[1] == b[1] else 0, a[2] + b[2], a[3] + b[3], a[4] + b[4]]
    if a[0] == "g":
        return ["g", aligned(a[1], b[1], same)]
    kind = b[2] if a[2] == "out" else a[2] or (b[2] if b[2] != "out" else "")
    return ["e", a[1], kind, aligned(a[3], b[3], same)]


def _grouped(items: list, groups: list[list], same: bool) -> list:
    """Plain runs of items that a group of the other side describes, as that group."""
    for g in groups:
        names, size = [token(x[2]) for x in g[1]], len(g[1])
        i, out = 0, []
        while i < len(items):
            if [token(x[2]) for x in items[i : i + size]] == names:
                part = [1, 1, ["g", items[i : i + size]]]
                out = [*out[:-1], _joined(out[-1], part, True)] if out and token(out[-1][2]) == token(part[2]) else [*out, part]
                i += size
            else:
                out.append(items[i])
                i += 1
        items = out
    return items


def _general(items: list) -> list:
    """Items by tag alone, groups dissolved."""
    plain = [y for x in items for y in ([[0, 0, z] for z in spots(x[2])] if x[2][0] == "g" else [x])]
    return folded([[x[0], x[1], ["e", x[2][1].split(".", 1)[0] + ".*", *x[2][2:]]] if x[2][0] == "e" else x for x in plain])


def _by_tag(items: list) -> bool:
    return any(x[2][0] == "e" and x[2][1].endswith(".*") for x in items)


def aligned(a: list, b: list, same: bool = False) -> list:
    """Two sequences of items as one: a longest common subsequence is merged, all else is optional.

    More than MOST_ITEMS (names that differ on every page) are aligned by tag alone.
    """
    if len(a) == len(b) == 0:
        return a
    if _by_tag(a) or _by_tag(b) or max(len(a), len(b)) > MOST_ITEMS:
        a, b = _general(a), _general(b)
    elif any(x[2][0] == "g" for x in a) or any(x[2][0] == "g" for x in b):
        a, b = _grouped(a, [x[2] for x in b if x[2][0] == "g"], same), _grouped(b, [x[2] for x in a if x[2][0] == "g"], same)
    x, y = [token(i[2]) for i in a], [token(i[2]) for i in b]
    if x == y:
        return [[min(p[0], q[0]), 0 if 0 in (p[1], q[1]) else 1, merged(p[2], q[2], same)] for p, q in zip(a, b)]
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x) - 1, -1, -1):
        for j in range(len(y) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if x[i] == y[j] else max(best[i + 1][j], best[i][j + 1])
    i = j = 0
    out: list = []
    while i < len(x) or j < len(y):
        if i < len(x) and j < len(y) and x[i] == y[j]:
            p, q = a[i], b[j]
            item = [min(p[0], q[0]), 0 if 0 in (p[1], q[1]) else 1, merged(p[2], q[2], same)]
            i, j = i + 1, j + 1
        elif j == len(y) or i < len(x) and best[i + 1][j] >= best[i][j + 1]:
            item, i = [0, *a[i][1:]], i + 1
        else:
            item, j = [0, *b[j][1:]], j + 1
        if out and token(out[-1][2]) == token(item[2]):
            out[-1] = [min(out[-1][0], item[0]), 0, merged(out[-1][2], item[2], same)]
        else:
            out.append(item)
    return out if len(out) <= MOST_ITEMS or _by_tag(out) else _general(out)


def expression(node: list) -> str:
    """A wrapper as text: element(content), # for a slot, = for template text, ? optional, + and * repeated."""
    if node[0] == "#":
        return "=" if node[1] else "#"
    inside = " ".join(expression(n) + {(1, 1): "", (0, 1): "?", (1, 0): "+", (0, 0): "*"}[low, high] for low, high, n in node[-1])
    return f"{node[1]}({inside})" if node[0] == "e" else f"({inside})"


def _aligned_all(wrappers: list[str]) -> str | None:
    """The wrapper of partial wrappers (JSON), aligned in order."""
    found = None
    for s in wrappers:
        new = json.loads(s)
        found = new if found is None else merged(found, new)
    return None if found is None else json.dumps(found, separators=(",", ":"))


def spots(node: list) -> list[list]:
    """An element's parts in order, groups looked through."""
    return [y for _, _, x in node[-1] for y in (spots(x) if x[0] == "g" else [x])]


class Placed:
    """A wrapper with its place of the main text, ready to be matched with pages."""

    def __init__(self, wrapper: list):
        self.wrapper, self.memo, self.places = wrapper, {}, {}
        self.place = self.place_among(None)

    def is_template(self, text: list) -> bool:
        return text[1] != 0 and text[4] >= LEAST_PAGES

    def _weigh(self, node: list, among: frozenset[int] | None, how: int, weight: dict[int, int], within: str = "") -> int:
        """Characters of the text that varies and stands in no link (how 0), in no link (1), or of all (2), by element or group.

        Text of a header that is not within an article does not count.
        """
        if node[0] == "e" and (node[2] in ("article", "main") or node[2] == "header" and not within):
            within = node[2]
        if node[0] != "g" and among is not None and id(node) not in among:
            w = 0
        elif node[0] == "#":
            w = 0 if how == 0 and self.is_template(node) or within == "header" else node[2] if how == 2 else max(0, node[2] - 2 * node[3])
        else:
            w = sum(self._weigh(x[2], among, how, weight, within) for x in node[-1])
        weight[id(node)] = w
        return w

    def _inner(self, node: list) -> list[tuple[list, bool]]:
        """Elements right inside an element, and whether they are repeated; groups are looked through."""
        return [y for _, most, x in node[-1] if x[0] != "#" for y in ([(x, most == 0)] if x[0] == "e" else [(z, True) for z, _ in self._inner(x)])]

    def _elements(self, node: list) -> Iterator[list]:
        for x, _ in self._inner(node):
            yield x
            yield from self._elements(x)

    def place_among(self, among: frozenset[int] | None) -> list | None:
        """The element that holds the main text, of all or of the parts that a page has."""
        weight: dict[int, int] = {}
        total = next((w for how in range(3) if (w := self._weigh(self.wrapper, among, how, weight))), 0)
        if not total:
            return None
        of = lambda x: weight.get(id(x), 0)
        way = [self.wrapper]
        while True:
            inner = self._inner(way[-1])
            best, repeated = max(inner, key=lambda x: of(x[0]), default=(None, True))
            named = best is not None and best[2] in ("article", "main")
            if best is None or 2 * of(best) < total or not named and (repeated or re.split(r"[.]", best[1])[0] in PARTS):
                break
            if not named and any(x is not best and re.match(r"h[1-6]\b", x[1]) and of(x) for x, _ in inner):
                break
            way.append(best)
        for kind in ("article", "main"):
            on_way = [x for x in way if x[2] == kind]
            if on_way:
                return on_way[0]
            best = max((x for x in self._elements(self.wrapper) if x[2] == kind), key=of, default=None)
            if best is not None and of(best) and 4 * of(best) >= total:
                return best
        return way[-1]

    def matched(self, node: list, children: tuple[str, ...]) -> list[list | None]:
        """The part of a wrapper's element that each child (by token) is an instance of."""
        key = id(node), children
        found = self.memo.get(key)
        if found is None:
            parts = spots(node)
            at: dict[str, list[int]] = {}
            for i, x in enumerate(parts):
                at.setdefault(token(x), []).append(i)
            found, now = [], 0
            for name in children:
                places = at.get(name) or at.get(name.split(".", 1)[0] + ".*") or []
                # the next place from here on; else a repetition: the last one before
                spot = next((i for i in places if i >= now), places[-1] if places else None)
                found.append(None if spot is None else parts[spot])
                now = now if spot is None else spot
            if len(self.memo) > 20_000:
                self.memo.clear()
            self.memo[key] = found
        return found

    def text(self, root: Node) -> str:
        """The page's main text: what its element at the place holds, in page order.

        A page without that element has its place among the parts that it does have.
        """
        def seek(node: Node, part: list, place: list) -> Iterator[Node]:
            if part is place:
                yield node
                return
            for c, p in self._pairs(node, part):
                if p is not None and not isinstance(c, tuple) and not barred(c.kind):
                    yield from seek(c, p, place)

        def parts(node: Node, part: list) -> Iterator[int]:
            yield id(part)
            for c, p in self._pairs(node, part):
                if p is not None:
                    yield from [id(p)] if isinstance(c, tuple) else parts(c, p)

        def size(node: Node) -> int:
            return 0 if barred(node.kind) else sum(len(c[0]) if isinstance(c, tuple) else size(c) for c in node.children)

        def take(node: Node, part: list | None, out: list[str]) -> list[str]:
            for c, p in self._pairs(node, part) if part is not None else [(c, None) for c in node.children]:
                if isinstance(c, tuple):
                    if whole or p is None or not self.is_template(p):
                        out.append(c[0])
                elif not (barred(c.kind) or c.kind == "header" and not whole or c.tag == "article" and chosen.tag == "article"):
                    take(c, p, out)  # an article in an article is a reader's comment or another article
            return out

        place = self.place
        found = list(seek(root, self.wrapper, place)) if place is not None else []
        if not any(map(size, found)):
            among = frozenset(parts(root, self.wrapper))
            if among not in self.places:
                if len(self.places) > 1000:
                    self.places.clear()
                self.places[among] = self.place_among(among)
            place = self.places[among]
            found = list(seek(root, self.wrapper, place)) if place is not None else []
        if not found:
            return ""
        whole = place[2] in ("article", "main")
        chosen = max(found, key=size)
        return "\n".join(take(chosen, place, []))

    def _pairs(self, node: Node, part: list) -> Iterator[tuple]:
        return zip(node.children, self.matched(part, tuple("#" if isinstance(c, tuple) else c.sig for c in node.children)))


def host_of(url: Column) -> Column:
    """Host of a URL, lower case, without user and port; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^\s*(?:[a-zA-Z][\w+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pages of a task, aligned by host: a row a host, and again when HOSTS of them are held."""
    held: dict[str, list] = {}

    def rows():
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array([json.dumps(x, separators=(",", ":")) for x in held.values()], pa.string())], ["host", "wrapper"])

    for batch in batches:
        for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
            new = skeleton(parse(page or ""))
            held[host] = merged(held[host], new) if host in held else new
            if len(held) >= HOSTS:
                yield rows()
                held.clear()
    if held:
        yield rows()


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """``host, wrapper``: one union-free expression a host (JSON, see :func:`expression`), over all its pages (``host, html``)."""
    def align(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [key[0]], "wrapper": [_aligned_all(rows["wrapper"].tolist())]})

    parts = written(pages.select("host", "html").mapInArrow(_partial, "host string, wrapper string"), "partial-wrappers")
    while (most := parts.groupBy("host").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0) > 1:
        shares = -(-most // FAN)  # of some FAN partial wrappers each
        dealt = parts.withColumn("share", F.pmod(F.xxhash64("wrapper"), F.lit(shares)))
        nxt = written(dealt.groupBy("host", "share").applyInPandas(align, "host string, wrapper string"), "partial-wrappers")
        drop_tables(parts)
        parts = nxt
    return parts


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept: dict[str, Placed] = {}
    for batch in batches:
        texts = []
        hosts, wrappers = batch.column("host").to_pylist(), batch.column("wrapper").dictionary_encode()
        for host, at, page in zip(hosts, wrappers.indices.to_pylist(), batch.column("html").to_pylist()):
            if host not in kept:
                if len(kept) >= HOSTS:
                    kept.clear()
                kept[host] = Placed(json.loads(wrappers.dictionary[at].as_py()))
            texts.append(kept[host].text(parse(page or "")))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def main_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of each page.

    Null and empty pages, and pages without main text, have the empty text. A null or
    malformed URL belongs to the host ''. Repeated rows give repeated rows; a null page_id
    stays null; extra columns are not read. An empty table gives an empty table. Elements that lie
    deeper than 2 * DEEP levels only end blocks.

    Text is template if LEAST_PAGES or more pages of the host have a text at its place in the wrapper
    and all the same. It is left out unless it stands in an article or main element.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    pages = pages.withColumn("host", host_of(F.col("url")))
    known = infer_wrappers(pages)
    size = known.agg(F.sum(F.octet_length("wrapper") + 100)).first()[0] or 0
    rows = pages
    if size <= BROADCAST_BYTES:  # measured; beyond it each host's row is repeated over salts and met by a shuffle
        rows = rows.join(F.broadcast(known), "host")
    else:
        known = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("salt", F.pmod(F.hash("page_id", "url"), F.lit(SALTS))).join(known, ["host", "salt"])
    return rows.select("page_id", "url", "host", "wrapper", "html").mapInArrow(_extracted, "page_id long, url string, text string, n_chars long")


def op3_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


#: For pages whose text stands in one article of headings and paragraphs, as in the tables here; the operator does not know that.
ORACLE = r"""WITH inside AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1) AS h FROM pages),
parts AS (SELECT page_id, url, list_transform(regexp_split_to_array(replace(h, '<br>', ' '), '</?(?:p|h1)>'), lambda x: trim(regexp_replace(
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '<[^>]*>', '', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) AS ps FROM inside),
joined AS (SELECT page_id, url, array_to_string(list_filter(ps, lambda x: x <> ''), chr(10)) AS text FROM parts)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM joined"""
