"""A web page as a tree of block elements, its outline, and the alignment of two outlines by simple tree matching."""

from __future__ import annotations

import html
import re
import sys
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
from xxhash import xxh3_64_hexdigest

#: Fixed values of HTML: elements without content, elements whose content is not markup, elements inside a line of text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg select annotation annotation-xml".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q ruby rp rt s samp small span strike strong sub sup time tt u var wbr math semantics mrow mi mn mo ms mtext mfrac msqrt mroot msup msub msubsup munder mover munderover mspace mstyle mtable mtr mtd".split())
#: What starts inside an open paragraph or item and ends it.
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
ENDS_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("thead", "tbody", "tr", "td", "th")}
SCOPES = frozenset("html body article aside div section main nav header footer form table ul ol dl td th li blockquote figure details fieldset".split())
#: Elements that are not the article; a form can hold a whole page, so it is only likely not to be.
NOT_ARTICLE, LIKELY_NOT = frozenset("nav footer aside button dialog menu head".split()), frozenset(["form"])
#: A class, id or role says what is not the article if one of these words is in it, unless a word beside it says that there is none of it or that it is open.
SURE_WORDS = frozenset("ad adbox ads adsbox adsense adslot adunit advert adverts advertisement advertisements advertising breadcrumb breadcrumbs commentarea commentbox commentform commentlist comments commentsection cookies dfp disqus masthead navbar newsletter outbrain pager sidebar sponsored taboola".split())
QUALIFIERS = frozenset("closed disabled enabled has no not open with without".split())
#: Or if all its words are of these lists, and one of the first two; the second is less sure.
CERTAIN_WORDS = frozenset("comment complementary consent contentinfo cookie footer login pagination replies reply signup sponsor subscribe subscription".split()) | SURE_WORDS
LIKELY_WORDS = frozenset("banner menu modal nav navigation notice overlay popup promo promoted related respond share sharing social widget".split())
COMPANIONS = frozenset("area article articles bar block body bottom box btn button buttons container content form global header home icons inline inner item items js left link links list listing main message middle outer page panel post posts primary right row secondary section site slot text the thread title top unit widgets wrap wrapper".split())
#: What these elements hold is text, so their names tell little; but an advert may be one.
TEXTS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre dd dt figcaption caption".split())
#: Elements nested deeper than this stand beside each other, as in browsers.
MAX_OPEN = 512
CERTAIN, LIKELY = 2, 1

_TOKEN = re.compile(r"""<!--(?:.*?-->|.*)|<(?:[!?][^>]*>?)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""", re.S)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_CUT = re.compile(r"<[/!?A-Za-z][^<>]*\Z")
_WORD = re.compile(r"[a-z0-9]+")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Link(str):
    """A text all of which is in a link."""


class Node:
    """A block element, or a text among elements (sign "#").

    items are its texts or child nodes in page order, never both. marked says how sure it is that it or
    what it stands in is no part of an article: told by its kind, and named by its names, which count
    for nothing if it holds the main element or the first article. scope is which element it stands in: 0 none, 1
    main, or the number of an outermost article element. digest stands for all its texts, shape for its structure.
    """

    __slots__ = ("digest", "holds", "items", "marked", "named", "scope", "shape", "sign")

    def __init__(self, sign: str, marked: int, scope: int) -> None:
        self.sign, self.marked, self.scope, self.items = sign, marked, scope, []
        self.named, self.holds = 0, False
        self.digest, self.shape = "", 0


def told_by(names: list[str]) -> int:
    """How sure class, id and role names make it that this is a menu, an advert, comments or the like."""
    found = 0
    for name in names:
        parts = [p.lower() for p in _PART.findall(name)]
        if not SURE_WORDS.isdisjoint(parts) and QUALIFIERS.isdisjoint(parts):
            return CERTAIN
        if all(p in CERTAIN_WORDS or p in LIKELY_WORDS or p in COMPANIONS for p in parts):
            if not CERTAIN_WORDS.isdisjoint(parts):
                return CERTAIN
            found = found if LIKELY_WORDS.isdisjoint(parts) else LIKELY
    return found


def parse(page: str) -> list[Node]:
    """The page's nodes in page order, its root first. Unclosed and stray tags are put up with."""
    root = Node("", 0, 0)
    nodes, articles, beyond = [root], 1, 0
    stack: list[tuple[str, Node]] = [("", root)]
    line: list[str] = []
    links, plain = 0, False

    def flush() -> None:
        nonlocal plain
        if line:
            text = " ".join(html.unescape("".join(line)).split())
            if text:
                stack[-1][1].items.append(text if plain else Link(text))
            line.clear()
        plain = False

    at, find = 0, _TOKEN.search
    while (m := find(page, at)) is not None:
        if m.start() > at:
            line.append(page[at : m.start()])
            plain = plain or not (links or line[-1].isspace())
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if not m[1]:
            if name in RAW:
                if not m[3].endswith("/"):
                    end = re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.I).search(page, at)
                    at = end.end() if end else len(page)
                continue
            if name in INLINE:
                if name == "br":
                    line.append(" ")
                elif name == "a":
                    links += 1
                continue
            flush()
            if name in ENDS_P:
                _close(stack, ("p",))
            if name in ENDS_SAME:
                _close(stack, ENDS_SAME[name])
            if name in VOID:
                continue
            above = stack[-1][1]
            written = " ".join(a or b or c for a, b, c in _NAMES.findall(m[3])).split() if "=" in m[3] else []
            names = [n.lower() for n in written]
            scope = above.scope
            if name == "article" and scope < 2:
                articles += 1
                scope = articles
            elif scope == 0 and (name == "main" or ("main" in names and "role" in m[3])):
                scope = 1
            marked = CERTAIN if name in NOT_ARTICLE or (above.scope == 0 and name == "header") or _HIDDEN.search(m[3]) else 0
            named = LIKELY if name in LIKELY_NOT else 0
            if names and name not in ("html", "body"):
                named = max(named, told_by(written), CERTAIN * (above.scope == 0 and "header" in names))
                if name in TEXTS and above.scope > 1 and not {"ad", "ads", "advert"} & {w for n in names for w in _WORD.findall(n)}:
                    named = 0
            words = sorted({w for n in names for w in _WORD.findall(n) if w.isalpha()})
            node = Node(".".join([name, *words]), marked, scope)
            node.named, node.holds = named, above.scope != scope <= 2
            above.items.append(node)
            nodes.append(node)
            if not m[3].endswith("/"):
                if len(stack) <= MAX_OPEN:
                    stack.append((name, node))
                else:
                    beyond += 1
        elif name in INLINE:
            links = max(0, links - (name == "a"))
        else:
            flush()
            if beyond:
                beyond -= 1
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
                if name == "p" and stack[i][0] in SCOPES:
                    break
    # A tag that the page's end cuts off is no text.
    line.append(_CUT.sub("", page[at:]))
    plain = plain or not (links or line[-1].isspace())
    flush()
    inside: set[int] = set()
    for node in reversed(nodes):
        if any(isinstance(x, Node) and (x.holds or id(x) in inside) for x in node.items):
            inside.add(id(node))
    for node in nodes:
        node.marked = max(node.marked, 0 if id(node) in inside else node.named)
        for x in node.items:
            if isinstance(x, Node):
                x.marked = max(x.marked, node.marked)
    for node in reversed(nodes):
        _finish(node)
    return nodes


def _close(stack: list[tuple[str, Node]], names: tuple[str, ...]) -> None:
    """Ends the open elements of these names up to the nearest element that encloses them."""
    for i in range(len(stack) - 1, 0, -1):
        if stack[i][0] in names:
            del stack[i:]
            return
        if stack[i][0] in SCOPES and not (names[0] in ("tr", "thead") and stack[i][0] in ("td", "th")):
            return


def _finish(node: Node) -> None:
    """Makes nodes of texts that stand among elements; sets digest and shape, those of the children being set."""
    items = node.items
    kinds = set(map(type, items))
    if Node not in kinds:
        node.digest, node.shape = xxh3_64_hexdigest("\n".join(items).encode("utf-8", "surrogatepass")), hash(node.sign)
        return
    if len(kinds) > 1:
        for i, x in enumerate(items):
            if isinstance(x, str):
                items[i] = own = Node("#", node.marked, node.scope)
                own.items.append(x)
                _finish(own)
    shapes = [node.sign]
    for x in items:
        if shapes[-1] != x.shape:
            shapes.append(x.shape)
    node.digest, node.shape = xxh3_64_hexdigest("".join([x.digest for x in items])), hash(tuple(shapes))


class Outline:
    """A page's groups of nodes in preorder: level, sign, digest of the texts, and digests of the members.

    Neighbours of one sign and one shape (paragraphs, rows, records) are one group without children,
    and so is a node with texts alone; any other node is a group of its own with its children.
    """

    __slots__ = ("digests", "levels", "members", "nodes", "signs")

    def __init__(self, levels: list[int], signs: list[str], digests: list[str], members: list[list[str]]) -> None:
        self.levels, self.signs, self.digests, self.members = levels, signs, digests, members
        self.nodes: list[list[Node]] = []

    def rows(self) -> list[list]:
        return [self.levels, self.signs, self.digests, self.members]


def outline(root: Node) -> Outline:
    out = Outline([], [], [], [])
    todo: list[tuple[list[Node], int]] = [([root], 0)]
    while todo:
        group, level = todo.pop()
        inner = len(group) == 1 and bool(group[0].items) and isinstance(group[0].items[0], Node)
        members = [] if inner else [n.digest for n in group]
        out.levels.append(level)
        out.signs.append(group[0].sign)
        out.digests.append(group[0].digest if len(group) == 1 else xxh3_64_hexdigest("".join(members)))
        out.members.append(members)
        out.nodes.append(group)
        if inner:
            runs: list[list[Node]] = []
            for x in group[0].items:
                if runs and runs[-1][0].sign == x.sign and runs[-1][0].shape == x.shape:
                    runs[-1].append(x)
                else:
                    runs.append([x])
            todo += [(run, level + 1) for run in reversed(runs)]
    return out


def _children(levels: list[int]) -> list[list[int]]:
    """The places of each place's children."""
    out: list[list[int]] = [[] for _ in levels]
    path: list[int] = []
    for i, level in enumerate(levels):
        del path[level:]
        if path:
            out[path[-1]].append(i)
        path.append(i)
    return out


def _last_row(rows: Callable[[int], np.ndarray], start: int, stop: int, step: int, low: int, high: int) -> np.ndarray:
    """Best totals of rows start..stop (by step) against each prefix (suffix if step is -1) of the columns low..high."""
    best = np.zeros(high - low + 1, np.int64)
    for i in range(start, stop, step):
        gain = rows(i)[low:high][::step]
        best[1:] = np.maximum.accumulate(np.maximum(best[1:], best[:-1] + gain))
    return best


#: Cells of a table that is traced back at once; a larger one is halved first, with the same result.
CELLS = 1 << 20


def best_pairs(rows: Callable[[int], np.ndarray], n: int, m: int) -> list[tuple[int, int]]:
    """The pairs (row, column), rising in both, whose gains rows(i)[j] have the greatest sum; those without gain are left out."""
    out: list[tuple[int, int]] = []
    todo = [(0, n, 0, m)]
    while todo:
        a, b, c, d = todo.pop()
        if a >= b or c >= d:
            continue
        if b - a == 1:
            gain = rows(a)[c:d]
            j = int(gain.argmax())
            if gain[j] > 0:
                out.append((a, c + j))
        elif (b - a) * (d - c) > CELLS:
            mid = (a + b) // 2
            total = _last_row(rows, a, mid, 1, c, d) + _last_row(rows, b - 1, mid - 1, -1, c, d)[::-1]
            cut = c + int(total.argmax())
            todo += [(a, mid, c, cut), (mid, b, cut, d)]
        else:
            table = np.zeros((b - a + 1, d - c + 1), np.int64)
            for i in range(a, b):
                table[i - a + 1, 1:] = np.maximum.accumulate(np.maximum(table[i - a, 1:], table[i - a, :-1] + rows(i)[c:d]))
            i, j = b - a, d - c
            while i and j:
                if table[i, j] == table[i - 1, j]:
                    i -= 1
                elif table[i, j] == table[i, j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    out.append((a + i, c + j))
    return sorted(out)


def align(a: Outline, b: Outline) -> list[tuple[int, int, bool]]:
    """Simple tree matching: pairs (place in a, place in b, same texts), most in number, that keep order, ancestry and signs.

    Among alignments with most pairs, one with most neighbours of the same text is taken. Groups without
    children are paired as a whole; which of their members are the same is told by their digests.
    """
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 20 * MAX_OPEN))
    known: dict[tuple, int] = {}
    structure: list[tuple[str, tuple[int, ...]]] = []

    def coded(x: Outline) -> tuple[list[list[int]], list[int]]:
        """Children, and a number for each place's structure: equal ones match alike."""
        children, codes = _children(x.levels), [0] * len(x.levels)
        for i in range(len(x.levels) - 1, -1, -1):
            key = (x.signs[i], tuple([codes[c] for c in children[i]]))
            if key not in known:
                known[key] = len(structure)
                structure.append(key)
            codes[i] = known[key]
        return children, codes

    (of_a, code_a), (of_b, code_b) = coded(a), coded(b)
    memo: dict[tuple[int, int], int] = {}

    def weight(c: int, d: int) -> int:
        """Pairs in the best matching of two structures."""
        (sign, p), (other, q) = structure[c], structure[d]
        if sign != other:
            return 0
        if not p or not q:
            return 1
        if (c, d) not in memo:
            rows = gains(p, q)
            memo[c, d] = 1 + int(_last_row(rows, 0, len(p), 1, 0, len(q))[-1])
        return memo[c, d]

    def gains(p: tuple[int, ...], q: tuple[int, ...]) -> Callable[[int], np.ndarray]:
        kinds, column = np.unique(np.array(q), return_inverse=True)
        kinds, made = kinds.tolist(), {}

        def rows(i: int) -> np.ndarray:
            if p[i] not in made:
                got = []
                for d in kinds:
                    got.append(weight(p[i], d))
                made[p[i]] = np.array(got, np.int64)[column]
            return made[p[i]]

        return rows

    out: list[tuple[int, int, bool]] = []
    todo = [(0, 0)] if a.signs[:1] == b.signs[:1] else []
    while todo:
        i, j = todo.pop()
        out.append((i, j, a.digests[i] == b.digests[j]))
        p, q = of_a[i], of_b[j]
        same = lambda x, y: code_a[x] == code_b[y] and a.digests[x] == b.digests[y]
        # What is the same at both ends is paired; only what is between is searched.
        low = 0
        while low < min(len(p), len(q)) and same(p[low], q[low]):
            low += 1
        high = 0
        while high < min(len(p), len(q)) - low and same(p[-1 - high], q[-1 - high]):
            high += 1
        pairs = [(k, k) for k in range(low)] + [(len(p) - 1 - k, len(q) - 1 - k) for k in range(high)]
        mid_p, mid_q = p[low : len(p) - high], q[low : len(q) - high]
        if len(mid_p) == len(mid_q) == 1:
            if a.signs[mid_p[0]] == b.signs[mid_q[0]]:
                pairs.append((low, low))
        elif mid_p and mid_q:
            rows = gains(tuple(code_a[x] for x in mid_p), tuple(code_b[x] for x in mid_q))
            texts = np.array([b.digests[x] for x in mid_q])
            scale = min(len(mid_p), len(mid_q)) + 1
            full = lambda k: np.where(rows(k) > 0, rows(k) * scale + (texts == a.digests[mid_p[k]]), 0)  # noqa: E731, B023
            pairs += [(low + x, low + y) for x, y in best_pairs(full, len(mid_p), len(mid_q))]
        todo += [(p[x], q[y]) for x, y in pairs]
    return sorted(out)


def places(reference: Outline) -> list[int]:
    """The first of the numbers that a place's members have, which follow those of all places."""
    at, out = len(reference.levels), []
    for members in reference.members:
        out.append(at)
        at += len(members)
    return out


def compare(reference: Outline, page: Outline) -> list[tuple[int, bool, list[Node]]]:
    """(number of a place or member of the reference, whether the page has the same there, the page's nodes there)."""
    first, out = places(reference), []
    for i, j, same in align(reference, page):
        own, other = reference.members[i], page.members[j]
        if not own:
            out.append((i, same, page.nodes[j] if page.nodes else []))
            continue
        found: dict[str, list[Node]] = {}
        for k, digest in enumerate(other):
            found.setdefault(digest, []).extend(page.nodes[j][k : k + 1] if page.nodes else [])
        out += [(first[i] + k, digest in found, found.get(digest, [])) for k, digest in enumerate(own)]
    return out


class Text(NamedTuple):
    """A text with the scope, mark and kind of element it stands in."""

    scope: int
    marked: int
    heading: str
    text: str


#: A text of so many code points is prose.
PROSE = 80


def texts_of(root: Node, template: set[int]) -> list[Text]:
    """Texts in page order, without nodes that are certainly not the article and nodes whose id() is in template."""
    todo, found = [(root, "")], []
    while todo:
        x, heading = todo.pop()
        if x.marked < CERTAIN and id(x) not in template:
            name = x.sign.split(".", 1)[0]
            heading = name if name in HEADINGS else heading
            if x.items and isinstance(x.items[0], Node):
                todo += [(c, heading) for c in reversed(x.items)]
            else:
                found += [Text(x.scope, x.marked, heading, t) for t in x.items]
    return found


HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])


def story(found: list[Text]) -> list[str]:
    """The texts of the article: all its article elements and the page's h1 in the main element around them; else its main element; else all.

    An article element that holds nothing but headings and links is a teaser of another page, and so is one that
    begins with a link, where another one does not; teasers count only where there is nothing else.
    """
    articles: dict[int, list[Text]] = {}
    for x in found:
        if x.scope > 1:
            articles.setdefault(x.scope, []).append(x)
    told = {s for s, own in articles.items() if any(not x.heading and not isinstance(x.text, Link) for x in own)}
    plain = {s for s in told if not isinstance(articles[s][0].text, Link)}
    if kept := plain or told:
        return [x.text for x in found if x.scope in kept or (x.scope == 1 and x.heading == "h1")]
    outside = [x for x in found if x.scope <= 1]
    main = [x for x in outside if x.scope == 1]
    if any(not isinstance(x.text, Link) and not x.heading for x in outside) or not articles:
        return [x.text for x in main or outside]
    return [x.text for x in found if x.scope > 1]


def main_blocks(root: Node, template: set[int]) -> list[str]:
    """The article's texts in page order, without what the host's template and the names of elements exclude.

    What names only make likely not to be the article is left out, unless the host's pages tell that it
    varies, and it is prose and no link. Where nothing is left, pages of the host are copies of one article, and
    names alone decide; where that leaves nothing either, what is likely not the article is taken.
    """
    weak = lambda x: x.marked == LIKELY and not (template and len(x.text) >= PROSE and not isinstance(x.text, Link))
    for dropped in (template, set()) if template else (template,):
        if found := story([x for x in texts_of(root, dropped) if not weak(x)]):
            return found
    return story(texts_of(root, template))
