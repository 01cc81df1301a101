"""Main text of web pages by wrapper induction over the pages of a host.

A page's blocks form a tree. Repeated siblings become one node (an iteration), which leaves the page's shape. All pages
with one shape on one host are added up per node: pages, characters, characters in links, least and greatest hash of
the text. The shapes of a host are then aligned by simple tree matching (the largest order-preserving match of two trees
whose roots agree, by dynamic programming over their children, however many these are) and merged into the host's wrapper,
which takes in every node. A node whose text is the same on all pages is template; nodes whose text varies are slots. To read a page, its shape is matched with the
wrapper, and the slots of its main part are its content: within the page's article (or main part), or where it has none
within the page. Slots that by their element or by the words of their class, id or role are menus, headers, footers,
sidebars, notices, adverts, forms or comments are left out, and outside of an article also those that are mostly links.

Text that is the same on all pages is dropped within an article only after SUPPORT different texts of the host, so that a
few copies don't turn an article into template; outside of articles two different pages are enough.

At scale: pages are read twice and shuffled only where the wrappers are too large to be broadcast, and then by a join
that the adaptive engine can split at hot hosts. Tasks add up their pages before anything moves, so a host with a third
of all pages gives one row per task, shape and node. Wrappers are merged from parts of at most SHAPES shapes. Results
don't depend on how pages are dealt: sums are exact and shapes are merged in the order of their text. Two nodes' children
take time in proportion to their rows with a like times the range of sums that a row changes, at worst their product;
memory in proportion to their number. Children of one key that all differ below take a match, and memory for its size,
each pair.

Defined cases: a null html or url: empty text, or a page without a host, which is read by its own shape alone; repeated
rows are rows each; cut and unclosed markup is read as browsers do; elements deeper than DEPTH levels don't nest; an
empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Different texts of a host from which on text that never varies is template within an article too.
SUPPORT = 8
#: Shapes that one group merges, entries that a task holds before it hands them on, levels of nested blocks.
SHAPES, HELD, DEPTH = 1_000, 5_000, 200
#: Children that a node takes in where merge is to bound it (the job doesn't); rows that a pass over children keeps at
#: least, and sums in them up to which it keeps more.
CHILDREN, ROWS, SUMS = 1 << 12, 32, 1 << 21
#: Share of a node's characters in links from which on it is a menu, outside of an article.
LINKED = 0.5

# --- pages as trees ------------------------------------------------------------------------------------------

_BLOCKS = frozenset(
    "address article aside blockquote caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup, and inline elements whose content is no text of the page.
_RAW = frozenset("script style title textarea noscript iframe noembed noframes xmp template".split())
_UNREAD = frozenset("button select svg math object canvas video audio label datalist map applet".split())
_NAMES = frozenset("html head body".split())
#: What an opening element closes, and the elements that it doesn't look beyond.
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_CLOSES = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu", "dir"})), "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})), "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "tr": (frozenset({"tr", "td", "th"}), frozenset({"table"})), "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})), "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "tbody": (frozenset({"thead", "tbody", "tfoot", "tr", "td", "th"}), frozenset({"table"})), "tfoot": (frozenset({"thead", "tbody", "tr", "td", "th"}), frozenset({"table"})),
    "option": (frozenset({"option"}), frozenset({"optgroup"})),
}
_P_SCOPE = frozenset({"table", "td", "th", "caption"})

_TAG = re.compile(r"""<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>""", re.S)
_ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_OPEN = re.compile(r"<[a-zA-Z/!?]")
_NUMBERED, _LETTERS = re.compile(r"\w*\d\w*"), re.compile(r"[^a-z]+")


@dataclass(slots=True)
class Block:
    """A block element: its text and blocks in page order, and the characters of its text that are in links."""

    tag: str
    names: str = ""
    items: list = field(default_factory=list)
    linked: int = 0

    def text(self) -> str:
        return " ".join("".join(i for i in self.items if type(i) is str).split())


def _names(attributes: str) -> str:
    """Class, id and role; words with digits, which number a page's parts, are alike."""
    if "=" not in attributes:
        return ""
    found = {m[1].lower(): m[2].strip("\"'").lower() for m in reversed(list(_ATTRIBUTE.finditer(attributes)))}
    return _NUMBERED.sub("0", " ".join(" ".join(found[k].split()) for k in ("class", "id", "role") if k in found))


def parse(text: str) -> Block:
    """The tree of a page's blocks, below its body."""
    root = Block("body")
    stack: list[tuple[str, Block, bool]] = [("", root, False)]  # (element, block that takes its text, is a block itself)
    at, links = 0, 0

    def add(piece: str) -> None:
        if piece:
            block = stack[-1][1]
            piece = entities.unescape(piece) if "&" in piece else piece
            block.items.append(piece)
            if links:
                block.linked += len(piece)

    def drop(size: int) -> None:
        nonlocal links
        links -= sum(1 for name, _, _ in stack[size:] if name == "a")
        del stack[size:]

    while m := _TAG.search(text, at):
        add(text[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        name = name.lower()
        if m[1] or m[4]:
            if name in ("br", "p") and not any(x[0] == name for x in stack):
                add(" ") if name == "br" else None
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == name:
                    drop(i)
                    break
                if stack[i][2] and name not in _BLOCKS:
                    break  # an inline element ends with the block that it began in
            continue
        if name in _RAW:
            end = re.compile(f"</{re.escape(name)}(?=[\\s/>])[^>]*>|\\Z", re.I).search(text, at)
            at = end.end()
            continue
        if name == "br":
            add(" ")
        if name in _NAMES or name in _VOID and name != "hr":
            continue
        block = name in _BLOCKS
        if block:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == "p":
                    drop(i)
                    break
                if stack[i][0] in _P_SCOPE:
                    break
        if name in _HEADINGS and stack[-1][0] in _HEADINGS:
            drop(len(stack) - 1)
        if name in _CLOSES:
            what, until = _CLOSES[name]
            low = None
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in until:
                    break
                if stack[i][0] in what:
                    low = i
            if low is not None:
                drop(low)
        above = stack[-1][1]
        names = _names(m[3] or m[6] or "")
        if block:
            new = Block(name, names)
            if len(stack) < DEPTH:
                above.items.append(new)
                if name != "hr":
                    stack.append((name, new, True))
            continue
        if len(stack) < 2 * DEPTH:
            unread = name in _UNREAD or bool(names) and unwanted(names)
            stack.append((name, Block(name) if unread else above, False))
            links += name == "a"
    rest = text[at:]
    cut = _OPEN.search(rest)  # an element that the page's end cuts
    add(rest[: cut.start()] if cut else rest)
    return root


# --- shapes --------------------------------------------------------------------------------------------------

#: Siblings of these elements are iterations wherever they stand, others only side by side.
_ITERATED = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr blockquote pre".split())


@dataclass(slots=True)
class Shape:
    """A node of a page's shape (or a wrapper), with the page's blocks that it stands for and the sums over pages."""

    key: str
    children: list[Shape] = field(default_factory=list)
    blocks: list[Block] = field(default_factory=list)
    pages: int = 0
    chars: int = 0
    linked: int = 0
    low: int = 0
    high: int = 0
    name: str = ""
    mark: bytes = b""  # the same for trees with the same keys; empty: not known

    def nodes(self) -> list[Shape]:
        """In preorder."""
        out, stack = [], [self]
        while stack:
            out.append(x := stack.pop())
            stack += reversed(x.children)
        return out


def shape(block: Block) -> Shape:
    """The block's shape; name tells shapes apart."""
    children: list[Shape] = []
    leaves: dict[str, Shape] = {}
    for item in block.items:
        if type(item) is str:
            continue
        new = shape(item)
        old = leaves.get(new.key) if not new.children else None
        if old is None and children and children[-1].name == new.name:
            old = children[-1]
        if old is None:
            children.append(new)
            if not new.children and item.tag in _ITERATED:
                leaves[new.key] = new
            continue
        for a, b in zip(old.nodes(), new.nodes(), strict=True):
            a.blocks += b.blocks
    key = f"{block.tag} {block.names}".strip()
    return Shape(key, children, [block], name=f"{json.dumps(key)}[{','.join(c.name for c in children)}]")


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def measured(tree: Shape) -> Shape:
    """tree with the sums of its own page."""
    for node in tree.nodes():
        texts = [b.text() for b in node.blocks]
        hashes = [_hash(t) for t in texts]
        node.pages, node.chars, node.linked = 1, sum(map(len, texts)), sum(b.linked for b in node.blocks)
        node.low, node.high = min(hashes), max(hashes)
    return tree


def unnamed(name: str) -> Shape:
    """The tree that a shape's name tells."""
    keys, at, decode = [], 0, json.JSONDecoder().raw_decode
    top: list[Shape] = []
    while at < len(name):
        if name[at] == '"':
            key, at = decode(name, at)
            keys.append(new := Shape(key))
            (keys[-2].children if len(keys) > 1 else top).append(new)
            continue
        if name[at] == "]":
            keys.pop()
        at += 1
    return top[0]


# --- simple tree matching ------------------------------------------------------------------------------------


def _mark(tree: Shape) -> None:
    """Mark tree and what is below it."""
    found, todo = [], [tree]
    while todo:
        if not (node := todo.pop()).mark:
            found.append(node)
            todo += node.children
    for node in reversed(found):
        key = node.key.encode("utf-8", "surrogatepass")
        node.mark = hashlib.blake2b(b"%d:%b" % (len(key), key) + b"".join([c.mark for c in node.children]), digest_size=16).digest()


class _Children:
    """The children of two nodes, row by row of xs from the last one on.

    A row's best[p] is the largest sum of sizes over the xs from the row on and the last p of ys. It grows with p, so a row
    differs from the one behind it in one range only, and rows without their like in ys don't differ at all.
    """

    def __init__(self, xs: list[Shape], ys: list[Shape], size):
        self.xs, self.ys, self.size = xs, ys, size
        self.same = 0  # equal trees at the left, each of which is the other's best partner
        while self.same < min(len(xs), len(ys)) and xs[self.same].mark == ys[self.same].mark:
            self.same += 1
        n = self.length = len(ys) - self.same
        kinds: dict[str, tuple[list[int], list[int], dict[bytes, int], list[Shape]]] = {}
        for p in range(1, n + 1):
            y = ys[-p]
            places, which, numbers, alike = kinds.setdefault(y.key, ([], [], {}, []))
            if y.mark not in numbers:
                numbers[y.mark] = len(alike)
                alike.append(y)
            places.append(p)
            which.append(numbers[y.mark])
        self.kinds = {k: (np.array(places), np.array(places) - 1, np.array(which), alike) for k, (places, which, _, alike) in kinds.items()}
        self.holding: dict[str, dict[str, list[int]]] = {}  # by key, and a key below it: the different ys
        for k, (_, _, _, alike) in self.kinds.items():
            below = self.holding[k] = {}
            for number, y in enumerate(alike):
                for key in {c.key for c in y.children}:
                    below.setdefault(key, []).append(number)
        self.rows = [i for i in range(self.same, len(xs)) if xs[i].key in kinds]
        self.sizes: dict[bytes, np.ndarray] = {}

    def start(self) -> np.ndarray:
        return np.zeros(self.length + 1, np.int64)

    def sums(self, i: int, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places p of row i's like in ys, and the sums with each as its partner; best: the row behind."""
        x = self.xs[i]
        places, behind, which, alike = self.kinds[x.key]
        sizes = self.sizes.get(x.mark)
        if sizes is None:
            sizes = np.ones(len(alike), np.int32)
            below = self.holding[x.key]
            for number in {k for key in {c.key for c in x.children} for k in below.get(key, ())}:
                sizes[number] = self.size(x, alike[number])
            self.sizes[x.mark] = sizes
        return places, (sizes[which] if len(sizes) > 1 else sizes) + best[behind]

    def add(self, i: int, best: np.ndarray) -> None:
        """Make best, the row behind i, row i."""
        places, sums = self.sums(i, best)
        first, end = places[0], best.searchsorted(sums.max())
        if first < end:
            best[places] = np.maximum(best[places], sums)
            best[first:end] = np.maximum.accumulate(best[first:end])

    def behind(self, rows: list[int], best: np.ndarray):
        """Each of rows with the row behind it, from the first on; best: the row behind all. Few rows are kept at once."""
        if len(rows) <= 1:
            yield from ((i, best) for i in rows)
            return
        some = -(-len(rows) // max(ROWS, SUMS // len(best)))
        kept = []
        for at in reversed(range(0, len(rows), some)):
            kept.append(best.copy())
            for i in reversed(rows[at : at + some] if at else ()):
                self.add(i, best)
        for at in range(0, len(rows), some):
            yield from self.behind(rows[at : at + some], kept.pop())

    def total(self) -> int:
        """The largest sum of sizes of an order-preserving match."""
        best = self.start()
        for i in reversed(self.rows):
            self.add(i, best)
        return sum(self.size(x, x) for x in self.xs[: self.same]) + int(best[-1])

    def pairs(self) -> list[tuple[Shape, Shape]]:
        """The match with that sum; of several, the one whose next x has a partner further on only where it must."""
        out = list(zip(self.xs[: self.same], self.ys, strict=False))
        left = self.length
        for i, best in self.behind(self.rows, self.start()):
            places, sums = self.sums(i, best)
            last = int(places.searchsorted(left, "right")) - 1
            if last < 0:
                continue
            top = sums[: last + 1].max()
            if top > best[left]:
                last -= int(sums[last::-1].argmax())
            elif top < best[left] or places[last] < left or sums[last] < top:
                continue
            out.append((self.xs[i], self.ys[-places[last]]))
            left = int(places[last]) - 1
        return out


def _few(xs: list[Shape], ys: list[Shape], size) -> int:
    """_Children.total of few children, faster."""
    best = [0] * (len(ys) + 1)
    for x in reversed(xs):
        row = best[:]
        for j in range(len(ys) - 1, -1, -1):
            if x.key == ys[j].key:
                row[j] = max(row[j + 1], best[j], size(x, ys[j]) + best[j + 1])
            elif row[j + 1] > row[j]:
                row[j] = row[j + 1]
        best = row
    return best[0]


def _greedy(xs: list[Shape], ys: list[Shape]) -> list[tuple[Shape, Shape]]:
    """Order-preserving pairs of children with equal keys, each the next one from the left; not always the largest match."""
    places: dict[str, list[int]] = {}
    for j in range(len(ys) - 1, -1, -1):
        places.setdefault(ys[j].key, []).append(j)
    out, after = [], 0
    for x in xs:
        there = places.get(x.key, [])
        while there and there[-1] < after:
            there.pop()
        if there:
            out.append((x, ys[there[-1]]))
            after = there.pop() + 1
    return out


def match(a: Shape, b: Shape) -> list[tuple[Shape, Shape]]:
    """Pairs of nodes of the largest order-preserving match of two trees whose roots agree, however many children they have."""
    _mark(a)
    _mark(b)
    sizes: dict[tuple[bytes, bytes], int] = {}

    def size(x: Shape, y: Shape) -> int:
        if x.key != y.key:
            return 0
        if not x.children or not y.children:
            return 1
        if (found := sizes.get((x.mark, y.mark))) is not None:
            return found
        cells = len(x.children) * len(y.children)
        if x.mark == y.mark:
            total = 1 + sum([size(c, c) for c in x.children])
        else:
            total = 1 + (_few(x.children, y.children, size) if cells <= 4 * ROWS else _Children(x.children, y.children, size).total())
        if cells > 4:
            sizes[x.mark, y.mark] = total
        return total

    if a.key != b.key:
        return []
    out, todo = [], [(a, b)]
    while todo:
        x, y = todo.pop()
        out.append((x, y))
        if x.children and y.children:
            todo += _Children(x.children, y.children, size).pairs()
    return out


def merge(wrapper: Shape, other: Shape, most: int | None = CHILDREN) -> Shape:
    """wrapper with the sums of other at the nodes that match, and other's further nodes behind their left neighbours.

    most: children that a node of the wrapper takes in, further ones of other being left out; None: all of them.
    """
    pairs = match(wrapper, other)
    place = {id(y): x for x, y in pairs}
    for x, y in pairs:
        x.low, x.high = (min(x.low, y.low), max(x.high, y.high)) if x.pages and y.pages else (y.low, y.high) if y.pages else (x.low, x.high)
        x.pages, x.chars, x.linked = x.pages + y.pages, x.chars + y.chars, x.linked + y.linked
        x.mark = b""
        left, room = 0, len(y.children) if most is None else most - len(x.children)
        new: dict[int, list[Shape]] = {}  # by the left neighbour in x
        for child in y.children:
            if (mine := place.get(id(child))) is not None:
                left = id(mine)
            elif room > 0:
                new.setdefault(left, []).append(child)
                room -= 1
        if new:
            x.children = new.get(0, []) + [c for old in x.children for c in (old, *new.get(id(old), ()))]
    return wrapper


def dump(node: Shape) -> list:
    return [node.key, node.pages, node.chars, node.linked, node.low, node.high, [dump(c) for c in node.children]]


def load(data: list) -> Shape:
    key, pages, chars, linked, low, high, children = data
    return Shape(key, [load(c) for c in children], [], pages, chars, linked, low, high)


# --- what is content -----------------------------------------------------------------------------------------

_OUT = frozenset("nav footer aside form menu dialog search fieldset dir".split())
#: Words of a class, id or role, and beginnings of such words, that name what is no content.
_WORDS = frozenset(
    "ad ads banner promo promos promotion sidebar side menu menus nav navs topbar toolbar masthead footer foot cookie cookies consent gdpr notice notices popup modal overlay "
    "comment comments commentlist disqus reply replies respond discussion related recommended recommendations share sharing social newsletter login signup signin register widget "
    "widgets pagination pager skip copyright legal colophon contentinfo complementary navigation alert alertdialog dialog search form outbrain taboola teaser teasers trending".split()
)
_STARTS = ("advert", "sidebar", "cookie", "breadcrumb", "newsletter", "subscri", "sponsor", "navig", "navbar", "notif", "disclaim")
_MAIN = frozenset({"main", "articlebody"})


def unwanted(names: str) -> bool:
    """Whether class, id and role name a part that is no content."""
    words = _LETTERS.split(names)
    return not _WORDS.isdisjoint(words) or any(w.startswith(_STARTS) for w in words if w)


def _split(node: Shape) -> tuple[str, str]:
    tag, _, names = node.key.partition(" ")
    return tag, names


def contents(page: Shape, stats: dict[int, Shape], texts: int) -> list[bool]:
    """For each node of a page's shape, in preorder, whether its own text is content.

    stats: the wrapper's node for a node of the page; texts: different texts that the host's pages have, as far as known.
    """
    nodes = page.nodes()
    known = [stats.get(id(n), n) for n in nodes]
    sizes = {id(n): k.chars / max(1, k.pages) for n, k in zip(nodes, known, strict=True)}
    total: dict[int, float] = {}
    mains: dict[int, bool] = {}
    for n in reversed(nodes):
        tag, names = _split(n)
        total[id(n)] = sizes[id(n)] + sum(total[id(c)] for c in n.children)
        mains[id(n)] = any(mains[id(c)] for c in n.children) or tag in ("article", "main") and not unwanted(names)
    all_chars = total[id(page)]

    def out(n: Shape, inside: bool) -> bool:
        tag, names = _split(n)
        if tag in _OUT or not inside and (tag == "header" or "header" in _LETTERS.split(names)):
            # a form or dialog may hold the whole page
            return not (mains[id(n)] and (tag in ("form", "dialog", "fieldset") or total[id(n)] > all_chars / 2))
        return bool(names) and unwanted(names) and not (mains[id(n)] or tag not in ("article", "main") and total[id(n)] > 0.8 * all_chars)

    # the largest article that is in none of these parts, with its like beside it, or else the largest main part
    found: dict[str, list[Shape]] = {"article": [], "main": []}
    todo = [page]
    while todo:
        n = todo.pop()
        if n is not page and out(n, False):
            continue
        tag, names = _split(n)
        if tag == "article":
            found["article"].append(n)
        elif tag == "main" or not _MAIN.isdisjoint(_LETTERS.split(names)):
            found["main"].append(n)
        todo += reversed(n.children)
    roots = [page]
    for kind in ("main", "article"):
        if found[kind]:
            roots = [max(found[kind], key=lambda n: total[id(n)])]
    semantic = roots[0] is not page
    if semantic:
        beside = next(n.children for n in nodes if any(c is roots[0] for c in n.children))
        roots = [c for c in beside if c.key == roots[0].key]
    least = SUPPORT if semantic else 2

    keep: dict[int, bool] = {}
    todo = list(roots)
    while todo:
        n = todo.pop()
        if all(n is not r for r in roots) and out(n, semantic):
            continue
        k = stats.get(id(n), n)
        constant = k.low == k.high and k.pages >= least and texts >= least
        menu = not semantic and k.chars > 0 and k.linked > LINKED * k.chars
        keep[id(n)] = not constant and not menu
        todo += n.children
    return [keep.get(id(n), False) for n in nodes]


def written(block: Block, keep: dict[int, bool]) -> list[str]:
    """The blocks of text below a block, in page order; keep: of each block, whether its own text counts."""
    out: list[str] = []
    run: list[str] = []

    def close() -> None:
        text = " ".join("".join(run).split())
        run.clear()
        if text:
            out.append(text)

    def walk(b: Block) -> None:
        close()
        mine = keep.get(id(b), False)
        for item in b.items:
            if type(item) is not str:
                walk(item)
            elif mine:
                run.append(item)
        close()

    walk(block)
    return out


def main_text(html: str, wrapper: Shape | None = None, texts: int = 0, known: dict | None = None) -> str:
    """The main text of a page, by its host's wrapper if there is one. known remembers decisions by the page's shape."""
    root = parse(html)
    tree = shape(root)
    marks = known.get(tree.name) if known is not None and wrapper is not None else None
    if marks is None:
        if wrapper is None:
            measured(tree)
            stats: dict[int, Shape] = {}
        else:
            stats = {id(y): x for x, y in match(wrapper, tree)}
        marks = contents(tree, stats, texts)
        if known is not None and wrapper is not None:
            if len(known) >= HELD:
                known.clear()
            known[tree.name] = marks
    keep = {id(b): mark for node, mark in zip(tree.nodes(), marks, strict=True) for b in node.blocks}
    return "\n\n".join(written(root, keep))


# --- over all pages ------------------------------------------------------------------------------------------

_HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)"
_SUMS = ("pages", "chars", "linked")


def hosts(pages: DataFrame) -> DataFrame:
    """page_id, url, html and host (null: none) of each page."""
    host = F.lower(F.regexp_extract(F.col("url"), _HOST, 1))
    return pages.select("page_id", "url", "html", F.when(host != "", host).alias("host"))


def evidence(pages: DataFrame) -> DataFrame:
    """Sums per host, shape and node (host, shape, node, pages, chars, linked, low, high); node -1 has hashes of pages in low."""
    names = ["host", "shape", "node", *_SUMS, "low", "high"]
    kinds = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * 5]

    def run(batches):
        held: dict[tuple[str, str], list[list[int]]] = {}
        texts: dict[str, set[int]] = {}

        def rows():
            out = [(h, s, i, *r) for (h, s), nodes in held.items() for i, r in enumerate(nodes)]
            out += [(h, "", -1, 0, 0, 0, t, t) for h, some in texts.items() for t in sorted(some)[:SUPPORT]]
            held.clear()
            texts.clear()
            columns = list(zip(*out, strict=True)) if out else [()] * len(kinds)
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names)

        for batch in batches:
            for host, text in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                tree = measured(shape(parse(text or "")))
                nodes = tree.nodes()
                sums = held.get((host, tree.name))
                if sums is None:
                    sums = held[host, tree.name] = [[0, 0, 0, n.low, n.high] for n in nodes]
                for r, n in zip(sums, nodes, strict=True):
                    r[0], r[1], r[2], r[3], r[4] = r[0] + 1, r[1] + n.chars, r[2] + n.linked, min(r[3], n.low), max(r[4], n.high)
                some = texts.setdefault(host, set())
                some.add(hash((*[n.low for n in nodes], *[n.high for n in nodes])))
                if len(some) > 4 * SUPPORT:
                    texts[host] = set(sorted(some)[:SUPPORT])
                if len(held) >= HELD:
                    yield rows()
        yield rows()

    parts = pages.where("host IS NOT NULL").select("host", "html").mapInArrow(run, "host string, shape string, node int, pages long, chars long, linked long, low long, high long")
    sums = [F.sum(c).alias(c) for c in _SUMS]
    return parts.groupBy("host", "shape", "node").agg(
        *sums, F.min("low").alias("low"), F.max("high").alias("high"), F.approx_count_distinct(F.when(F.col("node") < 0, F.col("low"))).alias("texts")
    )


def _merged(trees: list[Shape]) -> str:
    wrapper = trees[0]
    for tree in trees[1:]:
        merge(wrapper, tree, None)
    return json.dumps(dump(wrapper))


def wrappers(pages: DataFrame) -> DataFrame:
    """host, wrapper (as text) and texts (different texts of its pages, as far as SUPPORT asks) of each host."""
    seen = materialize(evidence(pages), "shapes")
    texts = seen.where("node < 0").select("host", "texts")
    nodes = seen.where("node >= 0")
    groups = nodes.where("node = 0").groupBy("host").agg(F.count("*").alias("shapes"))
    part = F.pmod(F.xxhash64("shape"), F.ceil(F.col("shapes") / SHAPES)).cast("int")
    nodes = nodes.join(groups, "host").select("host", part.alias("part"), "shape", "node", *_SUMS, "low", "high")

    def first(table: pa.Table) -> pa.Table:
        rows = table.sort_by([("shape", "ascending"), ("node", "ascending")]).to_pylist()
        trees: list[Shape] = []
        last, todo = None, iter(())
        for r in rows:
            if r["shape"] != last:
                last = r["shape"]
                trees.append(unnamed(last))
                todo = iter(trees[-1].nodes())
            node = next(todo)
            node.pages, node.chars, node.linked, node.low, node.high = (r[c] for c in (*_SUMS, "low", "high"))
        return pa.table({"host": [rows[0]["host"]], "wrapper": [_merged(trees)]})

    def second(table: pa.Table) -> pa.Table:
        return pa.table({"host": table.column("host")[:1], "wrapper": [_merged([load(json.loads(w)) for w in sorted(table.column("wrapper").to_pylist())])]})

    out = nodes.groupBy("host", "part").applyInArrow(first, "host string, wrapper string")
    out = out.groupBy("host").applyInArrow(second, "host string, wrapper string")
    return out.join(texts, "host").select("host", "wrapper", "texts")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text (main text, empty if none) and n_chars of each page."""
    known = hosts(pages)
    found = materialize(wrappers(known), "wrappers")
    kinds = dict(known.dtypes)
    rows = known.join(found, "host", "left").select("page_id", "url", "html", "host", "wrapper", "texts")

    def run(batches):
        loaded: dict[str, tuple[Shape, dict]] = {}
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("html", "host", "wrapper", "texts")]
            out = []
            for html, host, wrapper, texts in zip(*columns, strict=True):
                if wrapper is None:
                    out.append(main_text(html or ""))
                    continue
                if host not in loaded:
                    if len(loaded) >= HELD // 10:
                        loaded.clear()
                    loaded[host] = load(json.loads(wrapper)), {}
                out.append(main_text(html or "", loaded[host][0], texts, loaded[host][1]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
