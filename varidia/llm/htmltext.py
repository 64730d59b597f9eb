"""Main text of HTML pages by wrapper induction.

Trees. A page becomes a tree of its block elements; inline elements are part of their block's text. An element's kind is
its name with its classes, digits as 0. Neighbours of the same shape become one node: paragraphs, list items and the
like always, others from three on. Elements that HTML defines as no content (nav, footer, aside, script and so on, roles such
as navigation, hidden ones) are left out.

Induction. Pages of one host and shape are summed up first: for each node the pages, whether its text, its first and its last
line are the same in all, words, words of links and repetitions. The trees of a host's shapes are aligned by
simple tree matching (the heaviest matching of children of the same kind, in order), some 32 at a time, in rounds
until one tree is left, the wrapper. So all pages take part and no task gets more than some dozens of trees. A node whose text is the same in all
pages of three or more that differ is template, and so is a first or last line; other nodes with text are slots.

Extraction. A page is aligned with its host's wrapper. Slots become content, unless statistics of the alignment show a menu or
advert: the main block is the article or main element with most words outside links, or else the lowest block with more
than half of them. Of what stands beside it in containers below the body, headings and paragraphs (or blocks of these) are content
if most of their words aren't links. Inside, records (blocks of one kind that come twice or more on some page, short, without
headings, each with a still shorter text such as a name or time, after the rest, less than half of the words), blocks of links (if there is no article) and articles in an article, which HTML defines as comments, are
left out. Classes and ids don't decide on what the alignment shows as text: HINTS such as ad or comments count only for small blocks
that have neither a heading nor a paragraph, or whose words are mostly links. A constant heading stays
if what follows it does. Pages alone in their host have the statistics of one page: nothing is template.

Character references are decoded, white space inside a block becomes one space, and blocks are joined by a
newline in page order; a line break element also ends a block. Null or empty html: empty text. Null url: the
host is empty. Broken markup is read as far as it goes; no step recurses, so nesting has no limit. The matching is the heaviest at any
size: time grows with the product of the two trees' nodes below the same kinds, memory with that of their distinct shapes. Repeated rows stay; columns named like the outputs are
replaced. An empty table gives an empty result. Wrappers are joined by broadcast only if they are ``small`` bytes at most.
"""

from __future__ import annotations

import hashlib
import html as html_lib
import json
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from math import isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import removed, written

GROUP = 32  # trees that one task aligns
EVIDENCE = 3  # pages that must have the same text
SMALL = 32 << 20

# Fixed values of HTML: kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp template".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
SKIP = frozenset("head nav footer aside script style noscript template svg math iframe object canvas button select textarea dialog menu title audio video map".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SAME_CLOSES = frozenset("li dt dd tr td th option p thead tbody tfoot".split())
NO_BREAK = INLINE | frozenset("script style template".split())
PARAGRAPH = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr td th blockquote pre figure figcaption caption".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
LIST = frozenset("li dt dd tr td th thead tbody tfoot".split())
ROOTS = frozenset(("article", "main"))
SCOPE = frozenset("ul ol dl table div article section main body".split())
ROLE = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar".split())
HINTS = re.compile(
    r"(?:^|[\s_-])(?:ads?|adv|advert\w*|sponsored|promo|sidebar|menu|nav|navbar|navigation|breadcrumbs?|footer|cookies?|gdpr|comments?|disqus|newsletter|subscribe|signup|login|popup|modal|pagination)(?:$|[\s_-])",
    re.I,
)

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
_ATTR = re.compile(r"(?:^|\s)(class|id|role|hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_RAW_END = {name: re.compile(rf"</{name}\s*>|\Z", re.I) for name in RAW}


def _kind(name: str, attrs: str) -> tuple[str, bool]:
    """An element's kind, name, classes and a mark for a hint (* by class, + by id), and whether it's no content by HTML's definition."""
    bad = name in SKIP
    classes = mark = ""
    if attrs and not attrs.isspace():
        for key, a, b, c in _ATTR.findall(attrs):
            key, value = key.lower(), a or b or c
            if key == "class":
                classes = ".".join(sorted(re.sub(r"\d+", "0", value).split()))
                mark = "*" if HINTS.search(value) else mark
            elif key == "id":
                mark = mark or "+" * bool(HINTS.search(value))
            else:
                bad |= key == "hidden" or value.lower() in ROLE
    return f"{name}.{classes}|{mark}", bad


def events(page: str) -> Iterator[tuple[str, str, bool, str]]:
    """(what, name, no content, kind or text): what is open, close, text or line."""
    at, n = 0, len(page)
    stack: list[str] = []
    count: Counter = Counter()

    def close(name: str) -> Iterator[tuple[str, str, bool, str]]:
        while stack:
            top = stack.pop()
            count[top] -= 1
            yield "close", top, False, ""
            if top == name:
                return

    while m := _TAG.search(page, at):
        if m.start() > at:
            yield "text", "", False, page[at : m.start()]
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            if count[name]:
                yield from close(name)
            continue
        if name in ("br", "hr"):
            yield "line", name, False, ""
            continue
        if name in VOID:
            continue
        if name in CLOSES_P and count["p"]:
            yield from close("p")
        elif name in SAME_CLOSES:
            for top in reversed(stack):
                if top == name or {top, name} <= {"dt", "dd"} or {top, name} <= {"td", "th"}:
                    yield from close(top)
                    break
                if top in SCOPE:
                    break
        kind, bad = _kind(name, m[3])
        yield "open", name, bad, kind
        if m[3].rstrip().endswith("/") and name in ("svg", "path", "use"):
            yield "close", name, False, ""
        elif name in RAW:
            at = _RAW_END[name].search(page, at).end()
            yield "close", name, False, ""
        else:
            stack.append(name)
            count[name] += 1
    if at < n:
        yield "text", "", False, page[at:]
    while stack:
        yield "close", stack.pop(), False, ""


class Tree:
    """Nodes in an order in which parents come before their children; node 0 is the page. stats is empty or has a row for each."""

    def __init__(self) -> None:
        self.kinds = ["|"]
        self.parents = [-1]
        self.kids: list[list[int]] = [[]]
        self.stats: list[list] = []

    def add(self, kind: str, parent: int) -> int:
        self.kinds.append(kind)
        self.parents.append(parent)
        self.kids.append([])
        self.kids[parent].append(len(self.kinds) - 1)
        return len(self.kinds) - 1

    def name(self, v: int) -> str:
        return self.kinds[v].partition(".")[0]

    def dump(self) -> str:
        """As text: kinds, parents, stats; children are in the order of their numbers."""
        order, to = [0], {0: 0}
        for v in order:
            for x in self.kids[v]:
                to[x] = len(order)
                order.append(x)
        return json.dumps([[self.kinds[v] for v in order], [to.get(self.parents[v], -1) for v in order], [self.stats[v] for v in order] if self.stats else []], ensure_ascii=False)

    @staticmethod
    def load(text: str) -> Tree:
        t = Tree()
        kinds, parents, t.stats = json.loads(text)
        for k, p in zip(kinds[1:], parents[1:], strict=True):
            t.add(k, p)
        return t


def parse(page: str) -> tuple[Tree, list[tuple[int, str, int]]]:
    """The tree of a page's block elements, and its lines in order: node, text, words inside links."""
    tree, at, lines = Tree(), 0, []
    part: list[str] = []
    linked: list[str] = []
    stack: list[tuple[str, bool, int]] = []  # name, no content, node before
    bad = links = 0

    def flush() -> None:
        if part:
            if text := " ".join(html_lib.unescape("".join(part)).split()):
                lines.append((at, text, len("".join(linked).split())))
            part.clear()
            linked.clear()

    for what, name, skip, kind in events(page):
        if what == "text":
            if not bad:
                part.append(kind)
                if links:
                    linked.append(kind)
        elif what == "line":
            flush()
        elif what == "open":
            block = name not in NO_BREAK
            if block:
                flush()
            stack.append((name, skip, at))
            bad += skip
            links += name == "a"
            if block and not bad:
                at = tree.add(kind, at)
        else:
            if name not in NO_BREAK:
                flush()
            top, skip, before = stack.pop()
            bad -= skip
            links -= top == "a"
            at = before
    flush()
    return tree, lines


def _runs(tree: Tree, v: int, shape: list) -> list[list[int]]:
    """The children of a node, those that become one node together."""
    out: list[list[int]] = []
    for x in tree.kids[v]:
        if out and shape[out[-1][0]] == shape[x]:
            out[-1].append(x)
        else:
            out.append([x])
    return [part for run in out for part in ([run] if len(run) > 2 or tree.name(run[0]) in PARAGRAPH else [[x] for x in run])]


def shapes(tree: Tree) -> list[int]:
    """A number for each node; equal ones stand for equal subtrees but for repetitions."""
    known: dict[tuple, int] = {}
    out = [0] * len(tree.kinds)
    for v in range(len(tree.kinds) - 1, -1, -1):
        key = (tree.kinds[v], *(out[run[0]] for run in _runs(tree, v, out)))
        out[v] = known.setdefault(key, len(known))
    return out


def skeleton(tree: Tree) -> tuple[Tree, list[int], list[int]]:
    """The tree with repetitions as one node, the node of each node of the page, and how many each stands for."""
    shape, out = shapes(tree), Tree()
    node, times = [0] * len(tree.kinds), [1]
    todo = [0]
    for v in todo:
        runs = _runs(tree, v, shape)
        mine = out.kids[node[v]]
        for i, run in enumerate(runs):
            if i == len(mine):
                out.add(tree.kinds[run[0]], node[v])
                times.append(0)
            for x in run:
                node[x] = mine[i]
            times[mine[i]] = max(times[mine[i]], len(run))
            todo += run
    return out, node, times


def _digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def page_stats(page: str) -> Tree:
    """A page's skeleton with a row of figures for each node.

    pages, least and greatest digest of the text, of the first line, of the last line, of the page; words, words in links, repetitions, pages with text.
    """
    tree, lines = parse(page)
    out, node, times = skeleton(tree)
    texts: list[list[str]] = [[] for _ in out.kinds]
    words, links = [0] * len(out.kinds), [0] * len(out.kinds)
    for at, text, inside in lines:
        texts[node[at]].append(text)
        words[node[at]] += len(text.split())
        links[node[at]] += inside
    key = _digest(page)
    for v, t in enumerate(texts):
        whole, first, last = (_digest("\n".join(t)), _digest(t[0]), _digest(t[-1])) if t else (0, 0, 0)
        out.stats.append([1, whole, whole, first, first, last, last, key, key, words[v], links[v], times[v], int(bool(t))])
    return out


N, LO, HI, F_LO, F_HI, L_LO, L_HI, P_LO, P_HI, WORDS, LINKS, TIMES, FULL = range(13)


def add_stats(a: list, b: list) -> list:
    """Of two sets of pages together; a node without text has no say on texts."""
    out = [a[N] + b[N]]
    for lo, hi in ((LO, HI), (F_LO, F_HI), (L_LO, L_HI)):
        if not a[FULL] or not b[FULL]:
            x = a if a[FULL] else b
            out += [x[lo], x[hi]]
        else:
            out += [min(a[lo], b[lo]), max(a[hi], b[hi])]
    return [*out, min(a[P_LO], b[P_LO]), max(a[P_HI], b[P_HI]), a[WORDS] + b[WORDS], a[LINKS] + b[LINKS], max(a[TIMES], b[TIMES]), a[FULL] + b[FULL]]


def tree_match(a: Tree, b: Tree) -> dict[int, int]:
    """Simple tree matching: for nodes of b, the nodes of a that they are aligned with; the roots are."""
    known: dict[tuple, int] = {}
    shape: list[list[int]] = []
    size: list[list[int]] = []
    for t in (a, b):
        shape.append([0] * len(t.kinds))
        size.append([1] * len(t.kinds))
        for v in _upwards(t):
            shape[-1][v] = known.setdefault((t.kinds[v], *(shape[-1][x] for x in t.kids[v])), len(known))
            size[-1][v] += sum(size[-1][x] for x in t.kids[v])
    # nodes below the same kinds, one of each shape: shape to node of a and of b; below has their children's groups by kind
    groups = [({shape[0][0]: 0}, {shape[1][0]: 0})]
    below: list[dict[str, int]] = []
    for sides in groups:
        below.append({})
        if len(sides[0]) > 1 or sides[0].keys() != sides[1].keys():
            found: list[dict[str, dict[int, int]]] = [{}, {}]
            for t, s, nodes, by in zip((a, b), shape, sides, found, strict=True):
                for v in nodes.values():
                    for x in t.kids[v]:
                        by.setdefault(t.kinds[x], {}).setdefault(s[x], x)
            for kind in found[0]:
                if kind in found[1]:
                    below[-1][kind] = len(groups)
                    groups.append((found[0][kind], found[1][kind]))
    rows, columns = ([{s: i for i, s in enumerate(sides[k])} for sides in groups] for k in (1, 0))
    weight: list[np.ndarray] = [np.ones((len(y), len(x)), np.int32) for x, y in groups]
    for g in range(len(groups) - 1, -1, -1):
        left, right = groups[g]
        if left.keys() == right.keys() and len(left) == 1:
            weight[g][0, 0] = size[0][next(iter(left.values()))]
        elif below[g]:
            _weigh(weight, g, below[g], a, b, shape, groups[g], rows, columns)
    out, todo = {}, [(0, 0, 0)]
    for v, w, g in todo:
        out[w] = v
        if shape[0][v] == shape[1][w]:
            todo += [(x, y, 0) for x, y in zip(a.kids[v], b.kids[w], strict=True)]
            continue
        both = {a.kinds[x] for x in a.kids[v]} & {b.kinds[y] for y in b.kids[w]}
        lefts, rights = [x for x in a.kids[v] if a.kinds[x] in both], [y for y in b.kids[w] if b.kinds[y] in both]
        place = {kind: np.array([i for i, y in enumerate(rights) if b.kinds[y] == kind]) for kind in both}
        which = {kind: np.array([rows[below[g][kind]][shape[1][rights[i]]] for i in at]) for kind, at in place.items()}

        def gain(x: int) -> np.ndarray:
            kind, out = a.kinds[x], np.zeros(len(rights), np.int64)
            k = below[g][kind]
            out[place[kind]] = weight[k][which[kind], columns[k][shape[0][x]]]
            return out

        todo += [(x, rights[j], below[g][a.kinds[x]]) for x, j in _heaviest(lefts, len(rights), gain)]
    return out


def _upwards(t: Tree) -> Iterator[int]:
    order = [0]
    for v in order:
        order += t.kids[v]
    return reversed(order)


def _weigh(weight: list, g: int, below: dict[str, int], a: Tree, b: Tree, shape: list, sides: tuple, rows: list, columns: list) -> None:
    """Fills in the weights of a group's pairs; a node of b is matched with all of a's at once, whose children lie in one line."""
    line, ends = [], []
    place: dict[str, list[int]] = {kind: [] for kind in below}
    which: dict[str, list[int]] = {kind: [] for kind in below}
    for i, v in enumerate(sides[0].values()):
        line.append(i)  # before the first child
        for x in a.kids[v]:
            if (kind := a.kinds[x]) in below:
                place[kind].append(len(line))
                which[kind].append(columns[below[kind]][shape[0][x]])
                line.append(i)
        ends.append(len(line) - 1)
    at, of = ({kind: np.array(x) for kind, x in d.items()} for d in (place, which))
    start = np.array(line) * len(a.kinds)  # a later node's values are above those of all before it
    for j, w in enumerate(sides[1].values()):
        best = start.copy()
        for y in b.kids[w]:
            if (kind := b.kinds[y]) in below:
                k, i = below[kind], at[kind]
                best[i] = np.maximum(best[i], best[i - 1] + weight[k][rows[k][shape[1][y]]][of[kind]])
                np.maximum.accumulate(best, out=best)
        weight[g][j] = (best - start)[ends] + 1


def _heaviest(left: list[int], n: int, gain: Callable[[int], np.ndarray]) -> list[tuple[int, int]]:
    """The heaviest matching of children with n others that keeps both orders; gain has a child's weights. Every so many lines are kept, those between computed again."""

    def lines(line: np.ndarray, part: list[int]) -> list[np.ndarray]:
        out = [line]
        for x in part:
            line = line.copy()
            line[1:] = np.maximum(line[1:], line[:-1] + gain(x))
            np.maximum.accumulate(line, out=line)
            out.append(line)
        return out

    if len(left) == n == 1:
        return [(left[0], 0)]
    step = isqrt(len(left)) + 64
    parts = [left[i : i + step] for i in range(0, len(left), step)]
    kept = [np.zeros(n + 1, np.int64)]
    for part in parts[:-1]:
        kept.append(lines(kept[-1], part)[-1])
    out, j = [], n
    for part, line in zip(reversed(parts), reversed(kept), strict=False):
        best, i = lines(line, part), len(part)
        while i and j:
            if best[i][j] == best[i - 1][j]:
                i -= 1
            elif best[i][j] == best[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                out.append((part[i], j))
    return out[::-1]


def merge(a: Tree, b: Tree) -> Tree:
    """a with b aligned into it: figures of aligned nodes are added, other nodes of b are put in after their neighbours."""
    to = tree_match(a, b)
    todo = [0]
    for w in todo:
        v = to[w]
        after = 0
        for y in b.kids[w]:
            if y in to:
                after = a.kids[v].index(to[y]) + 1
                a.stats[to[y]] = add_stats(a.stats[to[y]], b.stats[y])
            else:
                to[y] = a.add(b.kinds[y], v)
                a.kids[v].insert(after, a.kids[v].pop())
                a.stats.append(list(b.stats[y]))
                after += 1
            todo.append(y)
    a.stats[0] = add_stats(a.stats[0], b.stats[0])
    return a


def content(tree: Tree, stats: list[list]) -> dict[int, tuple[bool, bool]]:
    """The nodes of a page whose lines are content, and whether their first and last lines are template; stats has the wrapper's figures."""
    n = len(tree.kinds)
    names = [tree.name(v) for v in range(n)]
    enough = [s[FULL] >= EVIDENCE and s[P_LO] != s[P_HI] for s in stats]
    constant = [enough[v] and stats[v][LO] == stats[v][HI] for v in range(n)]
    order = list(_upwards(tree))
    full = [s[FULL] for s in stats]
    words, links = ([s[i] / max(1, s[N]) for s in stats] for i in (WORDS, LINKS))
    own = [0.0 if constant[v] else max(0.0, words[v] - links[v]) * (1 if names[v] in PARAGRAPH else 0.6) for v in range(n)]
    mass, all_words, all_links, heads, paras = list(own), list(words), list(links), [0] * n, [0] * n
    for v in order:
        heads[v] += names[v] in HEADING and bool(full[v])
        paras[v] += names[v] in PARAGRAPH and bool(full[v])
        if v:
            p = tree.parents[v]
            for total in (mass, all_words, all_links, heads, paras):
                total[p] += total[v]
    form = {v for v in range(n) if names[v] == "form"}
    wraps = {v for v in form if paras[v] and all_words[v] > 0.5 * all_words[0]}
    out_of = {v for v in form - wraps} | {v for v in range(n) if names[v] == "header"}
    for v in out_of:  # a header or form counts for the main block only from inside
        gone, p = mass[v], tree.parents[v]
        while p >= 0 and names[p] not in ROOTS:
            mass[p] -= gone
            p = tree.parents[p]

    def above(v: int) -> list[int]:
        path = []
        while v > 0:
            v = tree.parents[v]
            path.append(v)
        return path

    roots = [v for v in range(n) if names[v] in ROOTS and full_below(tree, v, full) and not any(names[p] in ("article",) for p in above(v)) and not out_of & {*above(v)}]
    explicit = bool(roots)
    if explicit:
        main = max(roots, key=lambda v: (mass[v], -v))
        inner = [v for v in roots if main in above(v) and mass[v] >= 0.5 * mass[main]]
        main = max(inner, key=lambda v: (mass[v], -v)) if inner else main
        starts = [main] + [v for v in roots if v != main and names[v] == "article" == names[main] and heads[v] and mass[v] >= 0.5 * mass[main]]
    else:
        main = 0
        while True:
            best = max((x for x in tree.kids[main] if x not in out_of), key=lambda v: mass[v], default=None)
            if best is None or mass[best] <= 0.5 * mass[main] or names[best] in PARAGRAPH or names[best] in ("ul", "ol", "dl", "table") and names[main] not in ("body", "html", "|"):
                break
            main = best
        starts = [main]

    def prose(v: int) -> bool:
        return v not in out_of and paras[v] > 0 and 2 * all_links[v] < all_words[v] and not records(v)

    def signed(v: int) -> bool:
        """Whether a block has a short text of its own, as a name or time, beside a longer one."""
        texts = [words[x] for x in _below(tree, v) if full[x]]
        return len(texts) > 1 and 4 * min(texts) <= sum(texts)

    def alike(group: list[int]) -> float:
        """The words in those of some nodes that are short signed blocks of one kind without headings that come several times; 0 if others do too."""
        group = [x for x in group if names[x] not in PARAGRAPH and names[x] not in LIST and tree.kids[x]]
        count: Counter = Counter()
        for x in group:
            count[tree.kinds[x]] += max(1, stats[x][TIMES])
        group = [x for x in group if count[tree.kinds[x]] > 1]
        inside = sum(all_words[x] for x in group)
        if all(signed(x) for x in group) and not any(heads[x] for x in group) and inside < 80 * sum(count[k] for k in {tree.kinds[x] for x in group}):
            return inside
        return 0.0

    kin: dict[int, dict[str, float]] = {}  # by parent and kind

    def records(v: int) -> bool:
        """Records: a node and its like, or most of what it holds."""
        p = tree.parents[v]
        if p not in kin:
            kinds: dict[str, list[int]] = {}
            for x in tree.kids[p]:
                kinds.setdefault(tree.kinds[x], []).append(x)
            kin[p] = {kind: alike(group) for kind, group in kinds.items()}
        return 2 * max(kin[p][tree.kinds[v]], alike(tree.kids[v])) > all_words[v]

    beside: list[int] = []
    if not explicit or names[main] != "main":
        titled = any(names[y] == "h1" for y in _below(tree, main))
        for child, p in zip([main, *above(main)], above(main), strict=False):
            if names[p] in ("|", "html") or names[p] == "body" and (explicit or not any(names[x] == "h1" for x in tree.kids[p])):
                continue
            for x in tree.kids[p]:
                title = names[x] in ("h1", "header") and not titled and (x not in out_of or heads[x])
                if x != child and (title or not explicit and prose(x)):
                    beside.append(x)
            if not explicit:
                beside.append(-p)  # its own lines

    def walk(drop_records: bool) -> tuple[dict[int, tuple[bool, bool]], set[int], float]:
        """Kept nodes, all that were looked at, and the words in records that were left out."""
        keep: dict[int, tuple[bool, bool]] = {-p: (False, False) for p in beside if p < 0}
        part_of, left = set(), 0.0
        todo = [(v, True) for v in starts] + [(x, False) for x in beside if x > 0]
        for v, start in todo:
            part_of.add(v)
            mark = tree.kinds[v].rpartition("|")[2]
            if not start:
                if v in form and v not in wraps or names[v] == "article" and explicit:
                    continue
                if mark and 2 * all_words[v] < all_words[main] and names[v] not in PARAGRAPH and (not paras[v] or 2 * all_links[v] > all_words[v]):
                    continue
                if names[v] not in PARAGRAPH and tree.kids[v]:
                    later = tree.kids[tree.parents[v]]
                    later = later[later.index(v) + 1 :]
                    if drop_records and records(v) and not any(names[x] in ("p", *HEADING) and full[x] for x in later):
                        left += mass[v]
                        continue
                    if not explicit and all_words[v] and all_links[v] >= 0.8 * all_words[v] and 2 * all_words[v] < all_words[main]:
                        continue
            if not constant[v]:
                keep[v] = (enough[v] and stats[v][F_LO] == stats[v][F_HI], enough[v] and stats[v][L_LO] == stats[v][L_HI])
            todo += [(x, False) for x in tree.kids[v]]
        return keep, part_of, left

    keep, part_of, left = walk(True)
    if 2 * left >= mass[main]:  # they are the text itself
        keep, part_of, _ = walk(False)
    for v in sorted(part_of, reverse=True):  # constant headings
        if constant[v] and names[v] in HEADING and v not in keep:
            siblings = tree.kids[tree.parents[v]]
            after = next((x for x in siblings[siblings.index(v) + 1 :] if names[x] not in HEADING), None)
            if after is not None and (after in keep and after in part_of and (full[after] or any(x in keep for x in tree.kids[after]))):
                keep[v] = (False, False)
    return keep


def full_below(tree: Tree, v: int, full: list[int]) -> bool:
    return any(full[x] for x in _below(tree, v))


def _below(tree: Tree, v: int) -> list[int]:
    out = [v]
    for x in out:
        out += tree.kids[x]
    return out


@lru_cache(maxsize=64)
def _wrapper(text: str) -> Tree:
    return Tree.load(text)


@lru_cache(maxsize=4096)
def _decided(wrapper: str, shape: str) -> dict[int, tuple[bool, bool]]:
    tree, host = Tree.load(shape), _wrapper(wrapper)
    to = tree_match(host, tree)
    nothing = [0] * 13
    return content(tree, [host.stats[to[v]] if v in to else nothing for v in range(len(tree.kinds))])


def main_text(page: str | None, wrapper: str | None = None) -> str:
    """The text of a page; wrapper is that of its host, as text; without one, the page is its own."""
    if not page:
        return ""
    tree, lines = parse(page)
    if not lines:
        return ""
    if wrapper is None:
        wrapper = page_stats(page).dump()
    small, node, _ = skeleton(tree)
    # dump numbers nodes by level, as skeleton does
    keep = _decided(wrapper, small.dump())
    last = {node[at]: i for i, (at, _, _) in enumerate(lines)}
    out, seen = [], set()
    for i, (at, text, _) in enumerate(lines):
        v = node[at]
        first = v not in seen
        seen.add(v)
        if v in keep and not (first and keep[v][0]) and not (last[v] == i and keep[v][1]):
            out.append(text)
    return "\n".join(out)


def induce(pages: list[str]) -> str | None:
    """The wrapper of some pages of one host, as text."""
    trees = [page_stats(p) for p in dict.fromkeys(pages) if p]
    if not trees:
        return None
    first = trees[0]
    for t in trees[1:]:
        merge(first, t)
    return first.dump()


def host_of(url):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


FIGURES = ["n", "lo", "hi", "f_lo", "f_hi", "l_lo", "l_hi", "p_lo", "p_hi", "words", "links", "times", "has"]


def shape_trees(pages: DataFrame) -> DataFrame:
    """(host, tree): for each shape of a host's pages its tree with the figures of all of them; the figures are summed before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple[str, str], Tree] = {}
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                t = page_stats(page)
                stats, t.stats = t.stats, []
                shape = t.dump()
                if (host, shape) in found:
                    t = found[host, shape]
                    t.stats = [add_stats(a, b) for a, b in zip(t.stats, stats, strict=True)]
                else:
                    t.stats = stats
                    found[host, shape] = t
            columns: list[list] = [[] for _ in range(4 + len(FIGURES))]
            for (host, shape), t in found.items():
                key = _digest(shape)
                for v, row in enumerate(t.stats):
                    for c, x in zip(columns, (host, key, v, None if v else shape, *row), strict=True):
                        c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    names = ["host", "shape", "node", "tree", *FIGURES]
    types = [pa.string(), pa.int64(), pa.int32(), pa.string(), *[pa.int64()] * len(FIGURES)]
    rows = pages.select(host_of(F.col("url")).alias("host"), "html").filter("html != ''")
    rows = rows.mapInArrow(run, "host string, shape bigint, node int, tree string, " + ", ".join(f"{c} bigint" for c in FIGURES))
    # a node without text has digest 0 in all of its rows, but has no say
    text = lambda f, c: F.coalesce(f(F.when(F.col("has") > 0, F.col(c))), F.lit(0)).alias(c)
    figures = [F.sum("n").alias("n"), *(text(F.max if c.endswith("hi") else F.min, c) for c in FIGURES[1:7]), F.min("p_lo").alias("p_lo"), F.max("p_hi").alias("p_hi"), F.sum("words").alias("words"), F.sum("links").alias("links"), F.max("times").alias("times"), F.sum("has").alias("has")]
    nodes = rows.groupBy("host", "shape", "node").agg(*figures, F.min("tree").alias("tree"))
    each = nodes.groupBy("host", "shape").agg(F.min("tree").alias("tree"), F.sort_array(F.collect_list(F.struct("node", F.array(*FIGURES).alias("s")))).alias("s"))

    @F.arrow_udf("string")
    def joined(tree: pa.Array, stats: pa.Array) -> pa.Array:
        out = []
        for text_, rows_ in zip(tree.to_pylist(), stats.to_pylist(), strict=True):
            kinds, parents, _ = json.loads(text_)
            out.append(json.dumps([kinds, parents, [r["s"] for r in rows_]], ensure_ascii=False))
        return pa.array(out, pa.string())

    return each.select("host", joined("tree", "s").alias("tree"))


def _merge_group(pdf: pd.DataFrame) -> pd.DataFrame:
    trees = pdf["tree"].sort_values().tolist()
    first = Tree.load(trees[0])
    for t in trees[1:]:
        merge(first, Tree.load(t))
    return pd.DataFrame({"host": [pdf["host"].iloc[0]], "tree": [first.dump()]})


def induce_wrappers(pages: DataFrame, group: int = GROUP) -> tuple[DataFrame, str]:
    """(host, tree), the wrapper of each host as a written table, and its path."""
    spark = pages.sparkSession
    trees, path = written(shape_trees(pages), "trees")
    while True:
        counts = trees.groupBy("host").agg(F.count("*").alias("c"))
        if (counts.agg(F.max("c")).first()[0] or 0) <= 1:
            return trees, path
        dealt = trees.join(counts.filter("c > 1"), "host")
        part = F.when(F.col("c") <= 2 * group, F.lit(0)).otherwise(F.pmod(F.xxhash64("tree"), F.ceil(F.col("c") / group)))
        merged = dealt.select("host", "tree", part.alias("part")).groupBy("host", "part").applyInPandas(_merge_group, "host string, tree string")
        last = path
        trees, path = written(trees.join(counts.filter("c = 1").select("host"), "host", "left_semi").unionByName(merged), "trees")
        removed(spark, last)


def extract_text(pages: DataFrame, small: int = SMALL) -> DataFrame:
    """pages with text (the main text) and n_chars."""
    wrappers, _ = induce_wrappers(pages.select("url", "html"))
    wrappers = wrappers.toDF("__host", "__tree")
    if (wrappers.agg(F.sum(F.length("__tree"))).first()[0] or 0) <= small:
        wrappers = F.broadcast(wrappers)

    @F.arrow_udf("string")
    def run(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for html, tree in parts:
            yield pa.array([main_text(p, t) for p, t in zip(html.to_pylist(), tree.to_pylist(), strict=True)], pa.string())

    out = pages.withColumn("__h", host_of(F.col("url")))
    out = out.join(wrappers, F.col("__h") == F.col("__host"), "left")
    out = out.withColumn("text", run("html", "__tree")).withColumn("n_chars", F.length("text").cast("long"))
    return out.drop("__h", "__host", "__tree")


def op10_htmltext(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract_text(pages).select("page_id", "url", "text", "n_chars")
