"""Main text of web pages by wrapper induction.

Pages of a host are parsed to DOM trees and folded into the host's wrapper: simple tree matching
aligns a page with the wrapper, aligned nodes count the page, and a text of a node that all pages
with this node have is constant (template) while others fill varying slots.  Runs of like siblings
share one wrapper node with the texts of all of them.  Each task folds its own pages, so a host with a third of
all pages is as many small wrappers as tasks, which are then folded into one.  A page is read to
its end, at any depth.  Copies of a page count once.  A wrapper keeps every place, however few pages
have it: that of a host without a common layout grows with its pages.  Children of many different
keys are aligned by pairs of like keys alone; a task that holds too many places passes them on as
one more small wrapper of each host; a wrapper too long to stand beside every page is sent once to
each task that reads pages of its host.  One task folds a host's whole wrapper, which it must hold.

What a page's content is, its host's wrapper decides.  Nodes that are constant with all below them
(in places of at least ``LEAST_PAGES`` pages) are template, wherever they stand.  Of the varying
text that is left each element has a worth: characters of varying text outside of links, less those
of what says that it is something else.  The content is the worthiest slot: from the root down to
the smallest elements that hold nearly all of the worth.  Names are features of the worth and no
more: an ``article`` or ``main`` element counts ``FAVOUR`` times, elements that cannot hold prose
(menus, forms, scripts) and regions whose role or class names them count nothing, but only as long
as they hold the lesser part of what varies around them: a class alone does not part a page from
its body.  Hosts of fewer pages have no wrapper to speak of: there names and worth decide alone.

Defined results: null or empty html gives empty text; null url is the host of no name; repeated
rows give repeated results; of slots that tie the first is taken; very long and very deep pages are
read whole; an empty table gives no rows.  Only ``page_id``, ``url`` and ``html`` are read, so other
columns may have any names.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_folder, table

#: Like siblings of more than WIDEST remaining children share a place even when others stand between.
LEAST_PAGES, WIDEST = 3, 100
#: Cells of a table of alignment, places a task holds before it passes them on, characters of a
#: wrapper that stands beside each page, pages for one copy of a longer one.  None drops anything;
#: as with other tasks, the first two can choose another of several alignments that are as heavy.
DENSE, HELD, BESIDE, PAGES_A_COPY = 1 << 16, 100_000, 1 << 16, 2000
#: How much more the text of an article or main element is worth, and which share of it is nearly all.
FAVOUR, NEARLY = 3.0, 0.8
#: Levels that a wrapper describes; what is deeper counts as varying.
DEEPEST = 150
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>|([^<]+|<)", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][^\s=/>]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
#: Opening one of these ends an open paragraph.
BREAKS_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
SAME_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = {"ul", "ol", "dl", "table", "select", "body", "html", "article", "section", "div", "main", "nav", "aside", "footer", "header", "form"}
NEVER = {"script", "style", "noscript", "template", "nav", "aside", "form", "button", "select", "textarea", "iframe", "svg", "canvas", "head", "title", "menu", "dialog", "object", "input"}
ROLE_NEVER = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar"}
NOISE = re.compile(r"(?:^|[\s_-])(?:ad|ads|adv|advert|adverts|advertisement|advertising|sponsor|sponsored|promo|banner|nav|navbar|navigation|menu|breadcrumb|breadcrumbs|sidebar|side|aside|footer|foot|masthead|topbar|toolbar|cookie|cookies|consent|gdpr|notice|popup|modal|overlay|newsletter|subscribe|signup|share|sharing|social|related|recommended|comment|comments|commentlist|reply|replies|respond|disqus|discussion|widget|login|search|pagination|pager|tags|copyright|legal)(?:$|[\s_-])", re.I)
SITE_HEADER = re.compile(r"(?:^|[\s_-])(?:site|page|top|global|main)[_-]?header(?:$|[\s_-])", re.I)
MAIN = {"article", "main"}
#: Elements that group others: a class can name what such a group is for.
REGIONS = {"div", "section", "ul", "ol", "dl", "table", "details", "figure", "blockquote", "center", "td", "fieldset"}


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        self.tag, self.attrs, self.children = tag, attrs or {}, []


def parse(page: str) -> Node:
    """A forgiving DOM: children are nodes and strings of decoded text."""
    root = Node("#root")
    stack, raw_until, at, deepest = [root], None, 0, 1
    while at < len(page):
        if raw_until:
            end = re.compile(rf"</{re.escape(raw_until)}\b[^>]*>", re.I).search(page, at)
            stop = end.start() if end else len(page)
            if raw_until in ("title", "textarea"):
                stack[-1].children.append(entities.unescape(page[at:stop]))
            stack.pop()
            at, raw_until = end.end() if end else len(page), None
            continue
        m = TOKEN.match(page, at)
        if m is None:  # an unclosed tag: the rest is text
            stack[-1].children.append(entities.unescape(page[at:]))
            break
        at = m.end()
        if m[4] is not None:
            stack[-1].children.append(entities.unescape(m[4]))
            continue
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if stack[k].tag in ("article", "main", "body") and tag in INLINE | {"p"}:
                    break
            continue
        if tag in BREAKS_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    del stack[k:]
                    break
                if stack[k].tag not in INLINE:
                    break
        if tag in SAME_ENDS:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in SAME_ENDS[tag]:
                    del stack[k:]
                    break
                if stack[k].tag in SCOPES:
                    break
        attrs = {a[1].lower(): entities.unescape(a[2] or a[3] or a[4] or "") for a in ATTRIBUTE.finditer(m[3])} if m[3].strip(" /") else {}
        node = Node(tag, attrs)
        stack[-1].children.append(node)
        if tag not in VOID and not m[3].endswith("/"):
            stack.append(node)
            deepest = max(deepest, len(stack))
            raw_until = tag if tag in RAW else None
    # Walks over the tree go as deep as it is; Python frames need no more than memory.
    if 4 * deepest + 1000 > sys.getrecursionlimit():
        sys.setrecursionlimit(4 * deepest + 1000)
    return root


def never(node: Node, inside: bool) -> bool:
    """True for elements that cannot hold an article's prose, whatever the page."""
    tag, attrs = node.tag, node.attrs
    if tag in NEVER or attrs.get("role", "").lower() in ROLE_NEVER or "hidden" in attrs or attrs.get("aria-hidden") == "true":
        return True
    # The heading of an article is part of it; that of a page is not.
    return tag == "footer" or (tag == "header" and not inside)


def named_noise(node: Node) -> bool:
    """True if a region's class or id says that it is not content; a paragraph is no region."""
    name = f"{node.attrs.get('class', '')} {node.attrs.get('id', '')}"
    return node.tag in REGIONS and bool(name.strip()) and bool(NOISE.search(name) or SITE_HEADER.search(name))


def key_of(node: Node) -> str:
    return f"{node.tag}.{' '.join(sorted(node.attrs.get('class', '').split()))}" if node.attrs.get("class") else node.tag


# --- wrappers: nested lists [key, pages, digests of the own texts that all pages have, children] ---


def own_text(node: Node) -> str:
    return " ".join(" ".join(c for c in node.children if isinstance(c, str)).split())


def digest(text: str) -> str:
    return hashlib.md5(text.encode()).hexdigest()[:12]


def once_each(tree: list) -> None:
    tree[1] = 1
    for child in tree[3]:
        once_each(child)


def tree_of(node: Node, depth: int = 0) -> list:
    """A page as a wrapper of one page; like siblings in a row become one node of all their texts."""
    own = own_text(node)
    tree = [key_of(node), 1, [digest(own)] if own else [], []]
    for child in node.children if depth < DEEPEST else ():
        if isinstance(child, str) or child.tag in ("script", "style"):
            continue
        t = tree_of(child, depth + 1)
        if tree[3] and tree[3][-1][0] == t[0]:
            fold(tree[3][-1], t, siblings=True)
            once_each(tree[3][-1])
        else:
            tree[3].append(t)
    if len(tree[3]) > WIDEST:
        places: dict[str, list] = {}
        for t in tree[3]:
            if t[0] in places:
                fold(places[t[0]], t, siblings=True)
                once_each(places[t[0]])
            else:
                places[t[0]] = t
        tree[3] = list(places.values())
    return tree


def matching(a: list, b: list, memo: dict, wide: dict[int, dict] = {}) -> int:  # noqa: B006
    """Simple tree matching: the most pairs of nodes that keep order and ancestry.

    ``wide`` may say of nodes with many children where those of a key are.
    """
    if a[0] != b[0]:
        return 0
    if not a[3] or not b[3]:
        return 1
    known = memo.get((id(a), id(b)))
    if known is not None:
        return known[0] + 1
    y = b[3]
    keys = {t[0] for t in y}
    at = wide.get(id(a))
    x = [t for t in a[3] if t[0] in keys] if at is None else [a[3][n] for n in sorted(n for k in keys for n in at.get(k, ()))]
    if len(x) * len(y) > DENSE:
        chain = heaviest(x, y, memo, wide)
        memo[id(a), id(b)] = (chain[0] if chain else 0, x, None, chain)
        return memo[id(a), id(b)][0] + 1
    m = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i, t in enumerate(x):
        above, row = m[i], m[i + 1]
        for j, u in enumerate(y):
            row[j + 1] = max(above[j + 1], row[j], above[j] + matching(t, u, memo, wide) if t[0] == u[0] else 0)
    memo[id(a), id(b)] = (m[-1][-1], x, m, None)
    return m[-1][-1] + 1


def heaviest(x: list[list], y: list[list], memo: dict, wide: dict[int, dict] = {}) -> tuple | None:  # noqa: B006
    """The same best alignment of many children as a chain ``(weight, a, b, chain before)``.

    Only pairs of like keys are looked at; a Fenwick tree over ``y`` holds the heaviest chains.
    """
    places: dict[str, list[int]] = {}
    for j, u in enumerate(y):
        places.setdefault(u[0], []).append(j)
    best: list[tuple | None] = [None] * (len(y) + 1)

    def up_to(k: int) -> tuple | None:
        found = None
        while k:
            if best[k] and (found is None or best[k][0] > found[0]):
                found = best[k]
            k &= k - 1
        return found

    for t in x:
        ends = []
        for j in places[t[0]]:
            chain = up_to(j)
            ends.append((j + 1, ((chain[0] if chain else 0) + matching(t, y[j], memo, wide), t, y[j], chain)))
        for k, end in ends:
            while k <= len(y):
                if best[k] is None or best[k][0] < end[0]:
                    best[k] = end
                k += k & -k
    return up_to(len(y))


def pairs(a: list, b: list, memo: dict, wide: dict[int, dict] = {}) -> list[tuple[list, list]]:  # noqa: B006
    """The aligned children of two nodes that match.

    Many children have no order to keep: where there are more than ``WIDEST``, those left over by
    the alignment share a place with one of the same key all the same.
    """
    matching(a, b, memo, wide)
    if (id(a), id(b)) not in memo:
        return []
    _, x, m, chain = memo[id(a), id(b)]
    y, out = b[3], []
    i, j = len(x), len(y)
    while m and i and j:
        w = matching(x[i - 1], y[j - 1], memo, wide)
        if w and m[i][j] == m[i - 1][j - 1] + w:
            i, j = i - 1, j - 1
            out.append((x[i], y[j]))
        elif m[i][j] == m[i - 1][j]:
            i -= 1
        else:
            j -= 1
    while chain:
        out.append(chain[1:3])
        chain = chain[3]
    out.reverse()
    if max(len(a[3]), len(y)) > WIDEST:
        taken = {id(t) for pair in out for t in pair}
        left: dict[str, list[list]] = {}
        for t in x:
            if id(t) not in taken:
                left.setdefault(t[0], []).append(t)
        for u in y:
            if id(u) not in taken and (like := left.get(u[0])):
                n = max(range(len(like)), key=lambda n: matching(like[n], u, memo, wide))  # noqa: B023
                out.append((like.pop(n), u))
    return out


def size(tree: list) -> int:
    return 1 + sum(map(size, tree[3]))


def fold(into: list, tree: list, memo: dict | None = None, siblings: bool = False) -> int:
    """Folds a tree of the same root key into a wrapper, or into its sibling on the same page.

    Gives how many places the wrapper gained.
    """
    memo = {} if memo is None else memo
    aligned = {id(b): a for a, b in pairs(into, tree, memo)}
    into[1] += tree[1]
    into[2] = sorted({*into[2], *tree[2]} if siblings else {*into[2]}.intersection(tree[2]))
    gained, grown = 0, []
    before: dict[int, list] = {}
    for b in tree[3]:
        a = aligned.get(id(b))
        if a is None:
            grown.append(b)
            gained += size(b)
        else:
            if grown:
                before[id(a)] = grown
                grown = []
            gained += fold(a, b, memo, siblings)
    if before:
        for n in [n for n, a in enumerate(into[3]) if id(a) in before][::-1]:
            into[3][n:n] = before[id(into[3][n])]
    into[3] += grown
    return gained


class Opened:
    """A wrapper to read pages with: what each page would have to look for in it is found once."""

    def __init__(self, wrapper: list):
        self.wrapper = wrapper
        #: Ids of places that are constant or lead to such places, and of those that lead there.
        self.told: set[int] = set()
        self.leads: set[int] = set()
        #: Of places with many children: where those of a key are.
        self.wide: dict[int, dict[str, list[int]]] = {}
        self._tells(wrapper)

    def _tells(self, known: list) -> bool:
        if len(known[3]) > WIDEST:
            at = self.wide[id(known)] = {}
            for n, c in enumerate(known[3]):
                at.setdefault(c[0], []).append(n)
        if any([self._tells(c) for c in known[3]]):
            self.leads.add(id(known))
        if id(known) in self.leads or (known[2] and known[1] >= LEAST_PAGES):
            self.told.add(id(known))
            return True
        return False


def constant_nodes(root: Node, opened: Opened | None) -> set[int]:
    """Ids of the page's nodes that the wrapper knows as template with all that is below them."""
    found: set[int] = set()
    if opened is None or opened.wrapper[0] != key_of(root):
        return found
    shapes: dict[int, list] = {}

    def shape(node: Node) -> list:
        """The tree that a node aligns with: made once, on the page's first alignment."""
        if id(node) not in shapes:
            shapes[id(node)] = tree_of(node)
        return shapes[id(node)]

    def walk(node: Node, known: list) -> None:
        if id(known) not in opened.told:
            return
        if known[1] >= LEAST_PAGES and digest(own_text(node)) in known[2]:
            found.add(id(node))
        if id(known) not in opened.leads:
            return
        runs: list[list[Node]] = []
        for child in node.children:
            if isinstance(child, Node) and child.tag not in ("script", "style"):
                if runs and key_of(runs[-1][0]) == key_of(child):
                    runs[-1].append(child)
                else:
                    runs.append([child])
        if len(runs) > WIDEST:
            places: dict[str, list[Node]] = {}
            for r in runs:
                places.setdefault(key_of(r[0]), []).extend(r)
            runs = list(places.values())
        own = [known[0], 1, [], [shape(r[0]) for r in runs]]
        by_tree = {id(t): r for t, r in zip(own[3], runs, strict=True)}
        for a, b in pairs(known, own, {}, opened.wide):
            for child in by_tree[id(b)]:
                walk(child, a)

    whole: set[int] = set()

    def judge(node: Node) -> tuple[bool, bool]:
        """Whether there is text, and whether it varies."""
        text, vary = bool(own_text(node)), set()
        varies = text and id(node) not in found
        for child in node.children:
            if isinstance(child, Node) and not never(child, True):
                t, v = judge(child)
                text, varies = text or t, varies or v
                if v:
                    vary.add(key_of(child))
        # A paragraph that all pages have among like ones that vary is a part of what they say.
        whole.difference_update(id(c) for c in node.children if isinstance(c, Node) and c.tag in LEAVES and key_of(c) in vary)
        if text and not varies:
            whole.add(id(node))
        return text, varies

    walk(root, opened.wrapper)
    if found:
        judge(root)
    return whole


# --- extraction ---------------------------------------------------------------------------------


def outermost(root: Node) -> list[Node]:
    """Article and main elements that are in no other of their kind."""
    out: list[Node] = []

    def walk(node: Node, open_: frozenset) -> None:
        for c in node.children:
            if isinstance(c, Node) and not never(c, True):
                if c.tag in MAIN and c.tag not in open_:
                    out.append(c)
                walk(c, open_ | {c.tag} if c.tag in MAIN else open_)

    walk(root, frozenset())
    return out


class Slots:
    """What each element of a page holds that varies and may be content."""

    def __init__(self, root: Node, opened: Opened | None):
        self.template = constant_nodes(root, opened if opened and opened.wrapper[1] >= LEAST_PAGES else None)
        #: Characters outside of links, worth, and whether the element stays out of what is around it.
        self.chars: dict[int, int] = {}
        self.worth: dict[int, float] = {}
        self.out: set[int] = set()
        tags = [n.tag for n in outermost(root)]
        #: Of several articles, as in a list of teasers, none is the article.
        self.favoured = {tag for tag in MAIN if tags.count(tag) == 1}
        self._weigh(root, False, False)

    def _weigh(self, node: Node, inside: bool, linked: bool) -> None:
        inside, linked = inside or node.tag in MAIN, linked or node.tag == "a"
        chars, worth, doubtful = 0, 0.0, []
        if not linked:
            chars = len(own_text(node))
            worth = float(chars)
        for child in node.children:
            if not isinstance(child, Node):
                continue
            if id(child) in self.template or never(child, inside):
                self.out.add(id(child))
                continue
            self._weigh(child, inside, linked)
            if named_noise(child):
                doubtful.append(child)
            else:
                chars, worth = chars + self.chars[id(child)], worth + self.worth[id(child)]
        for child in doubtful:
            # A name is believed unless it names most of what there is.
            if self.chars[id(child)] > chars and not (inside and node.tag not in MAIN):
                chars, worth = chars + self.chars[id(child)], worth + self.worth[id(child)]
            else:
                self.out.add(id(child))
        if node.tag in self.favoured:
            worth *= FAVOUR
        self.chars[id(node)], self.worth[id(node)] = chars, worth

    def within(self, node: Node) -> list[Node]:
        return [c for c in node.children if isinstance(c, Node) and id(c) not in self.out and c.tag not in INLINE]

    def content(self, root: Node) -> list[Node]:
        """From the root down to the smallest element of nearly all the worth, or several alike."""
        node = root
        while True:
            inside = self.within(node)
            best = max(inside, key=lambda c: self.worth[id(c)], default=None)
            if best is None or not self.worth[id(best)]:
                return [node]
            alike = [c for c in inside if key_of(c) == key_of(best)] if best.tag in MAIN else [best]
            if sum(self.worth[id(c)] for c in alike) < NEARLY * self.worth[id(node)] / (FAVOUR if node.tag in self.favoured else 1):
                return [node]
            if len(alike) > 1 or best.tag in LEAVES:
                return alike if best.tag in MAIN else [node]
            node = best


LEAVES = {"p", "li", "td", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "blockquote", "dd", "dt"}


def text_of(node: Node, out: set[int]) -> str:
    """The text below a node, blocks parted by white space, without what stays out."""
    parts: list[str] = []

    def walk(n: Node) -> None:
        for c in n.children:
            if isinstance(c, str):
                parts.append(c)
            elif c.tag in ("br", "hr"):
                parts.append(" ")
            elif id(c) not in out:
                inline = c.tag in INLINE
                if not inline:
                    parts.append(" ")
                walk(c)
                if not inline:
                    parts.append(" ")

    walk(node)
    return " ".join("".join(parts).split())


def extract(page: str | None, wrapper: list | Opened | None = None) -> str:
    if not page:
        return ""
    root = parse(page)
    slots = Slots(root, Opened(wrapper) if isinstance(wrapper, list) else wrapper)
    if not slots.chars[id(root)] and slots.template:
        # Nothing varies: the pages are alike, and names alone tell template from content.
        slots = Slots(root, None)
    return " ".join(t for t in (text_of(n, slots.out) for n in slots.content(root)) if t)


HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def with_host(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), HOST, 1)).alias("host"))


def wrappers(pages: DataFrame) -> DataFrame:
    """``host, wrapper`` (json), ``pages`` of hosts of enough pages, folded per task and then per host."""

    def batch_of(known: list[tuple[str, list]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([h for h, _ in known], pa.string()), pa.array([json.dumps(w) for _, w in known], pa.string()), pa.array([w[1] for _, w in known], pa.int64())], ["host", "wrapper", "pages"])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list] = {}
        held = 0
        for batch in batches:
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if page:
                    tree = tree_of(parse(page))
                    if host in known:
                        held += fold(known[host], tree)
                    else:
                        known[host] = tree
                        held += size(tree)
                    if held > HELD:
                        yield batch_of(list(known.items()))
                        known, held = {}, 0
        yield batch_of(list(known.items()))

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, wrapper, done, held = None, None, [], 0
        for batch in batches:
            for host, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if wrapper is not None and host == current:
                    held += fold(wrapper, json.loads(text))
                    continue
                if wrapper is not None and wrapper[1] >= LEAST_PAGES:
                    done.append((current, wrapper))
                if held > HELD:
                    yield batch_of(done)
                    done, held = [], 0
                current, wrapper = host, json.loads(text)
                held += size(wrapper)
        if wrapper is not None and wrapper[1] >= LEAST_PAGES:
            done.append((current, wrapper))
        yield batch_of(done)

    schema = "host string, wrapper string, pages long"
    return pages.select("host", "html").distinct().mapInArrow(local, schema).repartition("host").sortWithinPartitions("host", "wrapper").mapInArrow(merged, schema)


def main_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars``.

    Wrappers are written out first: the planner broadcasts them if they are small and deals both
    sides by host if not, where adaptive execution splits hot hosts.  Pages of hosts with a long
    wrapper are dealt apart, to tasks that are each sent that wrapper once, before its pages.
    """
    spark, hosted, schema = pages.sparkSession, with_host(pages), "page_id long, url string, text string, n_chars long"
    folder = new_folder(spark, "wrappers")
    wrappers(hosted).withColumn("wide", F.length("wrapper") > BESIDE).write.parquet(folder)
    found = spark.read.parquet(folder)

    def batch_of(ids: pa.Array, urls: pa.Array, texts: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([ids, urls, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent: dict[str, Opened] = {}
        for batch in batches:
            texts = []
            for page, wrapper in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if wrapper is not None and wrapper not in recent:
                    if len(recent) > 256:
                        recent.clear()
                    recent[wrapper] = Opened(json.loads(wrapper))
                texts.append(extract(page, recent.get(wrapper)))
            yield batch_of(batch.column(0), batch.column(1), texts)

    def ahead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None
        for batch in batches:
            texts = []
            for page, wrapper in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if wrapper is None:
                    texts.append(extract(page, known))
                else:
                    known = None  # frees the one before
                    known = Opened(json.loads(wrapper))
            pages_only = batch.filter(batch.column(3).is_null())
            yield batch_of(pages_only.column(0), pages_only.column(1), texts)

    if not found.where("wide").head(1):
        return hosted.join(found.select("host", "wrapper"), "host", "left").select("page_id", "url", "html", "wrapper").mapInArrow(beside, schema)
    copies = F.least(F.ceil(F.col("pages") / PAGES_A_COPY), F.lit(spark.sparkContext.defaultParallelism)).cast("long")
    marked = hosted.join(found.select("host", "wide", copies.alias("copies"), F.when(~F.col("wide"), F.col("wrapper")).alias("wrapper")), "host", "left")
    short = marked.where(~F.coalesce("wide", F.lit(False))).select("page_id", "url", "html", "wrapper").mapInArrow(beside, schema)
    sent = found.where("wide").select("host", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1)).alias("copy"), F.lit(None).cast("long").alias("page_id"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "wrapper")
    dealt = marked.where("wide").select("host", F.pmod(F.xxhash64("page_id", "html"), "copies").alias("copy"), "page_id", "url", "html", "wrapper")
    in_order = sent.unionByName(dealt).repartition("host", "copy").sortWithinPartitions("host", "copy", F.col("wrapper").isNull())
    return short.unionByName(in_order.select("page_id", "url", "html", "wrapper").mapInArrow(ahead, schema))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
