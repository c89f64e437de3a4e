"""Main text of web pages by wrapper induction over the pages of a host."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from hashlib import blake2b
from html import unescape
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quiresmith.llm.common import Shelf

#: Distinct pages that must show the same text in the same place before it is taken out of the content
#: as template, their share, and distinct pages from which it counts as template when slots are weighed.
MIN_PAGES, MIN_SHARE, WEIGHED_PAGES = 4, 0.9, 2
#: Depth to which containers tell layouts apart, and to which they are slots of their own (deeper ones
#: belong to the slot around them).
LAYOUT_DEPTH, SLOT_DEPTH = 4, 64
#: Share of its host's pages that a layout needs for a wrapper of its own; other pages are aligned with
#: the wrapper of the host's most frequent layout.
LAYOUT_SHARE = 0.1
#: Weight of constant text against varying text, of elements named for the main part against others,
#: and the share of a slot's own text at which it is not left for a slot inside it.
CONSTANT_WEIGHT, MAIN_WEIGHT, OWN_SHARE = 0.25, 8, 0.2
#: Link text against other text, above which a slot inside the main part is a menu.
DENSE = 2

# HTML's void elements, elements whose content is raw text, elements that do not break
# a line of text, and block elements whose start ends an open paragraph.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br".split()
)
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split()
)
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPE = frozenset("ul ol dl table select body article section main div".split())
# Elements, roles and name parts that hold no article text.
DROP_TAGS = frozenset(
    "head script style noscript template nav footer aside form button select option textarea input svg canvas iframe object embed dialog menu title xmp noembed noframes audio video map datalist".split()
)
DROP_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
DROP_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar footer header masthead comment comments reply replies disqus cookie cookies consent notice notices alert popup modal overlay newsletter subscribe subscription share sharing social related widget pagination pager toolbar login signup".split()
)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*>?"
    r"|</(?P<close>[a-zA-Z][^\s/>]*)[^>]*>?"
    r"|<(?P<open>[a-zA-Z][^\s/>]*)(?P<attrs>[^<>\"']*(?:(?:\"[^\"]*\"|'[^']*')[^<>\"']*)*)>"
    r"|<(?P<bad>[a-zA-Z][^\s/>]*)(?P<rest>[^>]*)>?",
    re.S,
)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_PARTS = re.compile(r"[a-z0-9]+")
_DIGITS = re.compile(r"[0-9]+")
# Elements that frame parts of a page, and those that say by their name that they hold the main part.
CONTAINERS = frozenset("html body div main section article aside nav header footer form center".split())
MAIN = frozenset("article main".split())


@dataclass(eq=False, slots=True)
class Node:
    """An element, or a text (tag "#text")."""

    tag: str
    name: str = ""  # class and id
    role: str = ""
    hidden: bool = False
    text: str = ""
    children: list[Node] = field(default_factory=list)
    path: int = 0  # hash of tags and names from the root
    inside: bool = False  # of an element named for the main part


def parse(html: str) -> Node:
    """A tolerant DOM tree: unclosed, misnested and raw-text elements are handled as browsers do, roughly.

    The open elements are kept by tag, so an end tag finds what it closes, or that it closes nothing,
    without a walk: time is linear in the page.
    """
    root = Node("#root")
    stack = [root]
    open_at: dict[str, list[int]] = {}
    scopes = [0]
    at = 0

    def add(text: str, decode: bool = True) -> None:
        if text:
            now = stack[-1]
            now.children.append(Node("#text", text=unescape(text) if decode and "&" in text else text, path=now.path))

    def cut(i: int) -> None:
        for n in stack[i:]:
            open_at[n.tag].pop()
            if n.tag in SCOPE:
                scopes.pop()
        del stack[i:]

    def close(tags) -> None:
        found = [o[-1] for t in tags if (o := open_at.get(t)) and o[-1] > scopes[-1]]
        if found:
            cut(min(found))

    while m := _TOKEN.search(html, at):
        add(html[at : m.start()])
        at = m.end()
        if m["cdata"] is not None:
            add(m["cdata"], decode=False)
        elif m["close"]:
            if o := open_at.get(m["close"].lower()):
                cut(o[-1])
        elif tag := (m["open"] or m["bad"] or "").lower():
            attrs = {}
            for a in _ATTR.finditer(m["attrs"] or m["rest"] or ""):
                attrs.setdefault(a[1].lower(), a[2] or a[3] or a[4] or "")
            if tag in ENDS_P:
                close(("p",))
            if tag in CLOSES:
                close(CLOSES[tag])
            now = stack[-1]
            name = f"{attrs.get('class', '')} {attrs.get('id', '')}".strip().lower()
            hidden = "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower()
            node = Node(tag, unescape(name), attrs.get("role", "").lower(), hidden)
            node.path = crc32(f"{tag} {name}/".encode("utf-8", "surrogatepass"), now.path)
            node.inside = now.inside or now.tag in MAIN
            now.children.append(node)
            if tag in RAW:
                end = re.compile(f"</{tag}(?=[\\s/>]|$)[^>]*>?", re.I).search(html, at)
                node.children.append(Node("#text", text=html[at : end.start() if end else len(html)]))
                at = end.end() if end else len(html)
            elif tag not in VOID:
                open_at.setdefault(tag, []).append(len(stack))
                if tag in SCOPE:
                    scopes.append(len(stack))
                stack.append(node)
    add(html[at:])
    return root


def dropped(node: Node, below: bool = False) -> bool:
    """Whether an element holds no article text, by its own marks; ``below``: it stands inside the main
    part, where a header holds the title."""
    if node.tag in DROP_TAGS or node.hidden or node.role in DROP_ROLES:
        return True
    if node.tag in ("html", "body", "main", "article"):
        return False
    if node.tag == "header":
        return not (below or node.inside)
    return bool(node.name) and not DROP_NAMES.isdisjoint(_PARTS.findall(node.name))


def constant_key(node: Node, words: list[str]) -> int:
    """Place and wording of a text, as 64 bits of a cryptographic hash."""
    data = " ".join(words).encode("utf-8", "surrogatepass")
    return int.from_bytes(blake2b(data, digest_size=8, key=node.path.to_bytes(4, "little")).digest(), "little", signed=True)


@dataclass(eq=False, slots=True)
class Slot:
    """A container of a page, or like ones that follow each other, as a node of the tree that is aligned."""

    tag: str
    label: int  # hash of tag, class and id less their digits, and of what stands directly inside
    parent: int
    children: list[int] = field(default_factory=list)
    nodes: list[Node] = field(default_factory=list)
    main: bool = False
    sub: int = 0  # hash of the whole subtree
    size: int = 1


@dataclass(eq=False, slots=True)
class Page:
    """A page as slots, and its texts: (slot, constant_key, characters, whether it is a link's)."""

    slots: list[Slot]
    texts: list[tuple[int, int, int, bool]]
    layout: int


def _finish(slots: list[Slot]) -> list[Slot]:
    """Slots with their subtree hashes and sizes; children stand behind their parents."""
    for i in range(len(slots) - 1, -1, -1):
        s = slots[i]
        s.sub = hash((s.tag, s.label, tuple(slots[c].sub for c in s.children)))
        s.size = 1 + sum(slots[c].size for c in s.children)
    return slots


def read(root: Node) -> Page:
    """Slots and texts of a parsed page; elements that are no article text by their marks are left out of
    the texts, but not of the slots."""
    owner: list[Node] = [root]  # containers
    above, depth, kinds, inner = [-1], [0], [set()], [[]]
    texts: list[tuple[int, int, int, bool]] = []
    layout: set[str] = set()
    todo = [(root, 0, 0, "", False, False)]
    while todo:
        n, at, level, path, link, dead = todo.pop()
        if n.tag == "#text":
            words = n.text.split()
            if words:
                if not dead:
                    texts.append((at, constant_key(n, words), sum(map(len, words)) + len(words) - 1, link))
            continue
        if n is not root:
            dead = dead or dropped(n, below=False)
            if n.tag in CONTAINERS:
                if level < LAYOUT_DEPTH:
                    path = f"{path}/{n.tag} {_DIGITS.sub('', n.name)}"
                    layout.add(path)
                level += 1
                if depth[at] < SLOT_DEPTH:
                    owner.append(n)
                    above.append(at)
                    depth.append(depth[at] + 1)
                    kinds.append(set())
                    inner.append([])
                    inner[at].append(len(owner) - 1)
                    at = len(owner) - 1
            link = link or n.tag == "a"
        if n is owner[at]:
            kinds[at].update(c.tag for c in n.children if c.tag not in CONTAINERS and c.tag not in RAW and (c.tag != "#text" or not c.text.isspace()))
        todo.extend((c, at, level, path, link, dead) for c in reversed(n.children))

    label = [crc32(f"{n.tag} {_DIGITS.sub('', n.name)} {' '.join(sorted(k))}".encode("utf-8", "surrogatepass")) for n, k in zip(owner, kinds, strict=True)]
    slots = [Slot("#root", 0, -1, nodes=[root])]
    groups, slot_of = [[0]], [0] * len(owner)
    for i, members in enumerate(groups):  # grows while it is read
        runs: list[list[int]] = []
        if len(members) == 1:  # like neighbours are one slot
            for c in inner[members[0]]:
                if runs and label[runs[-1][0]] == label[c]:
                    runs[-1].append(c)
                else:
                    runs.append([c])
        else:  # of a list, like parts of all its members are one slot
            by: dict[int, list[int]] = {}
            for m in members:
                for c in inner[m]:
                    by.setdefault(label[c], []).append(c)
            runs = list(by.values())
        for run in runs:
            first = owner[run[0]]
            slots[i].children.append(len(slots))
            for c in run:
                slot_of[c] = len(slots)
            slots.append(Slot(first.tag, label[run[0]], i, nodes=[owner[c] for c in run], main=first.tag in MAIN or first.role == "main"))
            groups.append(run)
    texts = [(slot_of[at], key, chars, link) for at, key, chars, link in texts]
    return Page(_finish(slots), texts, crc32("\n".join(sorted(layout)).encode("utf-8", "surrogatepass")))


def dump(slots: Sequence[Slot]) -> str:
    return json.dumps([[s.tag, s.label, s.parent, int(s.main)] for s in slots], separators=(",", ":"))


def load(dumped: str) -> list[Slot]:
    slots = [Slot(tag, label, parent, main=bool(main)) for tag, label, parent, main in json.loads(dumped)]
    for i, s in enumerate(slots[1:], 1):
        slots[s.parent].children.append(i)
    return _finish(slots)


def align(a: Sequence[Slot], b: Sequence[Slot]) -> dict[int, int]:
    """Simple tree matching: the slots of ``b`` that those of ``a`` are matched with.

    Nodes match if their tags do, and so that order and parents are kept and as many nodes as can be
    are matched; equal labels count twice. Equal subtrees are matched without a table.
    """
    tables: dict[tuple[int, int], list[list[int]]] = {}
    weights: dict[tuple[int, int], int] = {}

    def weigh(i: int, j: int) -> int:
        x, y = a[i], b[j]
        if x.sub == y.sub:
            return 2 * x.size
        if x.tag != y.tag:
            return 0
        if (i, j) in weights:
            return weights[i, j]
        table = [[0] * (len(y.children) + 1)]
        for c in x.children:
            last, row = table[-1], [0]
            for k, d in enumerate(y.children):
                row.append(max(last[k + 1], row[k], last[k] + weigh(c, d)))
            table.append(row)
        tables[i, j] = table
        weights[i, j] = 1 + (x.label == y.label) + table[-1][-1]
        return weights[i, j]

    out: dict[int, int] = {}
    weigh(0, 0)
    todo = [(0, 0)]
    while todo:
        i, j = todo.pop()
        out[i] = j
        p, q = a[i].children, b[j].children
        if a[i].sub == b[j].sub:
            todo.extend(zip(p, q, strict=True))
            continue
        table, x, y = tables[i, j], len(p), len(q)
        while x and y:
            if table[x][y] == table[x - 1][y]:
                x -= 1
            elif table[x][y] == table[x][y - 1]:
                y -= 1
            else:
                x, y = x - 1, y - 1
                todo.append((p[x], q[y]))
    return out


def choose(slots: Sequence[Slot], vary: Sequence[float], same: Sequence[float], links: Sequence[float]) -> tuple[list[int], list[int], bool]:
    """(region, menus, whether constants count) of a layout, by the characters of its slots over all pages.

    ``vary``, ``same`` and ``links`` are the characters directly in each slot that differ from page to
    page, that are constant, and that are links'. From the root the heaviest slot inside is entered as
    long as it outweighs what stands beside it; slots named for the main part weigh more, and those
    that are no article text by their marks have no characters. Slots inside the region of which links
    make up most are menus. Where most of a region would be constant, pages repeat one article.
    """
    n = len(slots)
    mass, text, link = [v + CONSTANT_WEIGHT * s for v, s in zip(vary, same, strict=True)], [v + s for v, s in zip(vary, same, strict=True)], list(links)
    own = list(mass)
    whole = list(same)
    for i in range(n - 1, 0, -1):
        up = slots[i].parent
        for column in (mass, text, link, whole):
            column[up] += column[i]

    def weight(i: int) -> float:
        return mass[i] * (MAIN_WEIGHT if slots[i].main else 1)

    region, now = [0], 0
    while not slots[now].main:
        kids = [c for c in slots[now].children if mass[c] > 0]
        if not kids or own[now] > OWN_SHARE * mass[now]:
            break
        best = max(kids, key=weight)
        if weight(best) < own[now] + sum(map(weight, kids)) - weight(best):
            break
        region = [c for c in kids if slots[c].tag == "article"] if slots[best].tag == "article" else [best]
        now = best
    if now == 0 or not any(slots[c].main for c in region):
        named = [c for c in range(n) if slots[c].main and mass[c] > 0 and c not in region and slots[c].parent >= 0]
        # several named parts side by side, none of which outweighs the others
        if named and all(slots[r].tag in ("#root", "html", "body") for r in region):
            tops = [c for c in named if not _below(slots, c, named)]
            if tops and sum(mass[c] for c in tops) * MAIN_WEIGHT > mass[0]:
                region = tops
    menus = [i for i in range(n) if i not in region and link[i] > DENSE * text[i]]
    total, constant = sum(text[r] for r in region), sum(whole[r] for r in region)
    return region, menus, 2 * constant <= total


def _below(slots: Sequence[Slot], c: int, others: Sequence[int]) -> bool:
    c = slots[c].parent
    while c >= 0:
        if c in others:
            return True
        c = slots[c].parent
    return False


def main_text(root: Node, constants: frozenset[int] = frozenset(), wrappers: Sequence[dict] = ()) -> str:
    """Text of a page's main part: the region of the wrapper that the page is aligned with, or if it has
    none or no text there, the one that its own slots show; constants, menus and elements that are no
    article text by their marks are left out. Blocks are joined by one space."""
    page = read(root)
    wrapper = next((w for w in wrappers if w["layout"] == page.layout), wrappers[0] if wrappers else None)
    if wrapper:
        met = align(wrapper["pivot"], page.slots)
        region = sorted(met[r] for r in wrapper["region"] if r in met)
        menus = {met[m] for m in wrapper["menus"] if m in met}
        have = _with_text(page)
        if any(have[r] for r in region):
            return _emit(page, region, menus, constants if wrapper["constants"] else frozenset())
    vary, links = [0.0] * len(page.slots), [0.0] * len(page.slots)
    for at, key, chars, link in page.texts:
        if key not in constants:
            (links if link else vary)[at] += chars
    region, menus, _ = choose(page.slots, vary, [0.0] * len(vary), links)
    return _emit(page, region, set(menus), constants)


def _with_text(page: Page) -> list[int]:
    have = [0] * len(page.slots)
    for at, _, chars, _ in page.texts:
        have[at] += chars
    for i in range(len(have) - 1, 0, -1):
        have[page.slots[i].parent] += have[i]
    return have


def _emit(page: Page, region: Sequence[int], menus: set[int], constants: frozenset[int]) -> str:
    menu = {id(n) for m in menus for n in page.slots[m].nodes}
    regions = [n for r in region for n in page.slots[r].nodes]
    below = bool(region) and all(page.slots[r].tag not in ("#root", "html", "body") for r in region)
    blocks: list[str] = []
    line: list[str] = []

    def flush():
        if words := "".join(line).split():
            blocks.append(" ".join(words))
        line.clear()

    # (node, entering) on an explicit stack: deep nesting must not hit Python's recursion limit
    stack = [(r, True) for r in reversed(regions)]
    while stack:
        n, entering = stack.pop()
        if n.tag == "#text":
            if not constants or constant_key(n, n.text.split()) not in constants:
                line.append(n.text)
            continue
        if n.tag == "br":
            line.append("\n")
            continue
        block = n.tag not in INLINE
        if block:
            flush()
        if entering and id(n) not in menu and not dropped(n, below):
            if block:
                stack.append((n, False))
            stack.extend((c, True) for c in reversed(n.children))
    flush()
    return " ".join(blocks)


def host(url):
    """Lower-cased host of a url column; empty where it has none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def constant(n, pages, least=MIN_PAGES):
    """Whether ``n`` of ``pages`` make a text template; of numbers or columns."""
    return (n >= least) & (n >= MIN_SHARE * pages)


def induce(pages: list[str]) -> list[int]:
    """The constants of a host without regard to layouts: what ``wrappers`` counts, of a few pages."""
    pages = sorted(set(pages))
    seen: dict[tuple[int, int], int] = {}
    for p in pages:
        times: dict[int, int] = {}
        for _, key, _, _ in read(parse(p)).texts:
            times[key] = times.get(key, 0) + 1
        for at in times.items():
            seen[at] = seen.get(at, 0) + 1
    return sorted({k for (k, _), n in seen.items() if constant(n, len(pages))})


def wrappers(pages: DataFrame, shelf: Shelf) -> DataFrame:
    """(site, wrappers, constants), site the hash of a host: induced from all distinct pages of each host.

    ``pages`` holds (host, html). One page of each layout is its pivot, and the slots of all pages of
    that layout are aligned with those of the pivot by simple tree matching; what varies and what is
    constant in each slot is summed over all of them, and ``choose`` takes the region. A text is
    constant where it stands in one place, equally often, on MIN_SHARE of the pages of its host or
    layout. Copies of a page count once: of a page only hashes, lengths and the tree of its slots
    travel, and sums are combined map-side, so a host with a third of all pages is no heavier than
    another. A host has at most 1 / LAYOUT_SHARE wrappers.
    """
    rows = pages.where("html IS NOT NULL AND host <> ''").select(F.xxhash64("host").alias("site"), F.xxhash64("html").alias("h"), "html")
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.bool_()))
    names = ["site", "h", "layout", "slots", "at", "keys", "chars", "link"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for b in batches:
            out: tuple[list, ...] = tuple([] for _ in names)
            for site, h, html in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if (site, h) in seen:
                    continue
                if len(seen) < 100_000:
                    seen.add((site, h))
                page = read(parse(html))
                columns = list(zip(*page.texts, strict=True)) or [(), (), (), ()]
                for column, value in zip(out, (site, h, page.layout, dump(page.slots), *map(list, columns)), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=names)

    kind = "site long, h long, layout long, slots string, at array<int>, keys array<long>, chars array<int>, link array<boolean>"
    found = rows.mapInArrow(run, kind)
    found = shelf.put(found.groupBy("site", "h").agg(F.first(F.struct(*names[2:])).alias("x")).select("site", "h", "x.*"))
    sizes = found.groupBy("site", "layout").agg(F.count("*").alias("pages"))
    hosts = sizes.groupBy("site").agg(F.sum("pages").alias("host_pages"), F.max(F.struct("pages", "layout")).alias("top"))
    layouts = sizes.join(hosts, "site").where((F.col("pages") >= LAYOUT_SHARE * F.col("host_pages")) | (F.col("layout") == F.col("top.layout")))
    layouts = shelf.put(layouts.select("site", "layout", "pages", "host_pages"))
    pivots = found.groupBy("site", "layout").agg(F.min(F.struct("h", "slots")).alias("p")).select("site", "layout", F.col("p.slots").alias("pivot"))
    texts = found.select("site", "h", "layout", F.explode("keys").alias("key")).groupBy("site", "h", "layout", "key").agg(F.count("*").alias("times"))
    texts = shelf.put(texts.groupBy("site", "layout", "key", "times").agg(F.count("*").alias("n")))
    wide = texts.groupBy("site", "key", "times").agg(F.sum("n").alias("n")).where(F.col("n") >= WEIGHED_PAGES)
    wide = wide.join(hosts.select("site", "host_pages"), "site").where(constant(F.col("n"), F.col("host_pages"), WEIGHED_PAGES)).select("site", F.lit(None).cast("long").alias("layout"), "key", "n")
    own = texts.where(F.col("n") >= WEIGHED_PAGES).join(layouts, ["site", "layout"]).where(constant(F.col("n"), F.col("pages"), WEIGHED_PAGES)).select("site", "layout", "key", "n")
    constants = shelf.put(wide.unionByName(own))
    per_layout = layouts.join(constants.withColumnRenamed("layout", "only"), "site").where("only IS NULL OR only = layout").groupBy("site", "layout").agg(F.collect_set("key").alias("known"))
    plan = shelf.put(layouts.join(pivots, ["site", "layout"]).join(per_layout, ["site", "layout"], "left"))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: dict[tuple[int, int], tuple] = {}
        for b in batches:
            sums: dict[tuple[int, int, int], list[int]] = {}
            for site, layout, slots, pivot, known, at, keys, chars, link in zip(*(b.column(i).to_pylist() for i in range(9)), strict=True):
                if (site, layout) not in ready:
                    if len(ready) > 1000:
                        ready.clear()
                    ready[site, layout] = load(pivot), frozenset(known or ())
                tree, template = ready[site, layout]
                back = {j: i for i, j in align(tree, load(slots)).items()}
                for a, k, c, x in zip(at, keys, chars, link, strict=True):
                    if a in back:
                        s = sums.setdefault((site, layout, back[a]), [0, 0, 0])
                        s[2 if x else 1 if k in template else 0] += c
            columns = list(zip(*((*k, *s) for k, s in sums.items()), strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int64(), pa.int32(), *[pa.int64()] * 3], strict=True)], names=["site", "layout", "slot", "vary", "same", "links"])

    joined = found.join(plan.select("site", "layout", "pivot", "known"), ["site", "layout"])
    joined = joined.select("site", "layout", "slots", "pivot", "known", "at", "keys", "chars", "link")
    sums = joined.mapInArrow(weigh, "site long, layout long, slot int, vary long, same long, links long")
    sums = sums.groupBy("site", "layout", "slot").agg(*(F.sum(c).alias(c) for c in ("vary", "same", "links")))
    lists = sums.groupBy("site", "layout").agg(F.collect_list(F.struct("slot", "vary", "same", "links")).alias("sums"))
    lists = plan.select("site", "layout", "pages", "pivot").join(lists, ["site", "layout"], "left").select("site", "layout", "pages", "pivot", "sums")

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: tuple[list, ...] = ([], [], [])
            for pivot, sums in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                slots = load(pivot)
                columns = [[0.0] * len(slots) for _ in range(3)]
                for s in sums or ():
                    for column, name in zip(columns, ("vary", "same", "links"), strict=True):
                        column[s["slot"]] = float(s[name])
                for column, value in zip(out, choose(slots, *columns), strict=True):
                    column.append(value)
            extra = [pa.array(c, t) for c, t in zip(out, (pa.list_(pa.int32()), pa.list_(pa.int32()), pa.bool_()), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], *extra], names=["site", "layout", "pages", "pivot", "region", "menus", "constants"])

    picked = lists.mapInArrow(pick, "site long, layout long, pages long, pivot string, region array<int>, menus array<int>, constants boolean")
    order = F.struct((-F.col("pages")).alias("rank"), "layout", "pages", "pivot", "region", "menus", "constants")
    by_site = picked.groupBy("site").agg(F.array_sort(F.collect_list(order)).alias("wrappers"))
    by_site = by_site.withColumn("wrappers", F.transform("wrappers", lambda w: w.dropFields("rank")))
    template = constants.where(F.col("n") >= MIN_PAGES).groupBy("site").agg(F.collect_set("key").alias("constants"))
    return by_site.join(template, "site", "left")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars): the main text of every page.

    The wrapper of a host tells which slot of a page holds its article, see ``wrappers`` and
    ``choose``: the slots of the page are aligned with the wrapper's, and of that slot all texts are
    content, save template texts, menus, and elements that by tag, role, class or id are no article
    text. Such marks also weigh slots, so a page alone of its kind is read by its own slots.

    A null html counts as empty and gives an empty text; pages without a host, or that hold no text
    where their host's article stands, are read by their own slots. Repeated rows and null ids are
    kept; other columns are ignored, whatever their names. An empty table gives an empty result.
    """
    shelf = Shelf(pages.sparkSession, "html")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")).withColumn("host", host(F.col("url")))
    found = shelf.put(wrappers(rows.select("host", "html"), shelf))
    joined = rows.join(found, F.xxhash64("host") == F.col("site"), "left").select("page_id", "url", "html", "site", "wrappers", "constants")
    schema = T.StructType([joined.schema["page_id"], joined.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: dict[int | None, tuple] = {None: ((), frozenset())}

        def text(html, site, at, b):
            if not html:
                return ""
            if site not in ready:
                if len(ready) > 1000:
                    ready.clear()
                    ready[None] = (), frozenset()
                given = b.column(4)[at].as_py() or []
                ready[site] = [{**w, "pivot": load(w["pivot"])} for w in given], frozenset(b.column(5)[at].as_py() or ())
            made, constants = ready[site]
            return main_text(parse(html), constants, made)

        for b in batches:
            texts = [text(h, s, i, b) for i, (h, s) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True))]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=schema.names
            )

    return joined.mapInArrow(run, schema)
