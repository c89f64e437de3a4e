"""The part of CSS that decides which font a text is set in."""

from __future__ import annotations

import posixpath
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

from quiresmith.functions.dom import Element

# Properties that @supports knows, and what a family list may hold besides families.
SUPPORTED = frozenset(
    "background background-color border color display font font-family font-size font-stretch font-style font-variant font-weight height line-height margin opacity padding text-align text-decoration visibility width".split()
)
GENERIC = frozenset("serif sans-serif monospace cursive fantasy system-ui ui-serif ui-sans-serif ui-monospace ui-rounded math emoji fangsong".split())
KEYWORDS = frozenset("initial inherit unset revert revert-layer".split())
#: Decided outcomes that are no font file: another font, and the parent's.
BLOCKED, INHERITED, REVERTED = "<blocked>", "<inherit>", "<revert-layer>"
_NO_LAYER = 1_000_000


def scan(text: str, stops: str, at: int = 0) -> int:
    """Index of the first of ``stops`` outside quotes, brackets and escapes; the length if there is none."""
    depth, quote = 0, ""
    while at < len(text):
        c = text[at]
        if c == "\\":
            at += 1
        elif quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif depth == 0 and c in stops:
            return at
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth = max(0, depth - 1)
        at += 1
    return len(text)


def split(text: str, on: str = ",") -> list[str]:
    out, at = [], 0
    while True:
        end = scan(text, on, at)
        out.append(text[at:end].strip())
        if end >= len(text):
            return out
        at = end + 1


def _body_end(text: str, at: int) -> int:
    depth = 1
    while at < len(text):
        at = scan(text, "{}", at)
        if at >= len(text):
            break
        depth += 1 if text[at] == "{" else -1
        if not depth:
            return at
        at += 1
    return len(text)


def strip_comments(text: str) -> str:
    return re.sub(r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|/\*.*?(?:\*/|$)", lambda m: " " if m[0].startswith("/*") else m[0], text, flags=re.S)


def statements(text: str) -> Iterator[tuple[str, str | None]]:
    """(prelude, body) of each statement; body is None where a semicolon ends it."""
    at = 0
    while at < len(text):
        end = scan(text, ";{}", at)
        prelude = text[at:end].strip()
        if end < len(text) and text[end] == "{":
            close = _body_end(text, end + 1)
            yield prelude, text[end + 1 : close]
            at = close + 1
        else:
            if prelude:
                yield prelude, None
            at = end + 1


def declarations(body: str) -> Iterator[tuple[str, str, bool]]:
    for part in split(body, ";"):
        name, colon, value = part.partition(":")
        if colon and "{" not in name:
            m = re.search(r"\s*!\s*important\s*$", value, re.I)
            name = name.strip()
            yield name if name.startswith("--") else name.lower(), (value[: m.start()] if m else value).strip(), bool(m)


def media_applies(query: str) -> bool:
    """Whether a media query list holds on an e-book screen."""

    def one(q: str) -> bool:
        q = " ".join(q.lower().split())
        negated = q.startswith("not ")
        kind = re.sub(r"^(?:not|only)\s+", "", q).split(" and ")[0].strip()
        if kind.startswith("("):
            return True
        return (kind in ("", "all", "screen")) != negated

    return not query.strip() or any(map(one, split(query)))


def supports(condition: str, selector_ok: Callable[[str], bool]) -> bool:
    c = " ".join(condition.split())
    if c.lower().startswith("not ") or c.lower().startswith("not("):
        return not supports(c[3:], selector_ok)
    for word, join in ((" or ", any), (" and ", all)):
        parts, at, depth, quote = [], 0, 0, ""
        for i, ch in enumerate(c):
            if quote:
                quote = "" if ch == quote else quote
            elif ch in "\"'":
                quote = ch
            depth += (ch == "(") - (ch == ")")
            if not depth and c[i : i + len(word)].lower() == word:
                parts.append(c[at:i])
                at = i + len(word)
        if parts:
            return join(supports(p, selector_ok) for p in [*parts, c[at:]])
    if m := re.fullmatch(r"selector\((.*)\)", c, re.I):
        return selector_ok(m[1])
    if c.startswith("(") and c.endswith(")"):
        inner = c[1:-1].strip()
        name, colon, _ = inner.partition(":")
        if colon and not inner.startswith(("(", "not")):
            return name.strip().lower() in SUPPORTED or name.strip().startswith("--")
        return supports(inner, selector_ok)
    return True


# Selectors


@dataclass
class Compound:
    tag: str = ""
    tests: list[Callable[[Element, Element | None], bool]] = field(default_factory=list)


@dataclass
class Selector:
    """Compounds from left to right; ``joins[i]`` is the combinator before compound i + 1."""

    compounds: list[Compound]
    joins: list[str]
    specificity: tuple[int, int, int]
    pseudo_element: bool = False

    def matches(self, e: Element, scope: Element | None = None) -> bool:
        return not self.pseudo_element and self._match(len(self.compounds) - 1, e, scope)

    def _match(self, i: int, e: Element, scope: Element | None) -> bool:
        c = self.compounds[i]
        if e.tag == "#document" or (c.tag and c.tag != e.tag) or not all(t(e, scope) for t in c.tests):
            return False
        if i == 0:
            return True
        join = self.joins[i - 1]
        if join == ">":
            return e.parent is not None and self._match(i - 1, e.parent, scope)
        if join == " ":
            return any(self._match(i - 1, a, scope) for a in e.ancestors())
        before = _before(e)
        return self._match(i - 1, before[-1], scope) if join == "+" and before else join == "~" and any(self._match(i - 1, b, scope) for b in before)


def _siblings(e: Element) -> list[Element]:
    return e.parent.children if e.parent is not None else [e]


def _before(e: Element) -> list[Element]:
    s = _siblings(e)
    return s[: s.index(e)]


def _nth(text: str) -> Callable[[int], bool]:
    t = text.replace(" ", "").lower()
    t = {"odd": "2n+1", "even": "2n"}.get(t, t)
    if m := re.fullmatch(r"([+-]?\d*)n([+-]\d+)?", t):
        a = int(m[1] + "1" if m[1] in ("", "+", "-") else m[1])
        b = int(m[2] or 0)
        return lambda k: (k - b) % a == 0 and (k - b) // a >= 0 if a else k == b
    n = int(t)
    return lambda k: k == n


def _unescape(name: str) -> str:
    return re.sub(r"\\([0-9a-fA-F]{1,6})\s?|\\(.)", lambda m: chr(int(m[1], 16)) if m[1] else m[2], name)


_NAME = r"(?:\\[0-9a-fA-F]{1,6}\s?|\\.|[\w\-]|[^\x00-\x7F])+"
_ATTRIBUTE = re.compile(r"\s*(?:[\w\-]*\|)?(" + _NAME + r")\s*(?:([~|^$*]?=)\s*(\"[^\"]*\"|'[^']*'|[^\s\]]+)\s*([iIsS])?\s*)?$")


def selector(text: str, namespaces: bool = True) -> Selector:
    """Compile one complex selector; ValueError if it is not understood."""
    compounds, joins = [Compound()], []
    total = [0, 0, 0]
    pseudo = False
    at, text, fresh = 0, text.strip(), True
    if not text:
        raise ValueError("empty selector")

    def add(spec: Sequence[int]):
        for i in range(3):
            total[i] += spec[i]

    while at < len(text):
        now = compounds[-1]
        if m := re.compile(r"\s*([>+~])\s*|\s+").match(text, at):
            if fresh:
                raise ValueError(f"combinator without a left side in {text!r}")
            joins.append(m[1] or " ")
            compounds.append(Compound())
            at, fresh = m.end(), True
            continue
        c = text[at]
        if fresh and (m := re.compile(r"(?:(?:" + _NAME + r"|\*)?\|)?(\*|" + _NAME + r")").match(text, at)):
            if m[1] != "*":
                now.tag = _unescape(m[1]).lower()
                add((0, 0, 1))
        elif c in ".#" and (m := re.compile(r"[.#](" + _NAME + ")").match(text, at)):
            name = _unescape(m[1])
            now.tests.append((lambda n: lambda e, s: n in e.classes)(name) if c == "." else (lambda n: lambda e, s: e.attrs.get("id") == n)(name))
            add((0, 1, 0) if c == "." else (1, 0, 0))
        elif c == "[":
            end = scan(text, "]", at + 1)
            a = _ATTRIBUTE.match(text[at + 1 : end])
            if end == len(text) or not a:
                raise ValueError(f"bad attribute test in {text!r}")
            now.tests.append(_attribute(_unescape(a[1]).lower(), a[2], (a[3] or "").strip("\"'"), (a[4] or "").lower() == "i"))
            add((0, 1, 0))
            at, fresh = end + 1, False
            continue
        elif m := re.compile(r"(::?)(" + _NAME + r")(\()?").match(text, at):
            name, end, inner = m[2].lower(), m.end(), None
            if m[3]:
                end = scan(text, ")", end)
                if end == len(text):
                    raise ValueError(f"unclosed bracket in {text!r}")
                inner = text[m.end() : end].strip()
                end += 1
            if m[1] == "::" or name in ("before", "after", "first-line", "first-letter"):
                pseudo = True
                add((0, 0, 1))
            else:
                test, spec = _pseudo(name, inner)
                now.tests.append(test)
                add(spec)
            at, fresh = end, False
            continue
        else:
            raise ValueError(f"bad selector {text!r}")
        at, fresh = m.end(), False
    if fresh:
        raise ValueError(f"selector {text!r} ends with a combinator")
    return Selector(compounds, joins, tuple(total), pseudo)


def _attribute(name: str, op: str | None, value: str, fold: bool):
    def test(e: Element, _) -> bool:
        got = e.attrs.get(name)
        if got is None or op is None:
            return got is not None
        a, b = (got.lower(), value.lower()) if fold else (got, value)
        return {
            "=": a == b, "~=": b in a.split(), "|=": a == b or a.startswith(b + "-"),
            "^=": bool(b) and a.startswith(b), "$=": bool(b) and a.endswith(b), "*=": bool(b) and b in a,
        }[op]

    return test


def _pseudo(name: str, inner: str | None):
    """(test, specificity) of a pseudo-class."""
    if name in ("is", "where", "not", "has", "matches", "any"):
        options = []
        for s in split(inner or ""):
            relative = name == "has" and re.match(r"\s*([>+~])\s*(.*)", s)
            options.append((relative[1] if relative else " ", selector(relative[2] if relative else s)))
        spec = (0, 0, 0) if name == "where" else max((s.specificity for _, s in options), default=(0, 0, 0))
        if name == "has":

            def has(e: Element, scope) -> bool:
                def near(join):
                    if join == ">":
                        return e.children
                    if join in "+~":
                        s = _siblings(e)
                        after = s[s.index(e) + 1 :]
                        return after[:1] if join == "+" else after
                    return [d for d in e.walk() if d is not e]

                return any(s.matches(d, scope) for join, s in options for d in near(join))

            return has, spec
        if name == "not":
            return lambda e, scope: not any(s.matches(e, scope) for _, s in options), spec
        return lambda e, scope: any(s.matches(e, scope) for _, s in options), spec
    if name.startswith("nth-"):
        count, of, rest = (inner or "").partition(" of ")
        rule, typed, last = _nth(count), name.endswith("of-type"), "last" in name
        inside = [selector(s) for s in split(rest)] if of else []

        def nth(e: Element, scope) -> bool:
            same = [s for s in _siblings(e) if (not typed or s.tag == e.tag) and (not inside or any(i.matches(s, scope) for i in inside))]
            return e in same and rule(len(same) - same.index(e) if last else same.index(e) + 1)

        extra = max((i.specificity for i in inside), default=(0, 0, 0))
        return nth, (extra[0], extra[1] + 1, extra[2])
    simple: dict[str, Callable[[Element, Element | None], bool]] = {
        "root": lambda e, s: e.parent is not None and e.parent.tag == "#document",
        "scope": lambda e, s: e is s if s is not None else e.parent is not None and e.parent.tag == "#document",
        "empty": lambda e, s: not e.children and not "".join(e.texts),
        "first-child": lambda e, s: _siblings(e)[0] is e,
        "last-child": lambda e, s: _siblings(e)[-1] is e,
        "only-child": lambda e, s: len(_siblings(e)) == 1,
        "first-of-type": lambda e, s: all(b.tag != e.tag for b in _before(e)),
        "last-of-type": lambda e, s: [b for b in _siblings(e) if b.tag == e.tag][-1] is e,
        "only-of-type": lambda e, s: sum(b.tag == e.tag for b in _siblings(e)) == 1,
        "link": lambda e, s: e.tag == "a" and "href" in e.attrs,
        "any-link": lambda e, s: e.tag == "a" and "href" in e.attrs,
    }
    if name in simple:
        return simple[name], (0, 1, 0)
    if name == "lang":
        langs = [x.strip("\"' ").lower() for x in split(inner or "")]

        def lang(e: Element, _) -> bool:
            for a in (e, *e.ancestors()):
                if got := (a.attrs.get("lang") or a.attrs.get("xml:lang") or "").lower():
                    return any(got == x or got.startswith(x + "-") for x in langs)
            return False

        return lang, (0, 1, 0)
    if name in ("hover", "active", "focus", "focus-within", "focus-visible", "visited", "target", "checked", "disabled", "enabled"):
        return lambda e, s: False, (0, 1, 0)
    raise ValueError(f"unknown pseudo-class {name}")


def compiles(text: str) -> bool:
    try:
        [selector(s) for s in split(text)]
    except ValueError:
        return False
    return True


# Style sheets


@dataclass
class Rule:
    """A declaration that decides the font (property "font") or a custom property."""

    selector: Selector
    prop: str
    value: str
    important: bool
    layer: str | None
    scopes: tuple[tuple[tuple[Selector, ...], tuple[Selector, ...]], ...]
    order: tuple[int, int]


@dataclass
class Sheet:
    rules: list[Rule] = field(default_factory=list)
    faces: list[tuple[str, list[str]]] = field(default_factory=list)  # family, paths of its sources
    layers: dict[str, int] = field(default_factory=dict)
    anonymous: int = 0

    def layer(self, name: str) -> str:
        for i in range(1, name.count(".") + 2):
            self.layers.setdefault(".".join(name.split(".")[:i]), len(self.layers) + 1)
        return name


def _font_of(name: str, value: str) -> str | None:
    """What a declaration says about the family: a family list, a keyword, or None for nothing."""
    low = value.strip().lower()
    if name == "all":
        return low if low in KEYWORDS else None
    if name in ("font", "font-family") and low in KEYWORDS:
        return low
    if name == "font-family":
        return value
    if name == "font":
        if "var(" in low:
            return value
        m = re.search(r"(?:^|\s)(?:[\d.]+(?:px|em|rem|%|pt|ex|ch|vw|vh)|xx-small|x-small|small|medium|large|x-large|xx-large|smaller|larger)(?:\s*/\s*[\w.%]+)?\s+(.+)$", value, re.I | re.S)
        return m[1] if m else None
    return None


def collect(sheet: Sheet, text: str, path: str, load: Callable[[str], str | None], layer: str | None = None, scopes: tuple = (), seen: tuple[str, ...] = ()) -> None:
    """Rules and faces of a style sheet's text into ``sheet``, its imports first, blocks flattened.

    Blocks of media, supports and import conditions that do not hold are left out, container blocks
    always, as they need a layout.
    """
    leading = True
    for prelude, body in statements(strip_comments(text)):
        if not prelude.startswith("@"):
            leading = False
            if body is not None:
                _rule(sheet, prelude, body, layer, scopes)
            continue
        name, _, rest = prelude[1:].partition(" ") if not re.match(r"@[\w-]+[\"'(]", prelude) else (re.match(r"@([\w-]+)", prelude)[1], "", prelude[1 + len(re.match(r"@([\w-]+)", prelude)[1]) :])
        name, rest = name.lower(), rest.strip()
        leading = leading and name in ("charset", "import", "layer") and body is None
        if name == "import" and leading:
            _import(sheet, rest, path, load, layer, scopes, seen)
        elif name == "media" and body is not None and media_applies(rest):
            collect(sheet, body, path, _no_imports, layer, scopes, seen)
        elif name == "supports" and body is not None and supports(rest, compiles):
            collect(sheet, body, path, _no_imports, layer, scopes, seen)
        elif name == "layer":
            names = [n for n in split(rest) if n]
            full = [f"{layer}.{n}" if layer else n for n in names]
            if body is None:
                for n in full:
                    sheet.layer(n)
                continue
            if not full:
                sheet.anonymous += 1
                full = [f"{layer + '.' if layer else ''}<{sheet.anonymous}>"]
            collect(sheet, body, path, _no_imports, sheet.layer(full[0]), scopes, seen)
        elif name == "scope" and body is not None:
            m = re.match(r"\s*(?:\((.*?)\))?\s*(?:to\s*\((.*)\))?\s*$", rest, re.S)
            try:
                roots = tuple(selector(s) for s in split(m[1])) if m and m[1] else ()
                limits = tuple(selector(s) for s in split(m[2])) if m and m[2] else ()
            except ValueError:
                continue
            if roots:
                collect(sheet, body, path, _no_imports, layer, (*scopes, (roots, limits)), seen)
        elif name == "font-face" and body is not None:
            _face(sheet, body, path)


def _no_imports(_: str) -> str | None:
    return None


def _import(sheet, rest, path, load, layer, scopes, seen) -> None:
    m = re.match(r"(?:url\(\s*(\"[^\"]*\"|'[^']*'|[^)]*?)\s*\)|(\"[^\"]*\"|'[^']*'))\s*(.*)$", rest, re.S)
    if not m:
        return
    target, conditions = book_path(path, (m[1] or m[2]).strip("\"'")), m[3].strip()
    if l := re.match(r"layer(?:\(([^)]*)\))?(?=\s|$)", conditions, re.I):
        if l[1]:
            inner = l[1].strip()
        else:
            sheet.anonymous += 1
            inner = f"<{sheet.anonymous}>"
        layer = sheet.layer(f"{layer}.{inner}" if layer else inner)
        conditions = conditions[l.end() :].strip()
    if s := re.match(r"supports\(", conditions, re.I):
        end = scan(conditions, ")", s.end())
        inner = conditions[s.end() : end]
        conditions = conditions[end + 1 :].strip()
        if not supports(f"({inner})", compiles):
            return
    if not target or target in seen or not media_applies(conditions):
        return
    text = load(target)
    if text is not None:
        collect(sheet, text, target, load, layer, scopes, (*seen, target))


def book_path(base: str, href: str) -> str:
    href = href.split("#")[0].split("?")[0].strip()
    if not href or "://" in href or href.startswith("data:"):
        return ""
    return posixpath.normpath(posixpath.join(posixpath.dirname(base), href))


def _face(sheet: Sheet, body: str, path: str) -> None:
    family, sources = "", []
    for name, value, _ in declarations(body):
        if name == "font-family":
            family = normal_family(value)
        elif name == "src":
            sources += [p for m in re.finditer(r"url\(\s*(\"[^\"]*\"|'[^']*'|[^)]*?)\s*\)", value) if (p := book_path(path, m[1].strip("\"'")))]
    if family:
        sheet.faces.append((family, sources))


def _rule(sheet: Sheet, prelude: str, body: str, layer: str | None, scopes: tuple) -> None:
    try:
        selectors = [selector(s) for s in split(prelude)]
    except ValueError:
        return  # one bad selector voids the rule
    base = len(sheet.rules)
    font: tuple[bool, str, int] | None = None
    custom: dict[str, tuple[bool, str, int]] = {}
    for i, (name, value, important) in enumerate(declarations(body)):
        if name.startswith("--"):
            if name not in custom or important >= custom[name][0]:
                custom[name] = (important, value, i)
        elif (said := _font_of(name, value)) is not None and (font is None or important >= font[0]):
            font = (important, said, i)
    for s in selectors:
        if font:
            sheet.rules.append(Rule(s, "font", font[1], font[0], layer, scopes, (base, font[2])))
        for name, (important, value, i) in custom.items():
            sheet.rules.append(Rule(s, name, value, important, layer, scopes, (base, i)))


def normal_family(name: str) -> str:
    return " ".join(name.strip().strip("'\"").split()).lower()


# The cascade


def _scope_distance(e: Element, scopes: tuple) -> int | None:
    """Steps up to the nearest root of the innermost scope; None if a scope leaves the element out."""
    distance = 0
    for roots, limits in scopes:
        found = None
        for k, a in enumerate((e, *e.ancestors())):
            if any(r.matches(a) for r in roots):
                found = k
                break
            if limits and any(m.matches(a) for m in limits):
                return None
        if found is None:
            return None
        distance = found
    return distance


def precedence(rule: Rule, layers: dict[str, int], distance: int | None) -> tuple:
    rank = layers[rule.layer] if rule.layer else _NO_LAYER
    return (rule.important, -rank if rule.important else rank, (0, *rule.selector.specificity), -(distance if rule.scopes else _NO_LAYER), rule.order)


def _win(records: list[tuple[tuple, str]]) -> str | None:
    """The value of the highest precedence; revert-layer takes its own layer and higher ones with it."""
    left = sorted(records, key=lambda r: r[0], reverse=True)
    while left:
        key, value = left[0]
        if value != "revert-layer":
            return value
        left = [r for r in left if not (r[0][0] == key[0] and abs(r[0][1]) >= abs(key[1]))]
    return None


def _substitute(value: str, variables: dict[str, str], depth: int = 0) -> str | None:
    """var() replaced, with fallbacks; None if a name stays unknown or a circle does not end."""
    if depth > 16:
        return None
    while m := re.search(r"var\(", value, re.I):
        end = scan(value, ")", m.end())
        name, _, fallback = value[m.end() : end].partition(",")
        got = variables.get(name.strip())
        new = _substitute(got, variables, depth + 1) if got is not None else None
        if new is None and fallback.strip():
            new = _substitute(fallback.strip(), variables, depth + 1)
        if new is None:
            return None
        value = value[: m.start()] + new + value[end + 1 :]
    return value


def fonts(root: Element, sheet: Sheet, family_files: dict[str, str]) -> dict[int, str | None]:
    """For every element the font file its direct text is set in; None for a font not in the book."""
    files: dict[int, str | None] = {-1: None}
    variables: dict[int, dict[str, str]] = {-1: {}}
    for e in root.walk():
        if e is root:
            continue
        up = e.parent.node_id
        records: dict[str, list] = {}
        for r in sheet.rules:
            if r.selector.matches(e):
                distance = _scope_distance(e, r.scopes)
                if distance is not None:
                    records.setdefault(r.prop, []).append((precedence(r, sheet.layers, distance), r.value))
        for i, (name, value, important) in enumerate(declarations(strip_comments(e.attrs.get("style", "")))):
            key = (important, 2 * _NO_LAYER if important else _NO_LAYER, (1, 0, 0, 0), 0, (0, i))
            if name.startswith("--"):
                records.setdefault(name, []).append((key, value))
            elif (said := _font_of(name, value)) is not None:
                records.setdefault("font", []).append((key, said))
        own = variables[up]
        if any(k != "font" for k in records):
            own = dict(own)
            for name in records:
                if name == "font":
                    continue
                value = _win(records[name])
                low = (value or "").strip().lower()
                if value is None or low in ("inherit", "unset", "revert"):
                    continue
                if low == "initial":
                    own.pop(name, None)
                else:
                    own[name] = value
        variables[e.node_id] = own
        value = _win(records["font"]) if "font" in records else None
        files[e.node_id] = _file(value, own, family_files, files[up])
    return files


def _file(value: str | None, variables: dict[str, str], family_files: dict[str, str], inherited: str | None) -> str | None:
    if value is None or value.strip().lower() in ("inherit", "unset", "revert"):
        return inherited
    value = _substitute(value, variables)
    if value is None:
        return inherited  # invalid at computed-value time
    low = value.strip().lower()
    if low in ("inherit", "unset", "revert"):
        return inherited
    if low == "initial":
        return None
    for family in split(_font_of("font", value) or value if re.match(r"\S+\s+.*,|[\d.]+(?:px|em|rem|%|pt)", value) else value):
        name = normal_family(family)
        if name in family_files:
            return family_files[name]
        if name in GENERIC:
            return None
    return None
