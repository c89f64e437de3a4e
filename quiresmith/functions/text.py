"""Text and character expressions."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# What is not visible text of a page, in the order in which it is taken out.
INVISIBLE = (r"(?is)<script.*?</script>", r"(?is)<style.*?</style>", r"(?s)<!--.*?-->", r"<[^>]+>", r"\s+")


def visible_text(html: Column) -> Column:
    for pattern in INVISIBLE:
        html = F.regexp_replace(html, pattern, " ")
    return F.trim(html)


def distinct_chars(text: Column) -> Column:
    """The characters of a text in order of first appearance, each once."""
    return F.array_join(F.array_distinct(F.filter(F.split(text, ""), lambda c: c != "")), "")


def binary_name(text: Column, one: str = "*", zero: str = ":") -> Column:
    """The md5 digest of a text in binary, without leading zeros, its digits written as given."""
    nibbles = F.create_map(*(F.lit(x) for n in range(16) for x in (f"{n:x}", f"{n:04b}")))
    bits = F.array_join(F.transform(F.filter(F.split(F.md5(text), ""), lambda c: c != ""), lambda c: F.element_at(nibbles, c)), "")
    return F.translate(F.regexp_replace(bits, "^0+", ""), "10", one + zero)


def protect(text: Column) -> Column:
    """Escaped angle brackets under private-use names that no parser decodes; ``restore`` undoes it."""
    return F.replace(F.replace(text, F.lit("&lt;"), F.lit("\ue000lt\ue001")), F.lit("&gt;"), F.lit("\ue000gt\ue001"))


def restore(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\ue000lt\ue001"), F.lit("&lt;")), F.lit("\ue000gt\ue001"), F.lit("&gt;"))


def codepoint_name(ch: Column) -> Column:
    return F.concat(F.lit("U+"), F.lpad(F.hex(F.ascii(ch)), 4, "0"))


def obfuscatable(ch: str) -> bool:
    """ASCII or full-width letters and digits, and wide letters and numbers."""
    if ch.isascii():
        return ch.isalnum()
    return unicodedata.category(ch)[0] in "LN" and unicodedata.east_asian_width(ch) in "WF"


@lru_cache(1)
def obfuscatable_ranges(last: int = 0x2FFFF) -> tuple[tuple[int, int], ...]:
    """First and last code points of the runs of obfuscatable characters, from the Unicode tables."""
    out: list[tuple[int, int]] = []
    start = None
    for cp in range(last + 2):
        inside = cp <= last and not 0xD800 <= cp < 0xE000 and obfuscatable(chr(cp))
        if inside and start is None:
            start = cp
        elif not inside and start is not None:
            out.append((start, cp - 1))
            start = None
    return tuple(out)


def char_class(ch: Column) -> Column:
    """obfuscated, control, blank or passthrough, by the range table."""
    cp = F.ascii(ch)
    ranges = obfuscatable_ranges()
    simple = [r for r in ranges if r[0] < 0x80]
    test = None
    for a, b in simple:
        t = cp.between(a, b)
        test = t if test is None else test | t
    inside = F.when(cp < 0x80, test).otherwise(_within(cp, [r for r in ranges if r[0] >= 0x80]))
    return F.when(inside, "obfuscated").when((cp < 32) | cp.between(127, 159), "control").when(cp.isin(32, 160, 0x3000), "blank").otherwise("passthrough")


# Marks that are never read, what counts as a full stop, and the Hangul block.
PASSTHROUGH = "。，、；：？！“”‘’（）《》〈〉【】〔〕…—·"
PERIOD, PERIODS, ZERO_PERIOD = "。", (".", "．", "｡"), "0"
HANGUL = (0xAC00, 0xD7AF)
#: What is read: characters that obfuscation makes, or with "compatible" all beyond ASCII as well.
POLICIES = {"strict": "strict", "compatible": "compatible", "external": "compatible"}


def policy_of(name: str | None) -> str:
    """A policy by its name or alias in any case; an unknown one is strict."""
    return POLICIES.get((name or "strict").strip().lower(), "strict")


@lru_cache(1)
def private_and_control_ranges() -> tuple[tuple[int, int], ...]:
    """Runs of code points that are controls, unassigned or surrogates, but not of private use."""
    out: list[tuple[int, int]] = []
    start = None
    for cp in range(0x110001):
        inside = cp < 0x110000 and unicodedata.category(chr(cp)) in ("Cc", "Cf", "Cn", "Cs")
        if inside and start is None:
            start = cp
        elif not inside and start is not None:
            out.append((start, cp - 1))
            start = None
    return tuple(out)


def _within(cp: Column, ranges) -> Column:
    """Whether a code point lies in one of many ranges; the table is one literal that folds to a constant."""
    table = F.from_json(F.lit(str([list(r) for r in ranges])), "array<array<int>>")
    return F.exists(table, lambda r: cp.between(r[0], r[1]))


def is_hint(ch: Column) -> Column:
    """Whether a character tells by itself that it was obfuscated: of private use, or Hangul."""
    cp = F.ascii(ch)
    return F.coalesce(cp.between(0xE000, 0xF8FF) | cp.between(0xF0000, 0xFFFFD) | cp.between(0x100000, 0x10FFFD) | cp.between(*HANGUL), F.lit(False))


def never_read(ch: Column) -> Column:
    """Blanks, controls and punctuation that recognition leaves alone; also nothing."""
    cp = F.ascii(ch)
    blank = cp.isin(*[c for c in range(0x3001) if chr(c).isspace()])
    return F.coalesce(blank | _within(cp, private_and_control_ranges()) | ch.isin(*PASSTHROUGH) | (ch == ""), F.lit(True))


def is_candidate(ch: Column, policy: str = "strict") -> Column:
    """Whether recognition reads a character under a policy."""
    marked = is_hint(ch) | (char_class(ch) == "obfuscated")
    if policy_of(policy) == "compatible":
        marked = marked | (F.ascii(ch) >= 0x80)
    return ~never_read(ch) & marked


def pool_name(ch: Column) -> Column:
    """The pool that stands in for a character: ascii, fullwidth or wide."""
    cp = F.ascii(ch)
    return F.when(cp < 0x80, "ascii").when(cp.between(0xFF00, 0xFFEF), "fullwidth").otherwise("wide")


@lru_cache(3)
def pool(name: str) -> tuple[int, ...]:
    """Code points of a pool: ASCII or full-width letters and digits, or the wide letters of the Hangul block."""
    first, last = {"ascii": (0x30, 0x7A), "fullwidth": (0xFF10, 0xFF5A), "wide": HANGUL}[name]
    return tuple(c for c in range(first, last + 1) if obfuscatable(chr(c)))
