"""References inside documents: finding and rewriting them without touching anything else."""

from __future__ import annotations

import re
from collections.abc import Callable

# Attributes that name a file.
ATTRIBUTES = "href|src|poster|xlink:href|data|placeholder|activestate|zy-cover-pic"
_ATTR = re.compile(rf"(?P<head>(?<![\w:-])(?:{ATTRIBUTES})\s*=\s*)(?P<q>[\"'])(?P<ref>.*?)(?P=q)", re.I | re.S)
_SRCSET = re.compile(r"(?P<head>(?<![\w-])srcset\s*=\s*)(?P<q>[\"'])(?P<ref>.*?)(?P=q)", re.I | re.S)
_URL = re.compile(r"(?P<head>\burl\(\s*)(?P<q>[\"']?)(?P<ref>[^\"')]*)(?P=q)(?P<tail>\s*\))", re.I)
_IMPORT = re.compile(r"(?P<head>@import\s+)(?P<q>[\"'])(?P<ref>[^\"']*)(?P=q)", re.I)

Rewrite = Callable[[str], str]


def srcset(value: str, rewrite: Rewrite) -> str:
    """Candidates of a srcset led anew; data URIs keep their commas."""
    out, at = [], 0
    for m in re.finditer(r"\s*(data:[^\s]+|[^\s,]+(?:,(?=\S)[^\s,]+)*)(\s+[^,]*)?(?:,|$)|\s*,", value):
        if m[1] is None:
            continue
        url, comma = (m[1][:-1], ",") if m[1].endswith(",") else (m[1], "")
        parts = [url] if url.startswith("data:") else url.split(",")
        out += [*(p if p.startswith("data:") else rewrite(p) for p in parts[:-1]), (parts[-1] if url.startswith("data:") else rewrite(parts[-1])) + (m[2] or "").rstrip() + comma * 0]
        at = m.end()
    tail = value[at:].strip()
    return ", ".join([*out, tail] if tail else out)


def rewrite_css(text: str, rewrite: Rewrite) -> str:
    def one(m: re.Match) -> str:
        return f"{m['head']}{m['q']}{rewrite(m['ref'].strip())}{m['q']}{m.groupdict().get('tail') or ''}"

    return _IMPORT.sub(one, _URL.sub(one, text))


def rewrite_markup(text: str, rewrite: Rewrite) -> str:
    """Attributes, srcset candidates and url() of every tag and style block; text stays as it is."""

    def tag(m: re.Match) -> str:
        t = _ATTR.sub(lambda a: f"{a['head']}{a['q']}{rewrite(a['ref'])}{a['q']}", m[0])
        t = _SRCSET.sub(lambda a: f"{a['head']}{a['q']}{srcset(a['ref'], rewrite)}{a['q']}", t)
        return _URL.sub(lambda a: f"{a['head']}{a['q']}{rewrite(a['ref'].strip())}{a['q']}{a['tail']}", t)

    def style(m: re.Match) -> str:
        return m[1] + rewrite_css(m[2], rewrite) + m[3]

    text = re.sub(r"(<style\b[^>]*>)(.*?)(</style>)", style, text, flags=re.I | re.S)
    return re.sub(r"<!--.*?-->|<[A-Za-z](?:\"[^\"]*\"|'[^']*'|[^\"'>])*>", lambda m: m[0] if m[0].startswith("<!--") else tag(m), text, flags=re.S)


def references(text: str, css: bool = False) -> list[str]:
    """All references of a document, in order."""
    found: list[str] = []

    def note(ref: str) -> str:
        found.append(ref)
        return ref

    (rewrite_css if css else rewrite_markup)(text, note)
    return found
