"""Package documents: decoding, tolerant parsing, regeneration, provenance."""

from __future__ import annotations

import re
from html import escape
from urllib.parse import unquote
from xml.etree import ElementTree

# What marks our output.
GENERATOR = "quiresmith"
_CONTROLS = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f]")
_ATTR = re.compile(r"([\w:.\-]+)\s*=\s*(\"[^\"]*\"|'[^']*')")


def decode(data: bytes) -> str:
    """Text of an XML member: by byte order mark, by its declaration, then UTF-8, GB 18030, Latin-1."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if data.startswith(mark):
            return _CONTROLS.sub("", data.decode(name, "replace"))
    declared = re.match(rb"<\?xml[^>]*encoding\s*=\s*[\"']([A-Za-z0-9._-]+)", data[:200])
    names = ([declared[1].decode()] if declared else []) + ["utf-16-le"] * (data[1:2] == b"\0") + ["utf-16-be"] * (data[:1] == b"\0")
    for name in [*names, "utf-8", "gb18030"]:
        try:
            return _CONTROLS.sub("", data.decode(name))
        except (UnicodeDecodeError, LookupError):
            continue
    return _CONTROLS.sub("", data.decode("latin-1"))


def as_utf8(text: str) -> str:
    """The text with its declared encoding, if any, changed to UTF-8."""
    return re.sub(r"(<\?xml[^>]*encoding\s*=\s*[\"'])[^\"']*", r"\g<1>utf-8", text, count=1)


def local(tag: str) -> str:
    return tag.rpartition("}")[2].rpartition(":")[2]


def sanitise_attributes(xml: str) -> str:
    """Stray ``&``, ``<`` and ``>`` inside attribute values escaped."""

    def value(m: re.Match) -> str:
        inner = re.sub(r"&(?!(?:#\d+|#x[0-9A-Fa-f]+|\w+);)", "&amp;", m[2][1:-1]).replace("<", "&lt;").replace(">", "&gt;")
        return f"{m[1]}={m[2][0]}{inner}{m[2][0]}"

    return re.sub(r"<[A-Za-z](?:\"[^\"]*\"|'[^']*'|[^\"'>])*>", lambda m: _ATTR.sub(value, m[0]), xml)


def attributes(tag: str) -> dict[str, str]:
    return {m[1]: m[2][1:-1] for m in _ATTR.finditer(tag)}


def parse(opf: str) -> dict:
    """version, toc, parse_mode, manifest, spine, metadata and guide of a package document.

    A document that is not well formed is parsed again with attribute values sanitised, then read by
    pattern; parse_mode tells which way it took. Items lack neither id nor href.
    """
    for mode, text in (("xml", opf), ("sanitised", sanitise_attributes(opf))):
        try:
            root = ElementTree.fromstring(re.sub(r"<!DOCTYPE[^>]*>", "", text).encode())
        except (ElementTree.ParseError, ValueError):
            continue
        rows = [(local(n.tag), dict((local(k), v) for k, v in n.attrib.items()), (n.text or "").strip()) for n in root.iter() if isinstance(n.tag, str)]
        return _tables(mode, rows)
    rows = [(local(m[1]), attributes(m[0]), (m[2] or "").strip()) for m in re.finditer(r"<([\w:.\-]+)\b[^>]*>([^<]*)", opf)]
    return _tables("pattern", rows)


def _tables(mode: str, rows: list[tuple[str, dict, str]]) -> dict:
    out: dict = {"parse_mode": mode, "version": None, "toc": None, "manifest": [], "spine": [], "guide": [], "metadata": {}}
    for tag, a, text in rows:
        if tag == "package":
            out["version"] = a.get("version")
        elif tag == "item" and a.get("id") and a.get("href"):
            out["manifest"].append({"id": a["id"], "href": unquote(a["href"]), "media_type": a.get("media-type", ""), "properties": a.get("properties")})
        elif tag == "spine":
            out["toc"] = a.get("toc")
        elif tag == "itemref" and a.get("idref"):
            out["spine"].append({"idref": a["idref"], "linear": a.get("linear"), "properties": a.get("properties")})
        elif tag == "reference" and a.get("href"):
            out["guide"].append({"type": a.get("type"), "href": a["href"]})
        elif tag in ("title", "creator", "language", "subject", "source", "identifier") and text:
            out["metadata"][tag] = text
        elif tag == "meta" and a.get("name") == "cover" and a.get("content"):
            out["metadata"]["cover"] = a["content"]
    if mode == "pattern" and out["version"] is None:
        out["version"] = "2.0"
    return out


def item_tag(item: dict) -> str:
    extra = f' properties="{escape(item["properties"])}"' if item.get("properties") else ""
    return f'<item id="{escape(item["id"])}" href="{escape(item["href"])}" media-type="{escape(item["media_type"])}"{extra}/>'


def replace_manifest(opf: str, items: list[dict]) -> str:
    block = "<manifest>\n    " + "\n    ".join(map(item_tag, items)) + "\n  </manifest>"
    return re.sub(r"(?s)<((?:\w+:)?)manifest\b[^>]*>.*?</\1manifest>", lambda _: block, opf, count=1)


def rename_ids(opf: str, renames: dict[str, str]) -> str:
    """References to renamed ids followed: idref, fallback, toc, refines and the cover meta."""
    if not renames:
        return opf

    def new(value: str) -> str:
        mark, bare = ("#", value[1:]) if value.startswith("#") else ("", value)
        return mark + renames.get(bare, bare)

    opf = re.sub(r"\b(idref|fallback|toc|refines)=([\"'])(.*?)\2", lambda m: f"{m[1]}={m[2]}{new(m[3])}{m[2]}", opf)
    return re.sub(r"<meta\b[^>]*\bname=[\"']cover[\"'][^>]*>", lambda m: re.sub(r"\bcontent=([\"'])(.*?)\1", lambda c: f"content={c[1]}{new(c[2])}{c[1]}", m[0]), opf)


def stamped(opf: str) -> bool:
    return any(attributes(m[0]).get("name") == "generator" and attributes(m[0]).get("content") == GENERATOR for m in re.finditer(r"<(?:\w+:)?meta\b[^>]*>", opf))


def stamp(opf: str) -> str:
    """The document with one generator mark in its metadata, which is created if there is none."""
    if stamped(opf):
        return opf
    meta = f'<meta name="generator" content="{GENERATOR}" />'
    if m := re.search(r"([ \t]*)</((?:\w+:)?)metadata>", opf):
        return f"{opf[: m.start()]}{m[1]}  {meta}\n{m[1]}</{m[2]}metadata>{opf[m.end() :]}"
    if m := re.search(r"<((?:\w+:)?)metadata\b([^>]*?)/>", opf):
        return f"{opf[: m.start()]}<{m[1]}metadata{m[2]}>\n  {meta}\n</{m[1]}metadata>{opf[m.end() :]}"
    if m := re.search(r"<(?:\w+:)?package\b[^>]*>", opf):
        return f"{opf[: m.end()]}\n  <metadata>\n    {meta}\n  </metadata>{opf[m.end() :]}"
    raise ValueError("no package element")


def rootfile(container: str) -> str | None:
    """Path of the package document that container.xml names."""
    m = re.search(r"<(?:\w+:)?rootfile\b[^>]*>", container)
    return unquote(attributes(m[0]).get("full-path", "")) or None if m else None


def encryption(xml: str) -> dict | None:
    """What an encryption.xml lists: resources, key names and algorithms; None if it is not well formed."""
    try:
        root = ElementTree.fromstring(xml)
    except ElementTree.ParseError:
        return None
    uris, keys, algorithms = [], set(), set()
    for e in root.iter():
        tag = local(e.tag) if isinstance(e.tag, str) else ""
        if tag == "CipherReference" and e.get("URI"):
            uris.append(e.get("URI"))
        elif tag == "KeyName" and e.text:
            keys.add(e.text.strip())
        elif tag == "EncryptionMethod" and e.get("Algorithm"):
            algorithms.add(e.get("Algorithm"))
    text = any(re.match(r"(?:.*oebps/)?(?:text|styles)/", u.lower()) for u in uris)
    return {"uris": uris, "key_names": sorted(keys), "algorithms": sorted(algorithms), "text_or_css": text}
