"""Font jobs: listing families, the characters set in each font, obfuscation, reference cleanup, recognition results."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiresmith.functions import css, dom, package, sfnt, text
from quiresmith.operators import glyphs

_MARKUP = ("xhtml", "html", "htm")
_FONTS = ("ttf", "otf", "woff", "woff2")


def family_files(sheets: Sequence[tuple[str, str]], fonts: dict[str, bytes]) -> dict[str, str]:
    """Family name to font path: aliases in the fonts themselves, then @font-face rules, later ones win.

    ``sheets`` are (path, text) in archive order.
    """
    out: dict[str, str] = {}
    for path, data in fonts.items():
        try:
            own = sfnt.names(data)
        except (sfnt.FontError, ValueError, IndexError, KeyError):
            own = []
        for name in [path.rpartition("/")[2].rpartition(".")[0], *own]:
            out.setdefault(css.normal_family(name), path)
    low = {p.lower(): p for p in fonts}
    for path, body in sheets:
        sheet = css.Sheet()
        css.collect(sheet, body, path, lambda _: None)
        for family, sources in sheet.faces:
            real = next((low[s.lower()] for s in sources if s.lower() in low), None)
            if real:
                out[family] = real
    return out


def document_sheet(root: dom.Element, path: str, load: Callable[[str], str | None]) -> css.Sheet:
    """The rules of a document: linked and embedded style sheets in document order."""
    sheet = css.Sheet()
    for e in root.walk():
        if not css.media_applies(e.attrs.get("media", "")):
            continue
        if e.tag == "link" and "stylesheet" in e.attrs.get("rel", "").lower().split() and "alternate" not in e.attrs.get("rel", "").lower():
            target = css.book_path(path, e.attrs.get("href", ""))
            body = load(target) if target else None
            if body is not None:
                css.collect(sheet, body, target, load, seen=(target,))
        elif e.tag == "style":
            css.collect(sheet, "".join(e.texts), path, load)
    return sheet


def effective(markup: str, path: str, load: Callable[[str], str | None], families: dict[str, str]) -> list[tuple[int, str | None, list[str]]]:
    """(node, font path or None, direct texts) of every element that shows text."""
    root = dom.parse(markup)
    files = css.fonts(root, document_sheet(root, path, load), families)
    return [(e.node_id, files[e.node_id], e.texts) for e in root.walk() if e is not root and e.tag not in ("style", "script", "title") and any(t.strip() for t in e.texts)]


def _books(members: DataFrame) -> DataFrame:
    """One row a book with what the cascade needs: style sheets and fonts of the archive, as arrays.

    Bounded by one archive; documents stay rows of their own.
    """
    item = F.struct("ord", "path", "content")
    return members.where(F.col("ext").isin("css", *_FONTS)).groupBy("book_id").agg(F.array_sort(F.collect_list(item)).alias("parts"))


def _load(parts) -> tuple[dict[str, str], dict[str, bytes]]:
    sheets = {p["path"]: package.decode(bytes(p["content"])) for p in parts or () if p["path"].lower().endswith(".css")}
    fonts = {p["path"]: bytes(p["content"]) for p in parts or () if not p["path"].lower().endswith(".css")}
    return sheets, fonts


def list_families(members: DataFrame) -> DataFrame:
    """(book_id, families): @font-face families whose font the archive holds, sorted case-blind."""

    def families(parts):
        sheets, fonts = _load(parts)
        low = {p.rpartition("/")[2].lower() for p in fonts}
        found: dict[str, str] = {}
        for path, body in sheets.items():
            for prelude, block in css.statements(css.strip_comments(body)):
                if prelude.lower() == "@font-face" and block is not None:
                    said = {n: v for n, v, _ in css.declarations(block)}
                    urls = re.findall(r"url\(\s*[\"']?([^\"')]+)", said.get("src", ""))
                    if "font-family" in said and any(u.split("?")[0].split("#")[0].rpartition("/")[2].lower() in low for u in urls):
                        name = said["font-family"].strip().strip("'\"")
                        found.setdefault(name.lower(), name)
        return sorted(found.values(), key=str.lower)

    books = members.select("book_id").distinct().join(_books(members), "book_id", "left")
    return books.select("book_id", F.udf(families, "array<string>")("parts").alias("families"))


def pieces(members: DataFrame) -> DataFrame:
    """(book_id, path, node, font, pos, text): each text with the font it is set in (null: none of the book's)."""

    def cascade(path, content, parts):
        sheets, fonts = _load(parts)
        known = family_files(list(sheets.items()), fonts)
        return [{"node": n, "font": f, "text": "".join(t)} for n, f, t in effective(package.decode(bytes(content)), path, sheets.get, known)]

    docs = members.where(F.col("ext").isin(*_MARKUP)).select("book_id", "ord", "path", "content").join(_books(members), "book_id", "left")
    found = F.udf(cascade, "array<struct<node:int,font:string,text:string>>")("path", "content", "parts")
    out = docs.select("book_id", "ord", "path", F.explode(found).alias("x"))
    return out.select("book_id", "path", "x.node", "x.font", (F.col("ord").cast("long") * (1 << 32) + F.col("x.node")).alias("pos"), "x.text")


def usage(members: DataFrame) -> DataFrame:
    """(book_id, font, chars): the distinct characters set in each embedded font, in reading order."""
    return glyphs.usage(pieces(members).where("font IS NOT NULL").select("book_id", "font", "pos", "text"))


def families(members: DataFrame) -> DataFrame:
    """(book_id, family, font): every family name of a book, as the cascade reads it, and its font's path."""

    def known(parts):
        sheets, files = _load(parts)
        return [{"family": f, "font": p} for f, p in sorted(family_files(list(sheets.items()), files).items())]

    rows = _books(members).select("book_id", F.explode(F.udf(known, "array<struct<family:string,font:string>>")("parts")).alias("x"))
    return rows.select("book_id", "x.*")


def target_fonts(members: DataFrame, targets: DataFrame) -> DataFrame:
    """(book_id, font): the fonts that the families of ``targets`` (book_id, family) name."""
    wanted = F.udf(css.normal_family, "string")("family")
    return families(members).join(targets.select("book_id", wanted.alias("family")).distinct(), ["book_id", "family"]).select("book_id", "font").distinct()


def obfuscate(members: DataFrame, seed: int = 0, targets: DataFrame | None = None) -> dict[str, DataFrame]:
    """Fonts with other code points, drawn from the pools, and the documents' texts written in them.

    Returns ``members`` (same columns as given) and ``char_map`` (book_id, font, src, dst). Only
    characters that the font has a glyph for take part; a font that cannot be read stays as it is, as
    do fonts that ``targets`` (book_id, family), if given, does not name.
    """
    used = usage(members)
    if targets is not None:
        used = used.join(target_fonts(members, targets), ["book_id", "font"], "left_semi")
    chars = used.select("book_id", "font", F.explode(F.filter(F.split("chars", ""), lambda c: c != "")).alias("ch"))
    fonts = members.where(F.col("ext").isin(*_FONTS)).select("book_id", F.col("path").alias("font"), "content")

    def codepoints(data):
        try:
            return sorted(sfnt.read_cmap(bytes(data)))
        except Exception:  # unknown, not empty: the font takes no part
            return None

    cmap = fonts.select("book_id", "font", F.explode(F.udf(codepoints, "array<int>")("content")).alias("codepoint"))
    chars = chars.withColumn("codepoint", F.ascii("ch"))
    lacking = chars.join(cmap, ["book_id", "font", "codepoint"], "left_anti")
    chars = chars.join(cmap, ["book_id", "font", "codepoint"], "left_semi")
    char_map = glyphs.draw(chars, lacking, seed)
    tables = char_map.groupBy("book_id", "font").agg(F.map_from_entries(F.collect_list(F.struct("src", "dst"))).alias("moves"))

    def move(data, moves):
        return sfnt.remap(bytes(data), {ord(a): ord(b) for a, b in moves.items()}) if moves else bytes(data)

    per_book = tables.groupBy("book_id").agg(F.map_from_entries(F.collect_list(F.struct("font", "moves"))).alias("tables"))

    keep = members.join(tables.select("book_id", F.col("font").alias("path"), "moves"), ["book_id", "path"], "left")
    moved = keep.withColumn("content", F.when(F.col("ext").isin(*_FONTS), F.udf(move, "binary")("content", "moves")).otherwise(F.col("content")))
    # the cascade is read from the style sheets, which do not change; names in the fonts do not either
    return {"members": apply_tables(moved.select(members.columns), per_book), "char_map": char_map}


def apply_tables(members: DataFrame, per_book: DataFrame) -> DataFrame:
    """Documents whose texts are translated by the table of the font that each is set in.

    ``per_book`` holds (book_id, tables: font path to character map).
    """

    def rewrite(path, content, parts, tables):
        if not tables:
            return bytes(content)
        sheets, fonts = _load(parts)
        markup = package.decode(bytes(content))
        known = family_files(list(sheets.items()), fonts)
        set_in = {n: f for n, f, _ in effective(markup, path, sheets.get, known)}
        return package.as_utf8(translate(markup, lambda n: tables.get(set_in.get(n) or ""))).encode()

    keep = members.join(per_book, "book_id", "left").join(_books(members), "book_id", "left")
    new = F.when(F.col("ext").isin(*_MARKUP), F.udf(rewrite, "binary")("path", "content", "parts", "tables")).otherwise(F.col("content"))
    return keep.withColumn("content", new).select(members.columns)


def translate(markup: str, table_of: Callable[[int], dict[str, str] | None]) -> str:
    """Markup with the direct text of every element translated; tags, comments and entities stay.

    Elements are numbered as the tree numbers them: by their start tags.
    """
    out, stack, n = [], [-1], 0
    token = re.compile(r"(<!--.*?-->|<script\b(?:[^>]*[^/>])?>.*?</script\s*>|<style\b(?:[^>]*[^/>])?>.*?</style\s*>|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|</?[A-Za-z](?:\"[^\"]*\"|'[^']*'|[^\"'>])*>|&(?:#\d+|#x[0-9A-Fa-f]+|\w+);)", re.S | re.I)
    names: list[str] = []
    for part in token.split(markup):
        if part.startswith("</"):
            name = re.match(r"</([^\s>/]+)", part)[1].lower().rpartition(":")[2]
            if name in names:
                while names.pop() != name:
                    stack.pop()
                stack.pop()
        elif re.match(r"<[A-Za-z]", part):
            name = re.match(r"<([^\s>/]+)", part)[1].lower().rpartition(":")[2]
            whole = name in ("script", "style") and "</" in part
            if not part.rstrip(">").endswith("/") and name not in dom.VOID and not whole:
                stack.append(n)
                names.append(name)
            n += 1
        elif not part.startswith(("<", "&")):
            moves = table_of(stack[-1])
            part = "".join(moves.get(c, c) for c in part) if moves else part
        out.append(part)
    return "".join(out)


def clean_sheet(sheet: str, path: str, fonts: set[str], families: set[str]) -> str:
    """A style sheet without the @font-face rules of the given fonts or families, and without their
    names in font families; a declaration that loses all of its names goes."""

    def family_list(m: re.Match) -> str:
        kept = [f for f in css.split(m[2]) if css.normal_family(f) not in families]
        if len(kept) == len(css.split(m[2])):
            return m[0]
        return f"{m[1]}{', '.join(kept)}{m[3]}" if kept else ""

    def face(m: re.Match) -> str:
        said = {n: v for n, v, _ in css.declarations(m[1])}
        paths = {css.book_path(path, u) for u in re.findall(r"url\(\s*[\"']?([^\"')]+)", said.get("src", ""))}
        return "" if paths & fonts or css.normal_family(said.get("font-family", "")) in families else m[0]

    out = re.sub(r"@font-face\s*\{([^}]*)\}\s*", face, sheet, flags=re.I)
    return re.sub(r"(font-family\s*:\s*)([^;}!]+?)(\s*(?:![^;}]*)?(?:;|(?=\})|$))", family_list, out, flags=re.I)


def remove_references(members: DataFrame, targets: DataFrame) -> DataFrame:
    """Members without the target fonts (book_id, path), their manifest items and their uses in CSS."""
    gone = targets.select("book_id", "path").distinct()
    lists = gone.groupBy("book_id").agg(F.collect_set("path").alias("fonts"))
    kept = members.join(gone, ["book_id", "path"], "left_anti").join(lists, "book_id", "left").join(_books(members), "book_id", "left")

    def clean(path, ext, content, fonts, parts):
        if not fonts:
            return bytes(content)
        sheets, files = _load(parts)
        known = family_files(list(sheets.items()), files)
        families = {f for f, p in known.items() if p in fonts}
        body = package.decode(bytes(content))
        if ext == "css":
            return clean_sheet(body, path, set(fonts), families).encode()
        if ext == "opf":
            return re.sub(r"\s*<(?:\w+:)?item\b[^>]*/>", lambda m: "" if css.book_path(path, package.attributes(m[0]).get("href", "")) in fonts else m[0], body).encode()
        body = re.sub(r"(<style\b[^>]*>)(.*?)(</style>)", lambda m: m[1] + clean_sheet(m[2], path, set(fonts), families) + m[3], body, flags=re.I | re.S)
        return re.sub(r"(\sstyle=\")([^\"]*)(\")", lambda m: m[1] + clean_sheet(m[2], path, set(fonts), families) + m[3], body).encode()

    textual = F.col("ext").isin("css", "opf", *_MARKUP)
    new = F.when(textual, F.udf(clean, "binary")("path", "ext", "content", "fonts", "parts")).otherwise(F.col("content"))
    return kept.withColumn("content", new).select(members.columns)


#: (font path, font bytes, character) to (text, confidence): what reads a glyph.
Recogniser = Callable[[str, bytes, str], tuple[str, float | None]]


def recover(members: DataFrame, recognise: Recogniser, least: float = 0.8, policy: str = "strict") -> DataFrame:
    """(book_id, font, src, dst, status, confidence): what each character shows that ``policy`` has read.

    ``recognise`` is plugged in, as no glyph reader comes with the library. A failure is a row with
    its status and a placeholder, never a failed job. Full stops read from hint characters are the
    ideographic one.
    """
    used = usage(members).select("book_id", "font", F.explode(F.filter(F.split("chars", ""), lambda c: c != "")).alias("src"))
    used = used.where(text.is_candidate(F.col("src"), policy))
    fonts = members.where(F.col("ext").isin(*_FONTS)).select("book_id", F.col("path").alias("font"), "content")
    lists = used.groupBy("book_id", "font").agg(F.array_sort(F.collect_list("src")).alias("chars")).join(fonts, ["book_id", "font"])

    def read(font, content, chars):
        rows = []
        for c in chars:
            try:
                got, sure = recognise(font, bytes(content), c)
                rows.append({"src": c, "text": got, "confidence": sure, "failed": False})
            except Exception:
                rows.append({"src": c, "text": None, "confidence": None, "failed": True})
        return rows

    kind = "array<struct<src:string,text:string,confidence:double,failed:boolean>>"
    rows = lists.select("book_id", "font", F.explode(F.udf(read, kind)("font", "content", "chars")).alias("x")).select("book_id", "font", "x.*")
    status = glyphs.status(F.col("text"), F.coalesce("confidence", F.lit(0.0)), F.col("failed"), least)
    shown = F.when(status == "ok", glyphs.normalise(F.col("text"), F.col("src"), F.lit(False))).otherwise(F.concat(F.lit("["), text.codepoint_name(F.col("src")), F.lit(" "), status, F.lit("]")))
    return rows.select("book_id", "font", "src", shown.alias("dst"), status.alias("status"), "confidence")


def failure_path(opf_dir: str, font: bytes, ch: str, status: str) -> str:
    """Where the picture of an unread glyph goes."""
    return f"{opf_dir + '/' if opf_dir else ''}Images/ocr-failures/{hashlib.sha1(font).hexdigest()[:8]}_U-{ord(ch):04X}_{status}.png"
