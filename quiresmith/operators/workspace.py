"""Jobs that change members in place: images, covers, script conversion."""

from __future__ import annotations

import posixpath
import re
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiresmith.functions import package, paths, raster, references
from quiresmith.functions.paths import MEDIA_TYPE
from quiresmith.operators import images

_TEXTUAL = ("xhtml", "html", "htm", "css", "svg", "ncx", "opf")
_EXTENSION = {"JPEG": "jpg", "PNG": "png", "WEBP": "webp"}

#: (image bytes, format wanted) to image bytes; ValueError where it cannot. Plugged in by the caller.
Codec = Callable[[bytes, str], bytes]


def builtin_codec(data: bytes, wanted: str) -> bytes:
    """What the standard library can encode: PNG to smaller PNG."""
    if wanted == "PNG" and data[:8] == b"\x89PNG\r\n\x1a\n":
        return raster.recompress_png(data)
    raise ValueError(f"no encoder for {wanted}")


def redirect_members(members: DataFrame, replacements: DataFrame) -> DataFrame:
    """References of all text members led from ``old`` to ``new`` paths (book_id, old, new)."""
    maps = replacements.groupBy("book_id").agg(F.map_from_entries(F.collect_list(F.struct("old", "new"))).alias("moves"))

    def rewrite(path, ext, content, moves):
        if not moves:
            return bytes(content)

        def one(ref: str) -> str:
            new = moves.get(paths.resolve_reference(path, ref) or "")
            return paths.redirect(ref, path, new) if new else ref

        body = package.decode(bytes(content))
        if ext == "opf":

            def item(m: re.Match) -> str:
                new = moves.get(paths.resolve_reference(path, package.attributes(m[0]).get("href", "")) or "")
                tag = re.sub(r"(\bhref=[\"'])([^\"']*)", lambda h: h[1] + one(h[2]), m[0])
                return re.sub(r"(\bmedia-type=[\"'])[^\"']*", lambda t: t[1] + MEDIA_TYPE.get(new.rpartition(".")[2].lower(), "application/octet-stream"), tag) if new else tag

            out = re.sub(r"<(?:\w+:)?(?:item|reference)\b[^>]*>", item, body)
        else:
            out = references.rewrite_css(body, one) if ext == "css" else references.rewrite_markup(body, one)
        return bytes(content) if out == body else package.as_utf8(out).encode()

    joined = members.join(maps, "book_id", "left")
    new = F.when(F.col("ext").isin(*_TEXTUAL), F.udf(rewrite, "binary")("path", "ext", "content", "moves")).otherwise(F.col("content"))
    return joined.withColumn("content", new).select(members.columns)


def convert_images(members: DataFrame, mode: str, codec: Codec = builtin_codec, png_to_jpg: bool = False) -> dict[str, DataFrame]:
    """``members`` with images encoded anew and references led to their new names, and ``images``.

    ``images`` tells of each what was done and the bytes before and after; an image that is broken,
    too large or that the codec cannot encode is kept, with the reason. Compressing keeps a result
    only if it is strictly smaller.
    """
    kind = "struct<format:string,width:int,height:int,has_alpha:boolean>"
    facts = F.udf(lambda b: raster.facts(bytes(b)), kind)
    found = members.where(F.col("ext").isin("jpg", "jpeg", "png", "bmp", "webp", "gif")).withColumn("f", facts("content"))
    action = images.action(F.lit(mode), F.col("f.format"), F.col("f.has_alpha"), png_to_jpg)
    found = found.withColumn("action", F.when(F.col("f").isNull(), "keep").otherwise(action))

    def encode(data, action, width, height):
        data = bytes(data)
        if not action.startswith("encode:"):
            return {"content": None, "error": None}
        if (width or 0) * (height or 0) > raster.MAX_PIXELS:
            return {"content": None, "error": "too many pixels"}
        try:
            out = codec(data, action.partition(":")[2])
        except Exception as e:
            return {"content": None, "error": f"{type(e).__name__}: {e}"}
        return {"content": out if mode != "compress" or len(out) < len(data) else None, "error": None}

    done = found.withColumn("x", F.udf(encode, "struct<content:binary,error:string>")("content", "action", "f.width", "f.height"))
    extension = F.create_map(*(F.lit(v) for kv in _EXTENSION.items() for v in kv))
    wanted = F.try_element_at(extension, F.substring_index("action", ":", -1))
    same = F.regexp_replace(F.col("ext"), "^jpeg$", "jpg") == wanted
    done = done.withColumn("extension", F.when(F.col("x.content").isNotNull() & ~same, wanted))
    moved = images.target_paths(members.select("book_id", "path").join(done.select("book_id", "path", "extension"), ["book_id", "path"], "left"))
    out = members.join(done.select("book_id", "path", F.col("x.content").alias("new")), ["book_id", "path"], "left").withColumn("content", F.coalesce("new", "content")).drop("new")
    out = redirect_members(out, moved.select("book_id", F.col("path").alias("old"), F.col("target_path").alias("new")))
    out = out.join(moved, ["book_id", "path"], "left").withColumn("path", F.coalesce("target_path", "path")).withColumn("ext", F.lower(F.substring_index("path", ".", -1)))
    report = done.join(moved, ["book_id", "path"], "left").select(
        "book_id", "path", F.col("f.format").alias("detected_format"), F.col("f.width").alias("width"), F.col("f.height").alias("height"), F.col("f.has_alpha").alias("has_alpha"),
        "action", F.length("content").cast("long").alias("bytes_in"), F.coalesce(F.length("x.content"), F.length("content")).cast("long").alias("bytes_out"), "target_path", F.col("x.error").alias("error"),
    )
    return {"members": out.select(members.columns), "images": report}


def replace_covers(members: DataFrame, packages: DataFrame, covers: DataFrame) -> DataFrame:
    """Members with the cover (book_id, cover) of each book put in; books without one stay.

    The item is the one with the cover-image property, else the one that the cover meta names, else a
    new one; both markers are set, and references to an old path are led to the new one.
    """
    have = packages.select("book_id", "opf_path", "opf").join(covers.select("book_id", "cover"), "book_id")
    names = members.groupBy("book_id").agg(F.collect_set("path").alias("taken"))

    def place(opf, opf_path, cover, taken):
        facts = raster.facts(bytes(cover))
        if not facts or facts["format"] not in _EXTENSION:
            return None
        parsed = package.parse(opf)
        items = parsed["manifest"]
        item = next((i for i in items if "cover-image" in (i["properties"] or "").split()), None)
        item = item or next((i for i in items if i["id"] == parsed["metadata"].get("cover")), None)
        old = paths.resolve_reference(opf_path, item["href"]) if item else None
        base = posixpath.dirname(old) if old else posixpath.join(posixpath.dirname(opf_path), "Images")
        ext, n = _EXTENSION[facts["format"]], 1
        new = posixpath.join(base, f"cover.{ext}")
        while new in taken and new != old:
            n += 1
            new = posixpath.join(base, f"cover-{n}.{ext}")
        if item is None:
            ids, k, key = {i["id"] for i in items}, 1, "cover-image"
            while key in ids:
                k += 1
                key = f"cover-image-{k}"
            item = {"id": key, "properties": None}
            items.append(item)
        item.update(href=posixpath.relpath(new, posixpath.dirname(opf_path) or "."), media_type=MEDIA_TYPE[ext], properties=" ".join(sorted({*(item["properties"] or "").split(), "cover-image"})))
        out = package.replace_manifest(opf, items)
        meta = f'<meta name="cover" content="{item["id"]}"/>'
        if re.search(r"<(?:\w+:)?meta\b[^>]*\bname=[\"']cover[\"'][^>]*>", out):
            out = re.sub(r"<(?:\w+:)?meta\b[^>]*\bname=[\"']cover[\"'][^>]*>", meta, out, count=1)
        else:
            out = re.sub(r"(</(?:\w+:)?metadata>)", lambda m: f"  {meta}\n{m[1]}", out, count=1)
        return {"old": old, "new": new, "opf": package.as_utf8(out).encode()}

    placed = have.join(names, "book_id").withColumn("x", F.udf(place, "struct<old:string,new:string,opf:binary>")("opf", "opf_path", "cover", "taken")).where("x IS NOT NULL")
    placed = placed.select("book_id", "opf_path", "cover", "x.*")
    out = members.join(placed.select("book_id", F.col("opf_path").alias("path"), F.col("opf").alias("new_opf")), ["book_id", "path"], "left")
    out = out.withColumn("content", F.coalesce("new_opf", "content")).select(members.columns)
    moves = placed.where("old <> new").select("book_id", "old", "new")
    kept = redirect_members(out, moves).join(placed.select("book_id", F.col("new").alias("path")), ["book_id", "path"], "left_anti")
    added = placed.select(
        "book_id", F.lit(1_000_000).alias("ord"), F.col("new").alias("path"), F.lit(8).alias("compress_type"), F.length("cover").cast("long").alias("size"),
        F.length("cover").cast("long").alias("csize"), F.lower(F.substring_index("new", ".", -1)).alias("ext"), F.col("cover").alias("content"), F.lit(None).cast("string").alias("error"),
    )
    return kept.select(members.columns).unionByName(added)


_TAG = re.compile(r"(<!--.*?-->|<!\[CDATA\[.*?\]\]>|<(?:\"[^\"]*\"|'[^']*'|[^\"'>])*>)", re.S)
_VISIBLE = re.compile(r"(\b(?:alt|title)\s*=\s*)([\"'])(.*?)(\2)", re.I | re.S)


def longest_match(table: Mapping[str, str]) -> Callable[[str], str]:
    """Text with every longest key of the table replaced, from left to right."""
    if not table:
        return lambda t: t
    pattern = re.compile("|".join(map(re.escape, sorted(table, key=len, reverse=True))))
    return lambda t: pattern.sub(lambda m: table[m[0]], t)


def convert_visible(markup: str, convert: Callable[[str], str]) -> str:
    """Visible text and alt and title attributes converted; scripts, styles, comments, CDATA and other
    markup stay."""
    out, blocked = [], 0
    for piece in _TAG.split(markup):
        if piece.startswith("<"):
            low = piece.lower()
            if low.startswith(("<script", "<style")) and not low.endswith("/>"):
                blocked += 1
            if not blocked and not low.startswith(("<!", "<?")):
                piece = _VISIBLE.sub(lambda m: m[1] + m[2] + convert(m[3]) + m[4], piece)
            if low.startswith(("</script", "</style")):
                blocked = max(0, blocked - 1)
        elif not blocked:
            piece = convert(piece)
        out.append(piece)
    return "".join(out)


def convert_text(members: DataFrame, table: Mapping[str, str]) -> dict[str, DataFrame]:
    """``members`` with visible text converted by a word table, and ``changed``: how many per book."""

    def run(content):
        body = package.decode(bytes(content))
        out = package.as_utf8(convert_visible(body, longest_match(table)))
        return out.encode()

    textual = F.col("ext").isin("xhtml", "html", "htm", "opf", "ncx")
    out = members.withColumn("new", F.when(textual, F.udf(run, "binary")("content")))
    changed = out.groupBy("book_id").agg(F.count_if(F.col("new").isNotNull() & (F.col("new") != F.col("content"))).alias("changed"))
    return {"members": out.withColumn("content", F.coalesce("new", "content")).select(members.columns), "changed": changed}
