"""Archive paths and references, as column expressions and as the plain functions behind UDFs."""

from __future__ import annotations

import posixpath
from urllib.parse import quote, unquote, urlsplit, urlunsplit

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions of each resource type, the media types of undeclared members, and what a
# file name in an archive must not hold.
TYPE_OF_EXTENSION = {
    "xhtml": "text", "html": "text", "htm": "text", "xml": "text", "css": "css",
    "jpg": "image", "jpeg": "image", "png": "image", "gif": "image", "bmp": "image", "webp": "image", "svg": "image",
    "ttf": "font", "otf": "font", "woff": "font", "woff2": "font",
    "mp3": "audio", "wav": "audio", "ogg": "audio", "m4a": "audio", "mp4": "video", "webm": "video",
    "ncx": "toc",
}
MEDIA_TYPE = {
    "xhtml": "application/xhtml+xml", "html": "application/xhtml+xml", "htm": "application/xhtml+xml",
    "css": "text/css", "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif",
    "bmp": "image/bmp", "webp": "image/webp", "svg": "image/svg+xml", "ttf": "font/ttf", "otf": "font/otf",
    "woff": "font/woff", "woff2": "font/woff2", "mp3": "audio/mpeg", "wav": "audio/wav", "ogg": "audio/ogg",
    "mp4": "video/mp4", "webm": "video/webm", "ncx": "application/x-dtbncx+xml", "js": "application/javascript",
}
UNSAFE_NAME = r'[\\/:*?"<>|]'


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def resource_type(ext: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in TYPE_OF_EXTENSION.items() for x in kv))
    return F.coalesce(F.try_element_at(table, ext), F.lit("other"))


def media_resource_type(media: Column) -> Column:
    """Resource type of a media type, first match wins."""
    m = F.lower(media)
    return (
        F.when(m == "application/xhtml+xml", "text").when(m == "text/css", "css").when(m.startswith("image/"), "image")
        .when(m.rlike("font|opentype|truetype"), "font").when(m.startswith("audio/"), "audio").when(m.startswith("video/"), "video")
        .when(m == "application/x-dtbncx+xml", "toc").otherwise("other")
    )


def path_part(reference: Column) -> Column:
    return F.substring_index(reference, "#", 1)


def fragment(reference: Column) -> Column:
    """What follows the first ``#``; null without one."""
    return F.when(reference.contains("#"), F.substring(reference, F.instr(reference, "#") + 1, F.length(reference)))


def is_external(reference: Column) -> Column:
    return reference.rlike(r"^([A-Za-z][A-Za-z0-9+.\-]*:|//)")


def normalise(path: Column) -> Column:
    """``.``, ``..`` and empty steps resolved; steps above the root are dropped."""
    steps = F.split(path, "/")
    kept = F.aggregate(
        steps,
        F.array().cast("array<string>"),
        lambda acc, x: F.when(x.isin("", "."), acc)
        .when(x == "..", F.when(F.size(acc) > 0, F.slice(acc, 1, F.size(acc) - 1)).otherwise(acc))
        .otherwise(F.concat(acc, F.array(x))),
    )
    return F.array_join(kept, "/")


def resolve(document: Column, reference: Column) -> Column:
    """Path in the archive of a relative reference; one that starts with ``/`` counts from the root."""
    base = F.regexp_replace(document, "[^/]*$", "")
    return normalise(F.when(reference.startswith("/"), reference).otherwise(F.concat(base, reference)))


def normalise_member(name: str) -> str:
    """A member's path with forward slashes; raises for one that is absolute, empty or leaves the archive."""
    path = posixpath.normpath(name.replace("\\", "/"))
    if not name.strip("/\\") or path.startswith("/") or path in (".", "..") or path.startswith("../") or path[1:2] == ":":
        raise ValueError(f"unsafe member path {name!r}")
    return path


def resolve_reference(document: str, reference: str) -> str | None:
    """Archive path that a document's reference names; None if it is external or names no path."""
    try:
        parts = urlsplit(reference.strip())
    except ValueError:
        return None
    if parts.scheme or parts.netloc or not parts.path:
        return None
    path = unquote(parts.path)
    joined = path.lstrip("/") if path.startswith("/") else posixpath.join(posixpath.dirname(document), path)
    path = posixpath.normpath(joined)
    return None if path.startswith("..") or path == "." else path


def relative(document: str, target: str) -> str:
    return posixpath.relpath(target, posixpath.dirname(document) or ".")


def redirect(reference: str, document: str, target: str) -> str:
    """The reference led to ``target``, its query and fragment kept."""
    parts = urlsplit(reference)
    return urlunsplit(("", "", quote(relative(document, target), safe="/~!$&'()*+,;=:@-._"), parts.query, parts.fragment))
