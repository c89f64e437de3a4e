"""The three rewrite tasks: new names for every file, and every reference led to them.

One relational plan: members and package documents are scanned once; manifest repair, naming and
numbering are joins and windows on small rows without content; a book's path map (bounded by its
archive) is joined to its text members only, and one Arrow pass rewrites their references.
"""

from __future__ import annotations

import posixpath
from dataclasses import dataclass
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiresmith.functions import naming, package, references, text
from quiresmith.functions.paths import MEDIA_TYPE, UNSAFE_NAME, media_resource_type, resolve
from quiresmith.operators import manifest as op
from quiresmith.shelf import Shelf
from quiresmith.sources import epub

# Where each type of resource goes.
DIRECTORY = {"text": "Text", "css": "Styles", "image": "Images", "font": "Fonts", "audio": "Audio", "video": "Video", "other": "Misc"}


@dataclass(frozen=True)
class Policy:
    """What sets a task apart: the name it gives, the books it skips, whether slim ids are renamed."""

    name: str
    skip_when: bool | None = None  # skip books whose names are (True) or are not (False) obfuscated
    renames_slim: bool = False


REFORMAT = Policy("reformat_epub")
DECRYPT = Policy("decrypt_epub", skip_when=False, renames_slim=True)
ENCRYPT = Policy("encrypt_epub", skip_when=True)


def resources(packages: DataFrame, members: DataFrame) -> DataFrame:
    """Repaired manifest: declared items that exist, each path once, and undeclared members.

    (book_id, pos, id, href, book_path, media_type, properties, resource_type, origin)
    """
    items = epub.manifest(packages).withColumn("book_path", resolve(F.col("opf_path"), F.col("href")))
    spine = epub.spine(packages).select("book_id", F.col("idref").alias("id"))
    cover = epub.metadata(packages).where("cover IS NOT NULL").select("book_id", F.col("cover").alias("id"))
    items = op.resolve_duplicates(items, spine.unionByName(cover)).drop("is_used")
    files = members.where("path IS NOT NULL").select("book_id", "path", "ext")
    real = files.select("book_id", F.lower("path").alias("low"), F.col("path").alias("real")).groupBy("book_id", "low").agg(F.min("real").alias("real"))
    items = items.withColumn("low", F.lower("book_path")).join(real, ["book_id", "low"]).withColumn("book_path", F.col("real")).drop("low", "real")
    loose = files.where(F.col("ext").isin(*MEDIA_TYPE) & ~F.lower("path").startswith("meta-inf/"))
    loose = op.undeclared(loose, items).join(packages.select("book_id", "opf_path"), "book_id")
    ids = op.allocate_ids(loose.select("book_id", "path"), items.select("book_id", "id"))
    media = F.create_map(*(F.lit(x) for kv in MEDIA_TYPE.items() for x in kv))
    added = loose.join(ids, ["book_id", "path"]).select(
        "book_id", "opf_path", F.lit(1_000_000).alias("pos"), "id", F.col("path").alias("href"), F.element_at(media, F.col("ext")).alias("media_type"),
        F.lit(None).cast("string").alias("properties"), F.col("path").alias("book_path"), F.lit("discovered").alias("origin"),
    )
    both = items.withColumn("origin", F.lit("declared")).unionByName(added)
    kind = media_resource_type(F.col("media_type"))
    return both.withColumn("resource_type", F.when(kind == "toc", "toc").when(F.lower("href").rlike(r"\.(ttf|otf|woff2?)$"), "font").otherwise(kind))


def obfuscated(resources: DataFrame) -> DataFrame:
    """(book_id, encrypted): whether a file name holds what no file name should."""
    base = F.regexp_extract("href", "([^/]*)$", 1)
    return resources.groupBy("book_id").agg(F.max(base.rlike(UNSAFE_NAME)).alias("encrypted"))


def _names(res: DataFrame, policy: Policy) -> DataFrame:
    """Resources with ``name``, the task's new name, and ``new_id``."""
    base = F.regexp_extract("book_path", "([^/]*)$", 1)
    res = res.withColumn("base", base).withColumn("slim", (F.col("resource_type") == "image") & naming.is_slim(base))
    ext = F.lower(naming.suffix(F.col("base")))
    if policy == REFORMAT:
        return res.withColumn("name", F.col("base")).withColumn("new_id", F.col("id"))
    key = F.lower(naming.slim_base(F.col("base")))
    own = res.where("resource_type = 'image' AND NOT slim").groupBy("book_id", key.alias("key")).agg(F.min("id").alias("base_id"))
    res = res.withColumn("key", key).join(own, ["book_id", "key"], "left")
    stem = naming.stem(F.coalesce(F.when(F.col("slim"), F.col("base_id")), F.col("id")))
    mark = F.when(F.col("slim"), "~slim").otherwise("")
    bare = F.regexp_replace(stem, naming.SLIM, "")
    if policy == ENCRYPT:
        hidden = text.binary_name(F.substring_index(F.coalesce(F.when(F.col("slim"), F.col("base_id")), F.col("id")), ".", 1))
        return res.withColumn("name", F.concat(F.lit("_"), hidden, mark, ext)).withColumn("new_id", F.col("id"))
    bare = F.when(F.col("slim"), bare).otherwise(stem)
    safe = F.when(bare.rlike(UNSAFE_NAME), F.md5(bare)).otherwise(bare)
    new_id = F.when(F.col("slim"), F.concat(bare, F.lit("~slim"), naming.suffix(F.coalesce("base_id", "id")))).otherwise(F.col("id"))
    return res.withColumn("name", F.concat(safe, mark, ext)).withColumn("new_id", new_id)


def plan(packages: DataFrame, members: DataFrame, policy: Policy) -> DataFrame:
    """Resources with ``target``: the path that each gets in the new archive."""
    named = _names(resources(packages, members), policy)
    numbered = op.number_names(named.select("book_id", "resource_type", "pos", "book_path", "name"))
    directory = F.create_map(*(F.lit(x) for kv in DIRECTORY.items() for x in kv))
    out = named.drop("name").join(numbered, ["book_id", "resource_type", "pos", "book_path"])
    target = F.when(F.col("resource_type") == "toc", F.lit("OEBPS/toc.ncx")).otherwise(F.concat(F.lit("OEBPS/"), F.element_at(directory, F.col("resource_type")), F.lit("/"), "new_name"))
    return out.withColumn("target", target)


def lead(reference: str, document: str, source: str, paths: dict[str, str]) -> tuple[str, str | None]:
    """The reference as seen from ``document``'s new place, and how it fared: None, corrected or missing.

    ``source`` is the old place; ``paths`` maps lower-cased old paths to "old path, new path".
    """
    part, mark, fragment = reference.partition("#")
    path = unquote(part)
    if not path or path.startswith(("//", "data:")) or ":" in path.split("/")[0] and posixpath.normpath(posixpath.join(posixpath.dirname(source), path)).lower() not in paths:
        return reference, None
    old = posixpath.normpath(posixpath.join(posixpath.dirname(source), path)).lstrip("/")
    found = paths.get(old.lower())
    if not found:
        return reference, "missing"
    real, _, new = found.partition("\n")
    href = quote(posixpath.relpath(new, posixpath.dirname(document) or "."), safe="/~!$&'()*+,;=@-._")
    return href + mark + fragment, None if real == old else "corrected"


def rewrite_member(data: bytes, kind: str, source: str, target: str, paths: dict[str, str]) -> tuple[bytes, list[dict]]:
    """A text member with its references led anew, and the links that were corrected or lead nowhere."""
    issues: list[dict] = []

    def one(ref: str) -> str:
        new, status = lead(ref, target, source, paths)
        if status:
            issues.append({"href": ref, "status": status})
        return new

    decoded = package.decode(data)
    out = references.rewrite_css(decoded, one) if kind == "css" else references.rewrite_markup(decoded, one)
    if kind == "text" and not out.lstrip().startswith("<?xml"):
        out = '<?xml version="1.0" encoding="utf-8"?>\n' + out
    return package.as_utf8(out).encode(), issues


_ISSUES = "struct<content:binary,issues:array<struct<href:string,status:string>>>"


def run(members: DataFrame, policy: Policy) -> dict[str, DataFrame]:
    """Tables of a rewrite: ``members`` (book_id, ord, path, content), ``link_issues``, ``opf_issues``, ``skipped``."""
    shelf = Shelf(members.sparkSession, policy.name)
    good = members.where("error IS NULL")
    # one pass over the archives gives the listing and the package documents; the rest is small
    is_package = (F.col("ext") == "opf") | F.lower("path").isin("meta-inf/container.xml", "meta-inf/encryption.xml")
    index = shelf.put(good.select("book_id", "ord", "path", "ext", F.when(is_package, F.col("content")).alias("content")))
    packages = shelf.put(epub.packages(index))
    planned = shelf.put(plan(packages, index, policy))
    listed = epub.encryption(index).where(F.size("uris") > 0).select("book_id").distinct().withColumn("listed", F.lit(True))
    state = obfuscated(planned)
    if policy == DECRYPT:  # what encryption.xml lists counts as well
        state = state.join(listed, "book_id", "left").select("book_id", (F.col("encrypted") | F.coalesce("listed", F.lit(False))).alias("encrypted"))
    skip = state.where(F.col("encrypted") == policy.skip_when) if policy.skip_when is not None else state.where(F.lit(False))
    skip = shelf.put(skip)
    todo = packages.join(skip.select("book_id"), "book_id", "left_anti")
    planned = planned.join(skip.select("book_id"), "book_id", "left_anti")
    entry = F.struct(F.lower("book_path").alias("low"), F.concat("book_path", F.lit("\n"), "target").alias("to"))
    maps = planned.groupBy("book_id").agg(F.map_from_entries(F.array_distinct(F.collect_list(entry))).alias("paths"))
    content = good.select("book_id", F.col("path").alias("book_path"), "ord", "content")
    files = planned.select("book_id", "book_path", "resource_type", "target").join(content, ["book_id", "book_path"]).join(maps, "book_id")
    textual = F.col("resource_type").isin("text", "css", "toc") | F.lower("book_path").endswith(".svg")

    def rewrite(data, kind, source, target, paths):
        new, issues = rewrite_member(bytes(data), kind, source, target, paths)
        return {"content": new, "issues": issues}

    done = files.withColumn("x", F.when(textual, F.udf(rewrite, _ISSUES)("content", "resource_type", "book_path", "target", "paths")))
    item = F.struct("pos", "new_id", "target", "media_type", "properties", "id")
    listed = planned.groupBy("book_id").agg(F.array_sort(F.collect_list(item)).alias("items"))

    def package_of(opf, opf_path, items, paths):
        rows = [{"id": i["new_id"], "href": quote(posixpath.relpath(i["target"], "OEBPS"), safe="/~!$&'()*+,;=@-._"), "media_type": i["media_type"] or "", "properties": i["properties"]} for i in items]
        out = package.replace_manifest(opf, rows)
        out = package.rename_ids(out, {i["id"]: i["new_id"] for i in items if i["id"] != i["new_id"]})
        guide = r"(<(?:\w+:)?reference\b[^>]*\bhref=)([\"'])(.*?)\2"
        import re

        out = re.sub(guide, lambda m: f"{m[1]}{m[2]}{lead(m[3], 'OEBPS/content.opf', opf_path, paths)[0]}{m[2]}", out)
        return package.as_utf8(package.stamp(out)).encode()

    opf = todo.join(listed, "book_id").join(maps, "book_id").select("book_id", F.lit(2).alias("ord"), F.lit("OEBPS/content.opf").alias("path"), F.udf(package_of, "binary")("opf", "opf_path", "items", "paths").alias("content"))
    container = '<?xml version="1.0" encoding="UTF-8"?>\n<container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container">\n  <rootfiles>\n    <rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/>\n  </rootfiles>\n</container>\n'
    fixed = [(0, "mimetype", epub.MIMETYPE.decode()), (1, "META-INF/container.xml", container)]
    boot = todo.select("book_id", F.explode(F.array(*(F.struct(F.lit(o).alias("ord"), F.lit(p).alias("path"), F.lit(c).cast("binary").alias("content")) for o, p, c in fixed))).alias("x")).select("book_id", "x.*")
    body = done.select("book_id", (F.col("ord") + 10).alias("ord"), F.col("target").alias("path"), F.coalesce("x.content", "content").alias("content"))
    spine = epub.spine(todo).select("book_id", "idref")
    return {
        "members": boot.unionByName(opf).unionByName(body),
        "link_issues": done.select("book_id", F.col("book_path").alias("doc_path"), F.explode("x.issues").alias("i")).select("book_id", "doc_path", "i.*"),
        "opf_issues": op.issues(planned.select("book_id", "id", "book_path", "resource_type"), spine),
        "skipped": skip.select("book_id", "encrypted"),
    }
