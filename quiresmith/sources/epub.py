"""EPUB archives as tables: books, members, package documents."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiresmith.functions import package
from quiresmith.functions.paths import normalise_member

# Limits of a safe archive, and what its mimetype member holds.
MAX_MEMBER = 128 << 20
MAX_ARCHIVE = 768 << 20
MAX_RATIO = 1000
MIMETYPE = b"application/epub+zip"

MEMBERS = "book_id string, ord int, path string, compress_type int, size long, csize long, ext string, content binary, error string"


def books(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(book_id, path, length, content) of every archive under ``paths``, each once; its id is its path, so
    files of one name stay books of their own.

    Directories are searched at any depth, extensions in any case; other files are no books.
    """
    found = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[eE][pP][uU][bB]").load(list(paths))
    )
    return found.dropDuplicates(["path"]).select(F.col("path").alias("book_id"), "path", "length", "content")


def file_name(book_id):
    """The file name of a book, whose id is its path."""
    return F.element_at(F.split(book_id, "/"), -1)


def check(archive: zipfile.ZipFile) -> str | None:
    """Why an archive is unsafe or no EPUB; None if it is fine."""
    seen, total = set(), 0
    for info in archive.infolist():
        if info.is_dir():
            continue
        try:
            name = normalise_member(info.filename)
        except ValueError as e:
            return str(e)
        if name in seen:
            return f"duplicate member {name}"
        seen.add(name)
        total += info.file_size
        if info.file_size > MAX_MEMBER or total > MAX_ARCHIVE:
            return f"{name} is too large"
        if info.file_size > MAX_RATIO * max(1, info.compress_size):
            return f"{name} is packed too tightly"
    if "mimetype" not in seen or archive.read(next(i for i in archive.infolist() if i.filename == "mimetype")).strip() != MIMETYPE:
        return "no mimetype of an EPUB"
    if "META-INF/container.xml" not in seen:
        return "no container.xml"
    root = package.rootfile(package.decode(archive.read("META-INF/container.xml")))
    return None if root in seen else f"no package document {root}"


def members(books: DataFrame, validate: bool = True) -> DataFrame:
    """One row a member, in archive order; a book that cannot be read is one row with an ``error``.

    Archives are opened where they are: nothing is shuffled. With ``validate`` off, unsafe archives
    are read as far as they can be.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["book_id", "ord", "path", "compress_type", "size", "csize", "ext", "content", "error"]
        kinds = [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string()]

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for b in batches:
            for book, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows, held = [], 0
                try:
                    archive = zipfile.ZipFile(io.BytesIO(content.as_buffer() or b""))
                    if validate and (error := check(archive)):
                        raise ValueError(error)
                    for i, info in enumerate(archive.infolist()):
                        if info.is_dir():
                            continue
                        name = normalise_member(info.filename) if validate else info.filename
                        data = archive.read(info)
                        ext = name.rpartition("/")[2].rpartition(".")
                        rows.append((book, i, name, info.compress_type, info.file_size, info.compress_size, ext[2].lower() if ext[1] else "", data, None))
                        held += len(data)
                        if held > 16 << 20:
                            yield batch(rows)
                            rows, held = [], 0
                except Exception as e:  # a broken book is a row, not a failed job
                    rows = [(book, None, None, None, None, None, None, None, f"{type(e).__name__}: {e}")]
                if rows:
                    yield batch(rows)

    return books.select("book_id", "content").mapInArrow(run, MEMBERS)


def packages(members: DataFrame) -> DataFrame:
    """(book_id, opf_path, opf, parsed): the package document of each book, its tables as JSON.

    It is the one that container.xml names, else the first ``.opf`` in archive order.
    """
    as_text = F.udf(lambda b: package.decode(bytes(b)) if b is not None else None, "string")
    root = F.udf(lambda t: package.rootfile(t) if t else None, "string")
    container = members.where("lower(path) = 'meta-inf/container.xml'").select("book_id", root(as_text("content")).alias("named"))
    opfs = members.where("ext = 'opf'").select("book_id", "ord", "path", "content")
    best = opfs.join(container, "book_id", "left").withColumn("key", F.struct((F.col("path") != F.coalesce("named", F.lit(""))).alias("other"), "ord"))
    first = best.groupBy("book_id").agg(F.min_by(F.struct("path", "content"), "key").alias("x"))
    parsed = F.udf(lambda t: json.dumps(package.parse(t)), "string")
    return first.select("book_id", F.col("x.path").alias("opf_path"), as_text("x.content").alias("opf")).withColumn("parsed", parsed("opf"))


_ITEMS = "array<struct<id:string,href:string,media_type:string,properties:string>>"
_SPINE = "array<struct<idref:string,linear:string,properties:string>>"


def manifest(packages: DataFrame) -> DataFrame:
    items = F.from_json(F.get_json_object("parsed", "$.manifest"), _ITEMS)
    return packages.select("book_id", "opf_path", F.posexplode(items).alias("pos", "x")).select("book_id", "opf_path", "pos", "x.*")


def spine(packages: DataFrame) -> DataFrame:
    refs = F.from_json(F.get_json_object("parsed", "$.spine"), _SPINE)
    return packages.select("book_id", F.posexplode(refs).alias("pos", "x")).select("book_id", "pos", "x.*")


def metadata(packages: DataFrame) -> DataFrame:
    names = ("title", "creator", "language", "subject", "source", "identifier", "cover")
    return packages.select(
        "book_id", "opf_path", F.get_json_object("parsed", "$.version").alias("version"), F.get_json_object("parsed", "$.parse_mode").alias("parse_mode"),
        F.get_json_object("parsed", "$.toc").alias("toc_id"), *(F.get_json_object("parsed", f"$.metadata.{n}").alias(n) for n in names),
    )


def encryption(members: DataFrame) -> DataFrame:
    """(book_id, uris, key_names, algorithms, text_or_css) of books with an encryption.xml that can be read."""
    kind = "struct<uris:array<string>,key_names:array<string>,algorithms:array<string>,text_or_css:boolean>"
    read = F.udf(lambda b: package.encryption(package.decode(bytes(b))) if b is not None else None, kind)
    found = members.where("lower(path) = 'meta-inf/encryption.xml'").select("book_id", read("content").alias("x"))
    return found.where("x IS NOT NULL").select("book_id", "x.*")
