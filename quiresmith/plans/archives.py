"""Archive operators over books made of the page corpus: twenty pages a book.

Most queries hold a short chapter with the digest of each page, so that SQL can follow the operators
into the text; ``whole`` ones pack the pages themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiresmith.functions import raster
from quiresmith.operators import archive, fonts, rewrite, workspace
from quiresmith.registry import register
from quiresmith.shelf import Shelf
from quiresmith.sources import epub
from quiresmith.tables import table

_CONTAINER = '<?xml version="1.0"?><container><rootfiles><rootfile full-path="OPS/package.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'
_CSS = '@font-face{font-family:"Plain";src:url(f.ttf)} @font-face{font-family:Lost;src:url(no.ttf)} p{font-family:Plain} b{font-family:serif}'
_BOOK = "'b' || lpad(CAST(page_id // 20 AS VARCHAR), 9, '0') || '.epub'"
_PATH = "'OPS/Text/' || page_id || '.xhtml'"
_VISIBLE = """'<html><head><title>t</title><link rel="stylesheet" href="../m.css"/></head><body><p>' || md5(html) || '</p><b>' || page_id || '</b><a href="' || (page_id // 20 * 20) || '.xhtml#top">first</a></body></html>'"""
_WHOLE = """'<link rel="stylesheet" href="../m.css"/>' || coalesce(html, '')"""


def members(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    """(book_id, ord, path, content): chapters, a style sheet, a font name without a font program, a package.

    A chapter is the whole html of a page after a link to the style sheet, or a short text with its digest.
    """
    book = F.format_string("b%09d.epub", (F.col("page_id") / 20).cast("long"))
    body = F.concat(
        F.lit('<html><head><title>t</title><link rel="stylesheet" href="../m.css"/></head><body><p>'), F.md5("html"), F.lit("</p><b>"), F.col("page_id").cast("string"),
        F.lit('</b><a href="'), ((F.col("page_id") / 20).cast("long") * 20).cast("string"), F.lit('.xhtml#top">first</a></body></html>'),
    )
    if whole:
        body = F.concat(F.lit('<link rel="stylesheet" href="../m.css"/>'), F.coalesce("html", F.lit("")))
    pages = table(spark, sf_dir, "pages").select(book.alias("book_id"), "page_id", body.alias("body"))
    chapters = pages.select("book_id", (F.col("page_id") % 20 + 10).cast("int").alias("ord"), F.concat(F.lit("OPS/Text/"), F.col("page_id").cast("string"), F.lit(".xhtml")).alias("path"), F.col("body").cast("binary").alias("content"))
    item = F.concat(F.lit('<item id="p'), F.col("page_id").cast("string"), F.lit('" href="Text/'), F.col("page_id").cast("string"), F.lit('.xhtml" media-type="application/xhtml+xml"/>'))
    ref = F.concat(F.lit('<itemref idref="p'), F.col("page_id").cast("string"), F.lit('"/>'))
    lists = pages.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("page_id", item.alias("item"), ref.alias("ref")))).alias("x"))
    opf = F.concat(
        F.lit('<package version="3.0"><metadata><title>t</title></metadata><manifest><item id="css" href="m.css" media-type="text/css"/><item id="f" href="f.ttf" media-type="font/ttf"/>'),
        F.array_join(F.transform("x", lambda r: r["item"]), ""), F.lit("</manifest><spine>"), F.array_join(F.transform("x", lambda r: r["ref"]), ""), F.lit("</spine></package>"),
    )
    fixed = [(0, "mimetype", F.lit(epub.MIMETYPE.decode())), (1, "META-INF/container.xml", F.lit(_CONTAINER)), (2, "OPS/package.opf", opf), (3, "OPS/m.css", F.lit(_CSS)), (4, "OPS/f.ttf", F.lit("no font program"))]
    rows = F.explode(F.array(*(F.struct(F.lit(o).alias("ord"), F.lit(p).alias("path"), c.cast("binary").alias("content")) for o, p, c in fixed)))
    return lists.select("book_id", rows.alias("r")).select("book_id", "r.*").unionByName(chapters)


def scanned(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    """The books packed into archives and scanned again."""
    packed = Shelf(spark, "books").put(archive.pack(members(spark, sf_dir, whole)).select("book_id", "content"))
    return epub.members(packed)


@register("archive_round_trip", f"SELECT {_BOOK} AS book_id, {_PATH} AS path, md5({_VISIBLE}) AS digest FROM pages")
def archive_round_trip(spark, sf_dir):
    out = scanned(spark, sf_dir).where("error IS NULL AND ext = 'xhtml'")
    return out.select("book_id", "path", F.md5("content").alias("digest"))


@register("archive_members", f"SELECT {_BOOK} AS book_id, count(*) + 5 AS n, 'mimetype' AS first_path, 0 AS stored FROM pages GROUP BY 1")
def archive_members(spark, sf_dir):
    """Members of each archive, the first of them, and how that is packed."""
    out = scanned(spark, sf_dir).groupBy("book_id").agg(F.count("*").alias("n"), F.min_by(F.struct("path", "compress_type"), "ord").alias("f"))
    return out.select("book_id", "n", F.col("f.path").alias("first_path"), F.col("f.compress_type").alias("stored"))


@register("archive_manifest", f"SELECT {_BOOK} AS book_id, 'p' || page_id AS id, 'Text/' || page_id || '.xhtml' AS href, 'application/xhtml+xml' AS media_type FROM pages")
def archive_manifest(spark, sf_dir):
    found = epub.manifest(epub.packages(scanned(spark, sf_dir)))
    return found.where("media_type LIKE '%xhtml%'").select("book_id", "id", "href", "media_type")


@register(
    "rewrite_reformat",
    f"""SELECT {_BOOK} AS book_id, 'OEBPS/Text/' || page_id || '.xhtml' AS path,
        md5('<?xml version="1.0" encoding="utf-8"?>' || chr(10) || replace({_VISIBLE}, 'href="../m.css"', 'href="../Styles/m.css"')) AS digest FROM pages""",
)
def rewrite_reformat(spark, sf_dir):
    out = rewrite.run(scanned(spark, sf_dir), rewrite.REFORMAT)["members"]
    return out.where("path LIKE 'OEBPS/Text/%'").select("book_id", "path", F.md5("content").alias("digest"))


_BITS = """array_to_string(list_transform(string_split(md5('p' || page_id), ''), lambda x: CASE x
  WHEN '0' THEN '0000' WHEN '1' THEN '0001' WHEN '2' THEN '0010' WHEN '3' THEN '0011' WHEN '4' THEN '0100' WHEN '5' THEN '0101'
  WHEN '6' THEN '0110' WHEN '7' THEN '0111' WHEN '8' THEN '1000' WHEN '9' THEN '1001' WHEN 'a' THEN '1010' WHEN 'b' THEN '1011'
  WHEN 'c' THEN '1100' WHEN 'd' THEN '1101' WHEN 'e' THEN '1110' ELSE '1111' END), '')"""


@register("rewrite_encrypt", f"SELECT {_BOOK} AS book_id, 'OEBPS/Text/_' || translate(regexp_replace({_BITS}, '^0+', ''), '10', '*:') || '.xhtml' AS path FROM pages")
def rewrite_encrypt(spark, sf_dir):
    out = rewrite.run(scanned(spark, sf_dir), rewrite.ENCRYPT)["members"]
    return out.where("path LIKE 'OEBPS/Text/%'").select("book_id", "path")


@register("rewrite_decrypt_skips", f"SELECT DISTINCT {_BOOK} AS book_id, false AS encrypted FROM pages")
def rewrite_decrypt_skips(spark, sf_dir):
    """Books with plain names have nothing to restore."""
    return rewrite.run(scanned(spark, sf_dir), rewrite.DECRYPT)["skipped"].select("book_id", "encrypted")


@register("rewrite_decrypt", f"SELECT {_BOOK} AS book_id, 'OEBPS/Text/p' || page_id || '.xhtml' AS path FROM pages")
def rewrite_decrypt(spark, sf_dir):
    """Names restored from the ids of books that were obfuscated before."""
    hidden = rewrite.run(scanned(spark, sf_dir), rewrite.ENCRYPT)["members"]
    packed = Shelf(spark, "hidden").put(archive.pack(hidden).select("book_id", "content"))
    out = rewrite.run(epub.members(packed, validate=False), rewrite.DECRYPT)["members"]
    return out.where("path LIKE 'OEBPS/Text/%'").select("book_id", "path")


@register("list_fonts", f"SELECT DISTINCT {_BOOK} AS book_id, 'Plain' AS families FROM pages")
def list_fonts(spark, sf_dir):
    return fonts.list_families(scanned(spark, sf_dir)).select("book_id", F.array_join("families", ",").alias("families"))


@register("font_pieces", f"SELECT {_BOOK} AS book_id, {_PATH} AS path, md5(html) AS text FROM pages")
def font_pieces(spark, sf_dir):
    """Texts set in the embedded font: the cascade gives it to p, and takes it from b."""
    return fonts.pieces(scanned(spark, sf_dir)).where("font = 'OPS/f.ttf'").select("book_id", "path", "text")


@register("provenance_stamp", f"SELECT DISTINCT {_BOOK} AS book_id, CAST(1 AS BIGINT) AS marks FROM pages")
def provenance_stamp(spark, sf_dir):
    twice = archive.stamp(archive.stamp(scanned(spark, sf_dir))).where("ext = 'opf'")
    marks = F.size(F.split(F.col("content").cast("string"), 'name="generator"')) - 1
    return twice.select("book_id", marks.cast("long").alias("marks"))


@register("script_conversion", f"SELECT {_BOOK} AS book_id, {_PATH} AS path, md5(replace({_VISIBLE}, '>first<', '>FIRST<')) AS digest FROM pages")
def script_conversion(spark, sf_dir):
    out = workspace.convert_text(scanned(spark, sf_dir), {"first": "FIRST", "link": "LINK"})["members"]
    return out.where("ext = 'xhtml'").select("book_id", "path", F.md5("content").alias("digest"))


@register("spine_order", f"SELECT {_BOOK} AS book_id, row_number() OVER (PARTITION BY page_id // 20 ORDER BY page_id) - 1 AS pos, 'p' || page_id AS idref FROM pages")
def spine_order(spark, sf_dir):
    return epub.spine(epub.packages(scanned(spark, sf_dir))).select("book_id", F.col("pos").cast("long").alias("pos"), "idref")


@register("book_metadata", f"SELECT DISTINCT {_BOOK} AS book_id, '3.0' AS version, 't' AS title, 'xml' AS parse_mode, 'OPS/package.opf' AS opf_path FROM pages")
def book_metadata(spark, sf_dir):
    return epub.metadata(epub.packages(scanned(spark, sf_dir))).select("book_id", "version", "title", "parse_mode", "opf_path")


@register(
    "rewritten_resources",
    f"""SELECT DISTINCT {_BOOK} AS book_id, path, content FROM pages, (VALUES
         ('OEBPS/Styles/m.css', '{_CSS.replace("f.ttf", "../Fonts/f.ttf")}'), ('OEBPS/Fonts/f.ttf', 'no font program'), ('mimetype', 'application/epub+zip')) AS v(path, content)""",
)
def rewritten_resources(spark, sf_dir):
    """Style sheets with their references led anew, and members that are copied as they are."""
    out = rewrite.run(scanned(spark, sf_dir), rewrite.REFORMAT)["members"]
    return out.where("path LIKE 'OEBPS/Styles/%' OR path LIKE 'OEBPS/Fonts/%' OR path = 'mimetype'").select("book_id", "path", F.col("content").cast("string").alias("content"))


@register(
    "rewritten_package",
    f"""SELECT {_BOOK} AS book_id, 'p' || page_id AS id, 'Text/' || page_id || '.xhtml' AS href, 'application/xhtml+xml' AS media_type, row_number() OVER (PARTITION BY page_id // 20 ORDER BY page_id) - 1 AS place FROM pages
        UNION ALL SELECT DISTINCT {_BOOK}, id, href, media_type, NULL FROM pages, (VALUES ('css', 'Styles/m.css', 'text/css'), ('f', 'Fonts/f.ttf', 'font/ttf')) AS v(id, href, media_type)""",
)
def rewritten_package(spark, sf_dir):
    """The manifest and reading order of rewritten books, read back from their package documents."""
    out = rewrite.run(scanned(spark, sf_dir), rewrite.REFORMAT)["members"]
    packages = epub.packages(epub.members(Shelf(spark, "rewritten").put(archive.pack(out).select("book_id", "content"))))
    spine = epub.spine(packages).select("book_id", F.col("idref").alias("id"), F.col("pos").cast("long").alias("place"))
    return epub.manifest(packages).join(spine, ["book_id", "id"], "left").select("book_id", "id", "href", "media_type", "place")


@register("rewrite_link_issues", f"SELECT DISTINCT {_BOOK} AS book_id, 'OPS/m.css' AS doc_path, 'no.ttf' AS href, 'missing' AS status FROM pages")
def rewrite_link_issues(spark, sf_dir):
    return rewrite.run(scanned(spark, sf_dir), rewrite.REFORMAT)["link_issues"].select("book_id", "doc_path", "href", "status")


@register(
    "removed_font_references",
    f"""SELECT DISTINCT {_BOOK} AS book_id, '@font-face{{font-family:Lost;src:url(no.ttf)}} p{{}} b{{font-family:serif}}' AS sheet, 0 AS listed, 0 AS kept FROM pages""",
)
def removed_font_references(spark, sf_dir):
    """Books without their font: its rule, its name in families, its manifest item and the file are gone."""
    before = scanned(spark, sf_dir)
    out = fonts.remove_references(before, before.where("ext = 'ttf'").select("book_id", "path"))
    body = F.col("content").cast("string")
    return out.groupBy("book_id").agg(
        F.max(F.when(F.col("ext") == "css", body)).alias("sheet"),
        F.max(F.when(F.col("ext") == "opf", body.contains("f.ttf").cast("int"))).alias("listed"),
        F.max((F.col("ext") == "ttf").cast("int")).alias("kept"),
    )


@register("recovered_text", f"SELECT {_BOOK} AS book_id, {_PATH} AS path, md5(replace({_VISIBLE}, md5(html), translate(md5(html), '0a', '〇α'))) AS digest FROM pages")
def recovered_text(spark, sf_dir):
    """Texts written in the embedded font translated by its table, all others as they were."""
    books = scanned(spark, sf_dir)
    moves = books.where("ext = 'ttf'").select("book_id", F.create_map("path", F.create_map(F.lit("0"), F.lit("〇"), F.lit("a"), F.lit("α"))).alias("tables"))
    return fonts.apply_tables(books, moves).where("ext = 'xhtml'").select("book_id", "path", F.md5("content").alias("digest"))


@register("font_usage", f"SELECT {_BOOK} AS book_id, 'OPS/f.ttf' AS font, string_agg(DISTINCT ch, '' ORDER BY ch) AS chars FROM (SELECT page_id, unnest(string_split(md5(html), '')) AS ch FROM pages) GROUP BY ALL")
def font_usage(spark, sf_dir):
    used = fonts.usage(scanned(spark, sf_dir))
    return used.select("book_id", "font", F.array_join(F.array_sort(F.filter(F.split("chars", ""), lambda c: c != "")), "").alias("chars"))


@register("font_targets", f"SELECT DISTINCT {_BOOK} AS book_id, 'OPS/f.ttf' AS font FROM pages WHERE page_id // 20 % 2 = 0")
def font_targets(spark, sf_dir):
    """Fonts by the families that are wanted of each book; names are compared without case and quotes."""
    books = scanned(spark, sf_dir)
    even = F.substring("book_id", 2, 9).cast("long") % 2 == 0
    wanted = books.select("book_id").distinct().select("book_id", F.when(even, "'PLAIN'").otherwise("Lost").alias("family"))
    return fonts.target_fonts(books, wanted)


_PNG = raster.write_png(3, 2, bytes(range(18)))


@register("covers_placed", f"SELECT DISTINCT {_BOOK} AS book_id, 'OPS/Images/cover.png' AS path, md5(from_hex('{_PNG.hex()}')) AS digest, 1 AS marked, 1 AS named FROM pages")
def covers_placed(spark, sf_dir):
    """A cover put into books that had none: the file, its mark in the manifest and its meta."""
    books = scanned(spark, sf_dir)
    covers = books.select("book_id").distinct().withColumn("cover", F.lit(_PNG))
    out = workspace.replace_covers(books, epub.packages(books), covers)
    opf = out.where("ext = 'opf'").select("book_id", F.col("content").cast("string").alias("opf"))
    marked = F.size(F.split("opf", 'properties="cover-image"')) - 1
    named = F.size(F.split("opf", '<meta name="cover" content="cover-image"/>')) - 1
    return out.where("ext = 'png'").join(opf, "book_id").select("book_id", "path", F.md5("content").alias("digest"), marked.alias("marked"), named.alias("named"))


_ENCRYPTION = (
    '<encryption xmlns="urn:oasis:names:tc:opendocument:xmlns:container" xmlns:e="http://www.w3.org/2001/04/xmlenc#"><e:EncryptedData><e:EncryptionMethod Algorithm="http://www.w3.org/2001/04/xmlenc#aes128-ctr"/>'
    '<k:KeyInfo xmlns:k="http://www.w3.org/2000/09/xmldsig#"><k:KeyName> some key </k:KeyName></k:KeyInfo><e:CipherData><e:CipherReference URI="OEBPS/Text/a.xhtml"/></e:CipherData></e:EncryptedData></encryption>'
)


def _listed(spark, sf_dir):
    plain = members(spark, sf_dir)
    even = plain.select("book_id").distinct().where(F.substring("book_id", 2, 9).cast("long") % 2 == 0)
    more = even.select("book_id", F.lit(9).alias("ord"), F.lit("META-INF/encryption.xml").alias("path"), F.lit(_ENCRYPTION).cast("binary").alias("content"))
    packed = Shelf(spark, "listed").put(archive.pack(plain.unionByName(more)).select("book_id", "content"))
    return epub.members(packed)


@register("encryption_listed", f"SELECT DISTINCT {_BOOK} AS book_id, 'OEBPS/Text/a.xhtml' AS uris, 'some key' AS key_names, 'http://www.w3.org/2001/04/xmlenc#aes128-ctr' AS algorithms, true AS text_or_css FROM pages WHERE page_id // 20 % 2 = 0")
def encryption_listed(spark, sf_dir):
    """What encryption.xml lists of every second book; nothing is decrypted."""
    found = epub.encryption(_listed(spark, sf_dir))
    return found.select("book_id", *(F.array_join(c, ",").alias(c) for c in ("uris", "key_names", "algorithms")), "text_or_css")


@register("encryption_keeps_books", f"SELECT DISTINCT {_BOOK} AS book_id FROM pages WHERE page_id // 20 % 2 = 1")
def encryption_keeps_books(spark, sf_dir):
    """Books that a restoring job skips: plain names, and no encryption.xml that lists anything."""
    return rewrite.run(_listed(spark, sf_dir), rewrite.DECRYPT)["skipped"].select("book_id")


@register("broken_archives", f"SELECT {_BOOK} AS book_id, page_id // 20 % 2 = 1 AS broken, CASE WHEN page_id // 20 % 2 = 1 THEN 0 ELSE count(*) + 5 END AS n FROM pages GROUP BY page_id // 20")
def broken_archives(spark, sf_dir):
    """Archives cut short are a row with an error each; the others are read."""
    packed = Shelf(spark, "broken").put(archive.pack(members(spark, sf_dir)).select("book_id", "content"))
    odd = F.substring("book_id", 2, 9).cast("long") % 2 == 1
    found = epub.members(packed.withColumn("content", F.when(odd, F.expr("substring(content, 1, 200)")).otherwise(F.col("content"))))
    return found.groupBy("book_id").agg(F.max(F.col("error").isNotNull()).alias("broken"), F.count("path").alias("n"))


@register("archive_round_trip_whole", f"SELECT {_BOOK} AS book_id, {_PATH} AS path, md5({_WHOLE}) AS digest, CAST(strlen({_WHOLE}) AS BIGINT) AS size FROM pages")
def archive_round_trip_whole(spark, sf_dir):
    """Whole pages packed and scanned again."""
    out = scanned(spark, sf_dir, whole=True).where("error IS NULL AND ext = 'xhtml'")
    return out.select("book_id", "path", F.md5("content").alias("digest"), "size")


@register("provenance_stamp_whole", f"SELECT {_BOOK} AS book_id, {_PATH} AS path, md5({_WHOLE}) AS digest, CAST(1 AS BIGINT) AS marks FROM pages")
def provenance_stamp_whole(spark, sf_dir):
    """Whole pages in books stamped twice, packed and scanned again: one mark, every chapter as it was."""
    twice = archive.stamp(archive.stamp(scanned(spark, sf_dir, whole=True)))
    found = epub.members(Shelf(spark, "stamped").put(archive.pack(twice).select("book_id", "content")))
    marks = (F.size(F.split(F.col("content").cast("string"), 'name="generator"')) - 1).cast("long")
    marks = found.where("ext = 'opf'").select("book_id", marks.alias("marks"))
    return found.where("ext = 'xhtml'").join(marks, "book_id").select("book_id", "path", F.md5("content").alias("digest"), "marks")
