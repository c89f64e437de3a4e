"""Links of the page corpus: extraction, resolution, classification, integrity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiresmith.functions import paths, text
from quiresmith.operators import links
from quiresmith.registry import register
from quiresmith.tables import table

_LINKS = """
WITH found AS (
  SELECT page_id, url, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href,
         generate_subscripts(regexp_extract_all(html, 'href="([^"]*)"', 1), 1) - 1 AS pos
  FROM pages
), links AS (
  SELECT page_id, url, CAST(pos AS BIGINT) AS pos, href, split_part(href, '#', 1) AS path,
         regexp_extract(lower(split_part(href, '#', 1)), '\\.([a-z0-9]+)$', 1) AS ext FROM found
)"""
_TYPE = """CASE WHEN ext IN ('xhtml','html','htm','xml') THEN 'text' WHEN ext = 'css' THEN 'css'
  WHEN ext IN ('jpg','jpeg','png','gif','bmp','webp','svg') THEN 'image' WHEN ext IN ('ttf','otf','woff','woff2') THEN 'font'
  WHEN ext IN ('mp3','wav','ogg','m4a') THEN 'audio' WHEN ext IN ('mp4','webm') THEN 'video' WHEN ext = 'ncx' THEN 'toc' ELSE 'other' END"""


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.extract(table(spark, sf_dir, "pages"), "page_id", "url", "html")


@register("link_extract", _LINKS + " SELECT page_id, pos, href FROM links")
def link_extract(spark, sf_dir):
    return _links(spark, sf_dir).select("page_id", "pos", "href")


@register(
    "url_split",
    """SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path,
       regexp_extract(url, '\\?([^#]*)', 1) AS query, CASE WHEN contains(url, '#') THEN substr(url, instr(url, '#') + 1) END AS fragment FROM pages""",
)
def url_split(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id",
        F.regexp_extract(url, r"^[a-z]+://([^/?#]*)", 1).alias("host"),
        F.regexp_extract(url, r"^[a-z]+://[^/?#]*([^?#]*)", 1).alias("path"),
        F.regexp_extract(url, r"\?([^#]*)", 1).alias("query"),
        paths.fragment(url).alias("fragment"),
    )


@register("link_classify", _LINKS + f" SELECT page_id, pos, ext, {_TYPE} AS resource_type FROM links")
def link_classify(spark, sf_dir):
    ext = paths.extension(paths.path_part(F.col("href")))
    return _links(spark, sf_dir).select("page_id", "pos", ext.alias("ext"), paths.resource_type(ext).alias("resource_type"))


@register("type_counts", _LINKS + f" SELECT {_TYPE} AS resource_type, count(*) AS n_links, count(DISTINCT page_id) AS n_pages FROM links GROUP BY 1")
def type_counts(spark, sf_dir):
    kind = paths.resource_type(paths.extension(paths.path_part(F.col("href"))))
    return _links(spark, sf_dir).groupBy(kind.alias("resource_type")).agg(F.count("*").alias("n_links"), F.countDistinct("page_id").alias("n_pages"))


_KNOWN = ", known AS (SELECT lower(ltrim(path, '/')) AS low, min(ltrim(path, '/')) AS book_path FROM links GROUP BY 1 HAVING count(*) > 1)"
_STATUS = "CASE WHEN book_path IS NULL THEN 'missing' WHEN book_path = ltrim(path, '/') THEN 'exact' ELSE 'corrected' END"


@register(
    "link_case_fix",
    _LINKS + _KNOWN + f" SELECT page_id, pos, ltrim(path, '/') AS resolved, book_path, {_STATUS} AS status FROM links LEFT JOIN known ON lower(ltrim(path, '/')) = low",
)
def link_case_fix(spark, sf_dir):
    found = _links(spark, sf_dir).withColumn("resolved", F.ltrim(paths.path_part(F.col("href")), F.lit("/")))
    return links.check(found, links.known_paths(found)).select("page_id", "pos", "resolved", "book_path", "status")


@register(
    "link_integrity",
    _LINKS + _KNOWN + f""" SELECT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, {_TYPE} AS resource_type, {_STATUS} AS status,
    count(*) AS n_links, count(DISTINCT page_id) AS n_pages, count(DISTINCT path) AS n_paths
    FROM links LEFT JOIN known ON lower(ltrim(path, '/')) = low GROUP BY 1, 2, 3""",
)
def link_integrity(spark, sf_dir):
    """Extract, split, resolve, classify, join case-blind on the known paths, roll up."""
    return links.integrity(_links(spark, sf_dir))


@register(
    "link_normalise",
    """WITH v(doc, ref) AS (VALUES ('OPS/Text/a.xhtml', '../Images/b.png'), ('OPS/Text/a.xhtml', './c.css#x'), ('OPS/a.xhtml', '/root.css'),
       ('a.xhtml', '../../up.png'), ('OPS/Text/a.xhtml', 'x/../y//z.png')),
       w(doc, ref, resolved) AS (VALUES ('OPS/Text/a.xhtml', '../Images/b.png', 'OPS/Images/b.png'), ('OPS/Text/a.xhtml', './c.css#x', 'OPS/Text/c.css'),
       ('OPS/a.xhtml', '/root.css', 'root.css'), ('a.xhtml', '../../up.png', 'up.png'), ('OPS/Text/a.xhtml', 'x/../y//z.png', 'OPS/Text/y/z.png'))
       SELECT n_name, v.doc, v.ref, w.resolved FROM nation, v JOIN w ON v.doc = w.doc AND v.ref = w.ref""",
)
def link_normalise(spark, sf_dir):
    rows = [("OPS/Text/a.xhtml", "../Images/b.png"), ("OPS/Text/a.xhtml", "./c.css#x"), ("OPS/a.xhtml", "/root.css"), ("a.xhtml", "../../up.png"), ("OPS/Text/a.xhtml", "x/../y//z.png")]
    refs = F.explode(F.array(*(F.struct(F.lit(d).alias("doc"), F.lit(r).alias("ref")) for d, r in rows)))
    out = table(spark, sf_dir, "nation").select("n_name", refs.alias("v")).select("n_name", "v.*")
    return out.withColumn("resolved", paths.resolve(F.col("doc"), paths.path_part(F.col("ref"))))


@register(
    "visible_text",
    """SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
       '(?is)<script.*?</script>', ' ', 'g'), '(?is)<style.*?</style>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS visible FROM pages""",
)
def visible_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.visible_text(F.col("html")).alias("visible"))


@register("entity_protect", "SELECT page_id, CAST(length(html) AS BIGINT) AS n_chars, true AS same FROM pages")
def entity_protect(spark, sf_dir):
    kept = text.restore(text.protect(F.col("html")))
    return table(spark, sf_dir, "pages").select("page_id", F.length(kept).cast("long").alias("n_chars"), (kept == F.col("html")).alias("same"))


@register(
    "attr_sanitise",
    """SELECT page_id, replace(replace(replace(replace(replace(replace(url || '&x<y', '&amp;', chr(1)), '&lt;', chr(2)), '&', '&amp;'), '<', '&lt;'), chr(1), '&amp;'), chr(2), '&lt;') AS clean FROM pages""",
)
def attr_sanitise(spark, sf_dir):
    stray = F.concat("url", F.lit("&x<y"))
    clean = F.regexp_replace(F.regexp_replace(stray, r"&(?!(?:amp|lt);)", "&amp;"), "<", "&lt;")
    return table(spark, sf_dir, "pages").select("page_id", clean.alias("clean"))
