"""Images and covers: plans, savings, resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from quiresmith.operators import images
from quiresmith.registry import register
from quiresmith.tables import table


@register(
    "size_savings",
    """SELECT source AS book_id, count(*) AS n, count(*) FILTER (WHERE after < before) AS n_kept,
       CAST(sum(before - least(before, after)) AS BIGINT) AS saved, printf('%.2f MB', sum(before - least(before, after)) / 1048576.0::DOUBLE) AS shown
       FROM (SELECT source, n_chars * 7 AS before, n_chars * 7 - (doc_id % 5 - 1) * 100 AS after FROM documents) GROUP BY source""",
)
def size_savings(spark, sf_dir):
    before = F.col("n_chars") * 7
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("book_id"), before.alias("bytes_in"), (before - (F.col("doc_id") % 5 - 1) * 100).alias("bytes_out"))
    return images.savings(d)


_KINDS = [("JPEG", False), ("PNG", True), ("PNG", False), ("BMP", False), ("WEBP", True), ("WEBP", False), ("GIF", False)]


@register(
    "media_plan",
    """WITH k(detected_format, has_alpha) AS (VALUES ('JPEG', false), ('PNG', true), ('PNG', false), ('BMP', false), ('WEBP', true), ('WEBP', false), ('GIF', false)),
       m(mode) AS (VALUES ('compress'), ('webp'), ('webp_to_image'))
       SELECT n_name, mode, detected_format, has_alpha, CASE
         WHEN mode = 'compress' THEN CASE WHEN detected_format = 'PNG' AND NOT has_alpha THEN 'encode:JPEG' WHEN detected_format IN ('JPEG', 'PNG', 'WEBP') THEN 'encode:' || detected_format ELSE 'keep' END
         WHEN mode = 'webp' THEN CASE WHEN detected_format IN ('JPEG', 'PNG', 'BMP') THEN 'encode:WEBP' ELSE 'keep' END
         ELSE CASE WHEN detected_format <> 'WEBP' THEN 'keep' WHEN has_alpha THEN 'encode:PNG' ELSE 'encode:JPEG' END END AS action
       FROM nation, m, k""",
)
def media_plan(spark, sf_dir):
    kinds = F.explode(F.array(*(F.struct(F.lit(f).alias("detected_format"), F.lit(a).alias("has_alpha")) for f, a in _KINDS)))
    modes = F.explode(F.array(*map(F.lit, images.MODES)))
    rows = table(spark, sf_dir, "nation").select("n_name", modes.alias("mode"), F.lit(1)).select("n_name", "mode", kinds.alias("k")).select("n_name", "mode", "k.*")
    return rows.withColumn("action", images.action(F.col("mode"), F.col("detected_format"), F.col("has_alpha"), png_to_jpg=True))


@register(
    "image_sniff",
    """SELECT n_name, CASE n_nationkey % 5 WHEN 0 THEN 'JPEG' WHEN 1 THEN 'PNG' WHEN 2 THEN 'WEBP' WHEN 3 THEN 'GIF' END AS format FROM nation""",
)
def image_sniff(spark, sf_dir):
    heads = ["FFD8FFE000104A464946", "89504E470D0A1A0A0000", "524946460000000057454250", "474946383961", "00"]
    head = F.unhex(F.element_at(F.array(*map(F.lit, heads)), (F.col("n_nationkey") % 5 + 1).cast("int")))
    return table(spark, sf_dir, "nation").select("n_name", images.sniff(head).alias("format"))


@register(
    "cover_resolve",
    """WITH items(book_id, id, properties) AS (SELECT n_regionkey, 'i' || n_nationkey, CASE WHEN n_nationkey % 6 = 0 THEN 'svg cover-image' END FROM nation),
       metas(book_id, content) AS (SELECT r_regionkey, 'i' || (r_regionkey + 1) FROM region),
       p AS (SELECT book_id, min(id) AS by_property FROM items WHERE list_contains(string_split(properties, ' '), 'cover-image') GROUP BY 1),
       m AS (SELECT metas.book_id, min(id) AS by_meta FROM metas JOIN items ON items.book_id = metas.book_id AND id = content GROUP BY 1)
       SELECT b.book_id, coalesce(by_property, by_meta) AS cover_id, CASE WHEN by_property IS NOT NULL THEN 'property' WHEN by_meta IS NOT NULL THEN 'meta' ELSE 'create' END AS how
       FROM (SELECT DISTINCT book_id FROM items) b LEFT JOIN p USING (book_id) LEFT JOIN m USING (book_id)""",
)
def cover_resolve(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    items = n.select(F.col("n_regionkey").alias("book_id"), F.concat(F.lit("i"), "n_nationkey").alias("id"), F.when(F.col("n_nationkey") % 6 == 0, "svg cover-image").alias("properties"))
    metas = r.select(F.col("r_regionkey").alias("book_id"), F.concat(F.lit("i"), (F.col("r_regionkey") + 1).cast("string")).alias("content"))
    return images.covers(items, metas)
