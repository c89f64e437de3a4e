"""Image jobs as relations: sniffing, planning, savings, path remapping, covers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quiresmith.functions import naming

MODES = ("compress", "webp", "webp_to_image")


def sniff(content: Column) -> Column:
    """Format by the first bytes; null if none is known."""
    h = F.hex(F.substring(content, 1, 12))
    return (
        F.when(h.startswith("FFD8FF"), "JPEG").when(h.startswith("89504E470D0A1A0A"), "PNG").when(h.startswith("52494646") & h.endswith("57454250"), "WEBP")
        .when(h.startswith("47494638"), "GIF").when(h.startswith("424D"), "BMP")
    )


def action(mode: Column, fmt: Column, alpha: Column, png_to_jpg: bool = False) -> Column:
    """What a job does with an image: ``encode:FORMAT`` or ``keep``."""
    encode = F.concat(F.lit("encode:"), fmt)
    compress = F.when(fmt.isin("JPEG", "PNG", "WEBP"), encode).otherwise("keep")
    if png_to_jpg:
        compress = F.when((fmt == "PNG") & ~alpha, "encode:JPEG").otherwise(compress)
    webp = F.when(fmt.isin("JPEG", "PNG", "BMP"), "encode:WEBP").otherwise("keep")
    back = F.when(fmt != "WEBP", "keep").when(alpha, "encode:PNG").otherwise("encode:JPEG")
    return F.when(mode == "compress", compress).when(mode == "webp", webp).when(mode == "webp_to_image", back)


def savings(images: DataFrame) -> DataFrame:
    """Per book: images, those replaced by a strictly smaller one, bytes saved."""
    saved = F.col("bytes_in") - F.least("bytes_in", "bytes_out")
    out = images.groupBy("book_id").agg(F.count("*").alias("n"), F.count_if(F.col("bytes_out") < F.col("bytes_in")).alias("n_kept"), F.sum(saved).alias("saved"))
    return out.withColumn("shown", F.format_string("%.2f MB", F.col("saved") / 1048576.0))


def target_paths(images: DataFrame) -> DataFrame:
    """(book_id, path, target_path): paths with the new extension, numbered from 2 where taken.

    ``images`` holds (book_id, path, extension) of members, with a null extension where nothing changes.
    """
    kept = images.groupBy("book_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("extension").isNull(), F.col("path")))).alias("have"),
        F.array_sort(F.collect_list(F.when(F.col("extension").isNotNull(), F.struct("path", F.concat(naming.stem(F.col("path")), F.lit("."), "extension").alias("wish"))))).alias("items"),
    )
    names = naming.unique_names(F.concat("have", F.transform("items", lambda x: x["wish"])), "-", 2)
    new = F.slice(names, F.size("have") + 1, F.size("items"))
    out = kept.where(F.size("items") > 0).select("book_id", F.explode(F.arrays_zip(F.col("items"), new.alias("target"))).alias("x"))
    return out.select("book_id", F.col("x.items.path").alias("path"), F.col("x.target").alias("target_path"))


def covers(items: DataFrame, metas: DataFrame) -> DataFrame:
    """(book_id, cover_id, how): by the cover-image property, else by the cover meta, else to be created."""
    by_property = items.where(F.array_contains(F.split("properties", " "), "cover-image")).groupBy("book_id").agg(F.min("id").alias("by_property"))
    by_meta = metas.join(items.select("book_id", F.col("id").alias("content")), ["book_id", "content"]).groupBy("book_id").agg(F.min("content").alias("by_meta"))
    out = items.select("book_id").distinct().join(by_property, "book_id", "left").join(by_meta, "book_id", "left")
    how = F.when(F.col("by_property").isNotNull(), "property").when(F.col("by_meta").isNotNull(), "meta").otherwise("create")
    return out.select("book_id", F.coalesce("by_property", "by_meta").alias("cover_id"), how.alias("how"))
