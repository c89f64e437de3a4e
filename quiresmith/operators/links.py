"""Link tables: extraction, the case-blind check against known paths, the integrity roll-up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiresmith.functions import paths

HREF = r'href="([^"]*)"'


def extract(docs: DataFrame, id_col: str, path_col: str, text_col: str, pattern: str = HREF) -> DataFrame:
    """(id, path, pos, href): every match of a link attribute, numbered within its document. Narrow."""
    found = F.regexp_extract_all(F.col(text_col), F.lit(pattern), F.lit(1))
    return docs.select(F.col(id_col), F.col(path_col), F.posexplode(found).alias("pos", "href")).withColumn("pos", F.col("pos").cast("long"))


def known_paths(links: DataFrame, least: int = 2) -> DataFrame:
    """(low, book_path): paths that at least ``least`` links name, one spelling each; grouped map-side."""
    return links.groupBy(F.lower("resolved").alias("low")).agg(F.min("resolved").alias("book_path"), F.count("*").alias("n")).where(F.col("n") >= least).drop("n")


def check(links: DataFrame, known: DataFrame) -> DataFrame:
    """Each link with the known path that it names, case aside, and how: exact, corrected or missing.

    A plain equi-join: small path tables are broadcast by the planner's own size check, hot paths are
    split by its skew handling.
    """
    joined = links.join(known, F.lower("resolved") == F.col("low"), "left")
    status = F.when(F.col("book_path").isNull(), "missing").when(F.col("book_path") == F.col("resolved"), "exact").otherwise("corrected")
    return joined.drop("low").withColumn("status", status)


def integrity(links: DataFrame) -> DataFrame:
    """Links per host, resource type and status."""
    links = links.withColumn("path", paths.path_part(F.col("href"))).withColumn("resolved", F.ltrim("path", F.lit("/")))
    out = check(links, known_paths(links))
    return out.groupBy(
        F.regexp_extract("url", r"^[a-z]+://([^/?#]*)", 1).alias("host"),
        paths.resource_type(paths.extension(F.col("path"))).alias("resource_type"),
        "status",
    ).agg(F.count("*").alias("n_links"), F.countDistinct("page_id").alias("n_pages"), F.countDistinct("path").alias("n_paths"))
