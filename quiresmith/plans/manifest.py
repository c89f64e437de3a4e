"""Manifest and spine repair, shown on tables of the same shape."""

from __future__ import annotations

from pyspark.sql import functions as F

from quiresmith.operators import manifest as op
from quiresmith.registry import register
from quiresmith.tables import table


def _documents(spark, sf_dir):
    """Documents as archive members: a book for each source."""
    path = F.concat(F.lit("Text/"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 2 == 0, ".XHTML").otherwise(".xhtml"))
    return table(spark, sf_dir, "documents").select(F.col("source").alias("book_id"), path.alias("path"), "doc_id")


def _labels(spark, sf_dir):
    """Labelled documents as declared items."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    path = F.concat(F.lit("text/"), F.col("doc_id").cast("string"), F.lit(".xhtml"))
    return table(spark, sf_dir, "labels").join(d, "doc_id").select(F.col("source").alias("book_id"), path.alias("book_path"), "doc_id", "quality")


@register("manifest_semi", "SELECT source AS book_id, 'text/' || doc_id || '.xhtml' AS book_path FROM labels JOIN documents USING (doc_id)")
def manifest_semi(spark, sf_dir):
    return op.present(_labels(spark, sf_dir), _documents(spark, sf_dir)).select("book_id", "book_path")


@register(
    "manifest_anti",
    """SELECT source AS book_id, 'Text/' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.XHTML' ELSE '.xhtml' END AS path
       FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = documents.doc_id)""",
)
def manifest_anti(spark, sf_dir):
    return op.undeclared(_documents(spark, sf_dir), _labels(spark, sf_dir)).select("book_id", "path")


@register(
    "spine_issues",
    """SELECT 'o' || (l_orderkey % 10) AS book_id, 'invalid_idref' AS kind, CAST(l_partkey AS VARCHAR) AS value FROM lineitem
         WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey % 10 = l_orderkey % 10 AND o_custkey = l_partkey)
       UNION ALL
       SELECT 'o' || (o_orderkey % 10), 'xhtml_not_in_spine', 'p' || o_orderkey FROM orders
         WHERE o_orderstatus = 'O' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey % 10 = o_orderkey % 10 AND l_partkey = o_custkey)""",
)
def spine_issues(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    items = o.select(
        F.concat(F.lit("o"), (F.col("o_orderkey") % 10).cast("string")).alias("book_id"), F.col("o_custkey").cast("string").alias("id"),
        F.concat(F.lit("p"), F.col("o_orderkey").cast("string")).alias("book_path"), F.when(F.col("o_orderstatus") == "O", "text").otherwise("other").alias("resource_type"),
    )
    li = table(spark, sf_dir, "lineitem")
    spine = li.select(F.concat(F.lit("o"), (F.col("l_orderkey") % 10).cast("string")).alias("book_id"), F.col("l_partkey").cast("string").alias("idref"))
    return op.issues(items, spine)


@register(
    "duplicate_resolution",
    """WITH m AS (SELECT source AS book_id, doc_id, CAST(doc_id AS VARCHAR) AS id, md5(text) AS href FROM documents),
       u AS (SELECT m.*, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = m.doc_id) AS is_used FROM m),
       r AS (SELECT *, bool_or(is_used) OVER (PARTITION BY book_id, href) AS any_used, row_number() OVER (PARTITION BY book_id, href ORDER BY doc_id DESC) AS rank FROM u)
       SELECT book_id, id, href, is_used FROM r WHERE is_used OR (NOT any_used AND rank = 1)""",
)
def duplicate_resolution(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    items = d.select(F.col("source").alias("book_id"), F.col("doc_id").cast("string").alias("id"), F.md5("text").alias("href"), F.col("doc_id").alias("pos"))
    used = _labels(spark, sf_dir).select("book_id", F.col("doc_id").cast("string").alias("id"))
    return op.resolve_duplicates(items, used).select("book_id", "id", "href", "is_used")


@register(
    "id_rename",
    """SELECT 'all' AS book_id, n_name, coalesce(CASE WHEN r_regionkey < 3 THEN 'R~' || r_name END, CAST(n_regionkey AS VARCHAR)) AS idref
       FROM nation LEFT JOIN region ON n_regionkey = r_regionkey""",
)
def id_rename(spark, sf_dir):
    refs = table(spark, sf_dir, "nation").select(F.lit("all").alias("book_id"), "n_name", F.col("n_regionkey").cast("string").alias("idref"))
    renames = table(spark, sf_dir, "region").where("r_regionkey < 3").select(
        F.lit("all").alias("book_id"), F.col("r_regionkey").cast("string").alias("old"), F.concat(F.lit("R~"), "r_name").alias("new")
    )
    return op.rename_references(refs, renames)


@register(
    "similarity_fallback",
    """WITH a AS (SELECT DISTINCT n_regionkey AS book_id, n_name AS name FROM nation), b AS (SELECT DISTINCT r_regionkey AS book_id, r_name || '_' || r_regionkey AS candidate FROM region
         UNION SELECT n_regionkey, reverse(n_name) || 'X' FROM nation),
       ha AS (SELECT book_id, name, ch, count(*) AS n FROM (SELECT book_id, name, unnest(string_split(name, '')) AS ch FROM a) GROUP BY ALL),
       hb AS (SELECT book_id, candidate, ch, count(*) AS n FROM (SELECT book_id, candidate, unnest(string_split(candidate, '')) AS ch FROM b) GROUP BY ALL),
       s AS (SELECT ha.book_id AS book_id, name, candidate, 2.0::DOUBLE * sum(least(ha.n, hb.n)) / (length(name) + length(candidate)) AS ratio FROM ha JOIN hb ON ha.book_id = hb.book_id AND ha.ch = hb.ch GROUP BY ha.book_id, name, candidate),
       r AS (SELECT *, row_number() OVER (PARTITION BY book_id, name ORDER BY ratio DESC, candidate) AS rank FROM s)
       SELECT book_id, name, candidate, round(ratio, 6) AS ratio FROM r WHERE rank = 1""",
)
def similarity_fallback(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    names = r.select(F.col("r_regionkey").alias("book_id"), F.concat("r_name", F.lit("_"), F.col("r_regionkey").cast("string")).alias("candidate"))
    names = names.unionByName(n.select(F.col("n_regionkey").alias("book_id"), F.concat(F.reverse("n_name"), F.lit("X")).alias("candidate")))
    out = op.nearest_names(n.select(F.col("n_regionkey").alias("book_id"), F.col("n_name").alias("name")), names)
    return out.withColumn("ratio", F.round("ratio", 6))
