"""Manifest repair: joins of declared items, archive members and the reading order.

Tables are normalised (book_id, ...); every join carries book_id, so books never meet and a corpus is
partitioned by book.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quiresmith.functions import naming


def present(manifest: DataFrame, member: DataFrame) -> DataFrame:
    """Items whose file the archive holds, case aside."""
    keys = member.select("book_id", F.lower("path").alias("low")).distinct()
    return manifest.withColumn("low", F.lower("book_path")).join(keys, ["book_id", "low"], "left_semi").drop("low")


def undeclared(member: DataFrame, manifest: DataFrame) -> DataFrame:
    """Members that no item declares, case aside."""
    keys = manifest.select("book_id", F.lower("book_path").alias("low")).distinct()
    return member.withColumn("low", F.lower("path")).join(keys, ["book_id", "low"], "left_anti").drop("low")


def issues(manifest: DataFrame, spine: DataFrame) -> DataFrame:
    """(book_id, kind, value): spine entries without an item, text items outside the spine."""
    loose = spine.join(manifest.select("book_id", F.col("id").alias("idref")), ["book_id", "idref"], "left_anti")
    unread = manifest.where("resource_type = 'text'").join(spine.select("book_id", F.col("idref").alias("id")), ["book_id", "id"], "left_anti")
    return loose.select("book_id", F.lit("invalid_idref").alias("kind"), F.col("idref").alias("value")).unionByName(
        unread.select("book_id", F.lit("xhtml_not_in_spine").alias("kind"), F.col("book_path").alias("value"))
    )


def resolve_duplicates(manifest: DataFrame, used: DataFrame) -> DataFrame:
    """Of items with one href: all that are used; if none is, the last.

    ``used`` holds (book_id, id) of ids that the spine or the cover names.
    """
    marked = manifest.join(used.select("book_id", "id").distinct().withColumn("is_used", F.lit(True)), ["book_id", "id"], "left")
    same = Window.partitionBy("book_id", F.lower("href"))
    order = same.orderBy(F.desc("pos"))
    marked = marked.withColumn("is_used", F.coalesce("is_used", F.lit(False)))
    marked = marked.withColumn("any_used", F.max("is_used").over(same)).withColumn("rank", F.row_number().over(order))
    return marked.where(F.col("is_used") | (~F.col("any_used") & (F.col("rank") == 1))).drop("any_used", "rank")


def number_names(resources: DataFrame) -> DataFrame:
    """Resources with ``new_name`` unique within (book, type), by the greedy fold over their order."""
    key = F.struct("pos", "book_path", "name")
    lists = resources.groupBy("book_id", "resource_type").agg(F.array_sort(F.collect_list(key)).alias("items"))
    names = naming.unique_names(F.transform("items", lambda x: x["name"]))
    pairs = F.arrays_zip(F.col("items"), names.alias("new_name"))
    out = lists.select("book_id", "resource_type", F.explode(pairs).alias("x"))
    return out.select("book_id", "resource_type", F.col("x.items.pos").alias("pos"), F.col("x.items.book_path").alias("book_path"), F.col("x.new_name").alias("new_name"))


def allocate_ids(paths: DataFrame, taken: DataFrame) -> DataFrame:
    """An id for each undeclared path: its file name, behind ``x`` unless a letter starts it, numbered on a clash."""
    name = F.element_at(F.split("path", "/"), -1)
    wish = F.when(name.rlike("^[A-Za-z]"), name).otherwise(F.concat(F.lit("x"), name))
    mine = paths.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("path", wish.alias("wish")))).alias("items"))
    have = taken.groupBy("book_id").agg(F.collect_list("id").alias("have"))
    both = mine.join(have, "book_id", "left").withColumn("have", F.coalesce("have", F.array().cast("array<string>")))
    names = naming.unique_names(F.concat(F.array_distinct("have"), F.transform("items", lambda x: x["wish"])))
    fresh = F.slice(names, F.size(F.array_distinct("have")) + 1, F.size("items"))
    out = both.select("book_id", F.explode(F.arrays_zip(F.col("items"), fresh.alias("id"))).alias("x"))
    return out.select("book_id", F.col("x.items.path").alias("path"), F.col("x.id").alias("id"))


def pair_slim(images: DataFrame) -> DataFrame:
    """Slim images with the id of the image that they are the small variant of (null: none)."""
    i = images.withColumn("slim", naming.is_slim(F.col("name"))).withColumn("base", F.lower(naming.slim_base(F.col("name"))))
    base = i.where("NOT slim").groupBy("book_id", "base").agg(F.min("id").alias("base_id"))
    return i.where("slim").join(base, ["book_id", "base"], "left").select("book_id", "id", "name", "base_id")


def rename_references(refs: DataFrame, renames: DataFrame, column: str = "idref") -> DataFrame:
    """References led through a table (book_id, old, new); those that it does not name stay."""
    r = renames.select("book_id", F.col("old").alias(column), "new")
    return refs.join(r, ["book_id", column], "left").withColumn(column, F.coalesce("new", column)).drop("new")


def nearest_names(missing: DataFrame, names: DataFrame) -> DataFrame:
    """For each missing name the candidate of the same book that shares most characters.

    The ratio is 2 M / T with M the characters in common, counted with multiplicity, and T the
    characters of both; equal ratios go to the smallest candidate. Characters are joined, not names:
    candidates without a common character never meet.
    """

    def histogram(df: DataFrame, col: str) -> DataFrame:
        ch = F.explode(F.filter(F.split(col, ""), lambda c: c != "")).alias("ch")
        return df.select("book_id", col, ch).groupBy("book_id", col, "ch").agg(F.count("*").alias(f"n_{col}"))

    a, b = histogram(missing.select("book_id", "name").distinct(), "name"), histogram(names.select("book_id", "candidate").distinct(), "candidate")
    common = a.join(b, ["book_id", "ch"]).groupBy("book_id", "name", "candidate").agg(F.sum(F.least("n_name", "n_candidate")).alias("m"))
    ratio = 2.0 * F.col("m") / (F.length("name") + F.length("candidate"))
    scored = common.withColumn("ratio", ratio)
    best = Window.partitionBy("book_id", "name").orderBy(F.desc("ratio"), "candidate")
    return scored.withColumn("rank", F.row_number().over(best)).where("rank = 1").select("book_id", "name", "candidate", "ratio")
