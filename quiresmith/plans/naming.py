"""Names: numbering, hashing, slim variants, outputs."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quiresmith.functions import naming, text
from quiresmith.operators import manifest as op
from quiresmith.registry import register
from quiresmith.tables import table


@register(
    "unique_basename",
    """WITH n AS (SELECT p_partkey, p_brand AS book_id, lower(p_type) || '.png' AS name FROM part),
       r AS (SELECT *, row_number() OVER (PARTITION BY book_id, name ORDER BY p_partkey) AS k FROM n)
       SELECT p_partkey, book_id, CASE WHEN k = 1 THEN name ELSE substr(name, 1, length(name) - 4) || '_' || (k - 1) || '.png' END AS new_name FROM r""",
)
def unique_basename(spark, sf_dir):
    """Numbering by rank: exact where numbered names cannot clash with given ones."""
    name = F.concat(F.lower("p_type"), F.lit(".png"))
    k = F.row_number().over(Window.partitionBy("p_brand", name).orderBy("p_partkey"))
    new = F.when(k == 1, name).otherwise(F.concat(naming.stem(name), F.lit("_"), (k - 1).cast("string"), naming.suffix(name)))
    return table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("book_id"), new.alias("new_name"))


@register(
    "unique_basename_fold",
    """SELECT n_name, pos, new_name FROM nation,
       (VALUES (0, 'a.png'), (1, 'a_1.png'), (2, 'a_1_1.png'), (3, 'a_2.png'), (4, 'b'), (5, 'b_1')) AS v(pos, new_name)""",
)
def unique_basename_fold(spark, sf_dir):
    """The greedy fold on names that do clash with numbered ones."""
    given = F.array(*(F.lit(x) for x in ("a.png", "a.png", "a_1.png", "a.png", "b", "b")))
    return table(spark, sf_dir, "nation").select("n_name", F.posexplode(naming.unique_names(given)).alias("pos", "new_name"))


@register(
    "hash_name",
    """WITH h AS (SELECT p_partkey, list_transform(string_split(md5(p_name), ''), lambda x: CASE x
         WHEN '0' THEN '0000' WHEN '1' THEN '0001' WHEN '2' THEN '0010' WHEN '3' THEN '0011' WHEN '4' THEN '0100' WHEN '5' THEN '0101'
         WHEN '6' THEN '0110' WHEN '7' THEN '0111' WHEN '8' THEN '1000' WHEN '9' THEN '1001' WHEN 'a' THEN '1010' WHEN 'b' THEN '1011'
         WHEN 'c' THEN '1100' WHEN 'd' THEN '1101' WHEN 'e' THEN '1110' ELSE '1111' END) AS b FROM part)
       SELECT p_partkey, '_' || translate(regexp_replace(array_to_string(b, ''), '^0+', ''), '10', '*:') || '.png' AS new_name FROM h""",
)
def hash_name(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("_"), text.binary_name(F.col("p_name")), F.lit(".png")).alias("new_name"))


@register(
    "slim_pairing",
    """WITH i AS (SELECT p_brand AS book_id, CAST(p_partkey AS VARCHAR) AS id, lower(p_type) AS base, p_size % 2 = 1 AS slim FROM part),
       b AS (SELECT book_id, base, min(id) AS base_id FROM i WHERE NOT slim GROUP BY ALL)
       SELECT i.book_id, i.id, i.base || '~slim.png' AS name, b.base_id FROM i LEFT JOIN b USING (book_id, base) WHERE slim""",
)
def slim_pairing(spark, sf_dir):
    name = F.concat(F.lower("p_type"), F.when(F.col("p_size") % 2 == 1, "~slim.png").otherwise(".png"))
    images = table(spark, sf_dir, "part").select(F.col("p_brand").alias("book_id"), F.col("p_partkey").cast("string").alias("id"), name.alias("name"))
    return op.pair_slim(images)


@register(
    "output_name",
    """SELECT p_partkey, task, CASE WHEN done THEN NULL ELSE 'out/' || stem || suffix || '.epub' END AS output_path, done FROM (
       SELECT p_partkey, t.task, t.suffix, lower(p_name) || CASE WHEN p_size % 3 = 0 THEN '_Encrypt_Epub' ELSE '' END AS stem,
              p_size % 3 = 0 AND t.suffix = '_encrypt_epub' AS done
       FROM part, (VALUES ('encrypt_epub', '_encrypt_epub'), ('image_compress', '_image_compress')) AS t(task, suffix))""",
)
def output_name(spark, sf_dir):
    """Output path by the stem rule; inputs that already carry the task's suffix are done."""
    tasks = F.explode(F.array(F.lit("encrypt_epub"), F.lit("image_compress")))
    file = F.concat(F.lower("p_name"), F.when(F.col("p_size") % 3 == 0, "_Encrypt_Epub").otherwise(""), F.lit(".EPUB"))
    rows = table(spark, sf_dir, "part").select("p_partkey", file.alias("file"), tasks.alias("task")).withColumn("suffix", naming.output_suffix(F.col("task")))
    done = F.lower(naming.stem(F.col("file"))).endswith(F.col("suffix"))
    path = F.when(~done, F.concat(F.lit("out/"), naming.stem(F.col("file")), "suffix", F.lit(".epub")))
    return rows.select("p_partkey", "task", path.alias("output_path"), done.alias("done"))
