"""Characters: inventories, classes, substitution, recognition results."""

from __future__ import annotations

from pyspark.sql import functions as F

from quiresmith.functions import text
from quiresmith.operators import glyphs
from quiresmith.registry import register
from quiresmith.tables import table


@register(
    "char_inventory",
    """WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS ch, generate_subscripts(string_split(text, ''), 1) AS pos FROM documents),
       f AS (SELECT doc_id, ch, min(pos) AS first_pos FROM c GROUP BY ALL)
       SELECT doc_id, string_agg(ch, '' ORDER BY first_pos) AS chars FROM f GROUP BY doc_id""",
)
def char_inventory(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.distinct_chars(F.col("text")).alias("chars"))


def _class_sql() -> str:
    tests = " OR ".join(f"cp BETWEEN {a} AND {b}" for a, b in text.obfuscatable_ranges())
    return f"""WITH c AS (SELECT ch, unicode(ch) AS cp, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS ch FROM documents) GROUP BY ALL)
      SELECT ch, n, CASE WHEN {tests} THEN 'obfuscated' WHEN cp < 32 OR cp BETWEEN 127 AND 159 THEN 'control'
        WHEN cp IN (32, 160, 12288) THEN 'blank' ELSE 'passthrough' END AS class FROM c"""


@register("char_classes", _class_sql())
def char_classes(spark, sf_dir):
    """Counted first, so that each character is classified once."""
    return glyphs.counts(table(spark, sf_dir, "documents"), "text").withColumn("class", text.char_class(F.col("ch"))).select("ch", "n", "class")


@register("obfuscate_apply", "SELECT doc_id, translate(text, 'abcdefghijklmnopqrstuvwxyz', 'qwertyuiopasdfghjklzxcvbnm') AS hidden FROM documents")
def obfuscate_apply(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.translate("text", "abcdefghijklmnopqrstuvwxyz", "qwertyuiopasdfghjklzxcvbnm").alias("hidden"))


@register("obfuscate_round_trip", "SELECT doc_id, md5(text) AS digest, true AS same FROM documents")
def obfuscate_round_trip(spark, sf_dir):
    there = F.translate("text", "abcdefghijklmnopqrstuvwxyz", "qwertyuiopasdfghjklzxcvbnm")
    back = F.translate(there, "qwertyuiopasdfghjklzxcvbnm", "abcdefghijklmnopqrstuvwxyz")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(back).alias("digest"), (back == F.col("text")).alias("same"))


@register(
    "cmap_semi",
    """SELECT ch, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS ch FROM documents) WHERE ch IN (SELECT chr(CAST(i AS INTEGER)) FROM range(97, 123) t(i)) GROUP BY ch""",
)
def cmap_semi(spark, sf_dir):
    """Characters that a font's character map holds."""
    cmap = spark.range(97, 123).select(F.lit("font.ttf").alias("font"), F.col("id").cast("int").alias("codepoint"))
    used = glyphs.counts(table(spark, sf_dir, "documents"), "text").withColumns({"font": F.lit("font.ttf"), "codepoint": F.ascii("ch")})
    return glyphs.in_cmap(used, cmap).select("ch", "n")


@register(
    "ocr_status",
    """SELECT event_id, CASE WHEN event_type = 'error' THEN 'OCR_EXCEPTION' WHEN recognised = '' THEN 'OCR_EMPTY' WHEN length(recognised) > 1 THEN 'OCR_MULTI_CHAR'
       WHEN confidence < 0.8 THEN 'OCR_LOW_CONF' ELSE 'ok' END AS status,
       CASE WHEN event_type <> 'error' AND length(recognised) = 1 AND confidence >= 0.8 THEN recognised
         ELSE printf('[U+%04X %s]', cp, CASE WHEN event_type = 'error' THEN 'OCR_EXCEPTION' WHEN recognised = '' THEN 'OCR_EMPTY' WHEN length(recognised) > 1 THEN 'OCR_MULTI_CHAR' ELSE 'OCR_LOW_CONF' END) END AS shown
       FROM (SELECT event_id, event_type, 44032 + event_id % 100 AS cp, substr('abc', 1, CAST(event_id % 3 AS INTEGER)) AS recognised, (event_id % 7) / 7.0::DOUBLE + 0.2 AS confidence FROM events)""",
)
def ocr_status(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(
        "event_id", (F.col("event_type") == "error").alias("failed"), (44032 + F.col("event_id") % 100).alias("cp"),
        F.expr("substr('abc', 1, cast(event_id % 3 as int))").alias("recognised"), ((F.col("event_id") % 7) / F.lit(7.0) + 0.2).alias("confidence"),
    )
    status = glyphs.status(F.col("recognised"), F.col("confidence"), F.col("failed"))
    shown = F.when(status == "ok", F.col("recognised")).otherwise(F.format_string("[U+%04X %s]", F.col("cp"), status))
    return e.select("event_id", status.alias("status"), shown.alias("shown"))


@register(
    "ctc_decode",
    """WITH s AS (SELECT vec_id, t, list_slice(embedding, CAST(t * 8 + 1 AS BIGINT), CAST(t * 8 + 8 AS BIGINT)) AS p FROM embeddings, range(8) r(t)),
       a AS (SELECT vec_id, t, list_max(p) AS top, list_position(p, list_max(p)) - 1 AS k FROM s),
       l AS (SELECT *, lag(k) OVER (PARTITION BY vec_id ORDER BY t) AS before FROM a)
       SELECT vec_id, coalesce(string_agg(chr(CAST(96 + k AS INTEGER)), '' ORDER BY t) FILTER (WHERE k <> 0 AND (before IS NULL OR k <> before)), '') AS text,
         round(coalesce(avg(top::DOUBLE) FILTER (WHERE k <> 0 AND (before IS NULL OR k <> before)), 0.0), 6) AS score FROM l GROUP BY vec_id""",
)
def ctc_decode(spark, sf_dir):
    """Greedy decoding of an 8 x 8 score matrix: best class of each step, blanks and repeats dropped."""
    e = table(spark, sf_dir, "embeddings")
    decoded = glyphs.ctc_decode(F.col("embedding"), 8, "abcdefg")
    return e.select("vec_id", decoded.alias("d")).select("vec_id", "d.text", F.round("d.score", 6).alias("score"))


def _within_sql(ranges) -> str:
    return "(" + " OR ".join(f"cp BETWEEN {a} AND {b}" for a, b in ranges) + ")"


_HINT_SQL = "(cp BETWEEN 57344 AND 63743 OR cp BETWEEN 983040 AND 1048573 OR cp BETWEEN 1048576 AND 1114109 OR cp BETWEEN 44032 AND 55215)"
_BLANK_SQL = "cp IN (" + ", ".join(str(c) for c in range(0x3001) if chr(c).isspace()) + ")"
_CHARS_SQL = "SELECT DISTINCT ch, unicode(ch) AS cp FROM (SELECT unnest(string_split(text || '가。—', '')) AS ch FROM documents)"


def _chars(spark, sf_dir):
    """The characters of the corpus, and three that it may lack."""
    found = glyphs.counts(table(spark, sf_dir, "documents").select(F.concat("text", F.lit("가。—")).alias("text")), "text")
    return found.select("ch")


@register(
    "recognition_policy",
    f"""WITH c AS ({_CHARS_SQL}), k AS (SELECT ch, cp, {_HINT_SQL} AS hint, {_within_sql(text.obfuscatable_ranges())} AS made,
          {_BLANK_SQL} OR {_within_sql(text.private_and_control_ranges())} OR position(ch IN '{text.PASSTHROUGH}') > 0 AS never FROM c)
        SELECT ch, hint, never, NOT never AND (hint OR made) AS strict, NOT never AND (hint OR made OR cp >= 128) AS compatible FROM k""",
)
def recognition_policy(spark, sf_dir):
    """Which characters recognition reads under each policy, by name and by alias."""
    ch = F.col("ch")
    return _chars(spark, sf_dir).select("ch", text.is_hint(ch).alias("hint"), text.never_read(ch).alias("never"), text.is_candidate(ch, "unheard of").alias("strict"), text.is_candidate(ch, " External").alias("compatible"))


@register(
    "punctuation_normalised",
    f"""WITH c AS ({_CHARS_SQL}) SELECT ch, said, period, CASE WHEN {_HINT_SQL} AND (replace(said, ' ', '') IN ('.', '．', '｡') OR replace(said, ' ', '') = '0' AND period) THEN '。' ELSE replace(said, ' ', '') END AS shown
        FROM c, (VALUES ('.'), (' ． '), ('｡'), ('0'), ('a b'), ('')) AS v(said), (VALUES (true), (false)) AS w(period)""",
)
def punctuation_normalised(spark, sf_dir):
    """What recognised texts become beside each character; a handful of texts, so each character carries them all."""
    said = F.explode(F.array(*map(F.lit, (".", " ． ", "｡", "0", "a b", "")))).alias("said")
    rows = _chars(spark, sf_dir).select("ch", said).select("ch", "said", F.explode(F.array(F.lit(True), F.lit(False))).alias("period"))
    return rows.withColumn("shown", glyphs.normalise(F.col("said"), F.col("ch"), F.col("period")))


@register(
    "glyph_geometry",
    """SELECT l_orderkey, l_linenumber, (greatest(1, w) <= greatest(1.0, 0.35 * 48) OR greatest(1, h) <= greatest(1.0, 0.35 * 48)) AS small,
         w > 0 AND h > 0 AND greatest(1, w) <= 0.38 * 64 AND greatest(1, h) <= 0.46 * 48 AND greatest(1, w)::DOUBLE / greatest(1, h) BETWEEN 0.55 AND 1.6 AS period
       FROM (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INT) AS w, CAST(l_partkey % 40 AS INT) AS h FROM lineitem)""",
)
def glyph_geometry(spark, sf_dir):
    """Boxes of every size judged as small glyphs and as full stops."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("int").alias("w"), (F.col("l_partkey") % 40).cast("int").alias("h"))
    w, h = F.col("w"), F.col("h")
    return li.select("l_orderkey", "l_linenumber", glyphs.small_glyph(w, h, F.lit(48), 0.35).alias("small"), glyphs.period_like(w, h, F.lit(64), F.lit(48)).alias("period"))


@register(
    "pool_draw",
    f"""WITH c AS (SELECT DISTINCT source AS book_id, ch, unicode(ch) AS cp FROM (SELECT source, unnest(string_split(text, '')) AS ch FROM documents)),
        k AS (SELECT book_id, ch, CASE WHEN cp < 128 THEN 'ascii' WHEN cp BETWEEN 65280 AND 65519 THEN 'fullwidth' ELSE 'wide' END AS pool FROM c WHERE {_within_sql(text.obfuscatable_ranges())} AND ch NOT IN ('q', '7'))
        SELECT book_id, pool, count(*) AS n, count(*) AS targets, count(*) AS moved, count(*) AS inside, CAST(0 AS BIGINT) AS kept_drawn FROM k
        GROUP BY ALL HAVING count(*) <= CASE pool WHEN 'wide' THEN {len(text.pool("wide"))} ELSE 60 END""",
)
def pool_draw(spark, sf_dir):
    """Code points drawn for the characters of each source, with two characters that must stay as they are."""
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("book_id"), F.lit("f").alias("font"), F.explode(F.array_distinct(F.split("text", ""))).alias("ch")).where("ch <> ''").distinct()
    stay = F.col("ch").isin("q", "7")
    kept = docs.select("book_id", "font", F.explode(F.array(F.lit("q"), F.lit("7"))).alias("ch")).distinct()
    out = glyphs.draw(docs.where(~stay), kept, seed=3)
    inside = text.pool_name(F.col("dst")) == text.pool_name(F.col("src"))
    return out.groupBy("book_id", text.pool_name(F.col("src")).alias("pool")).agg(
        F.count("*").alias("n"), F.countDistinct("dst").alias("targets"), F.count_if(F.col("src") != F.col("dst")).alias("moved"),
        F.count_if(inside & (text.char_class(F.col("dst")) == "obfuscated")).alias("inside"), F.count_if(F.col("dst").isin("q", "7")).alias("kept_drawn"),
    )
