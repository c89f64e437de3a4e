"""Characters, character maps and recognition results as tables."""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quiresmith.functions import text


def counts(docs: DataFrame, text_col: str) -> DataFrame:
    """(ch, n): how often each character occurs. Characters are counted in their Arrow batches, so neither
    a row nor a shuffled record is made for each of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0x110000, np.int64)
        for b in batches:
            for text in b.column(0):
                if said := text.as_py():
                    for at in range(0, len(said), 1 << 20):
                        found, n = np.unique(np.frombuffer(said[at : at + (1 << 20)].encode("utf-32-le", "surrogatepass"), "<u4"), return_counts=True)
                        total[found] += n
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([chr(c) for c in seen], pa.string()), pa.array(total[seen])], names=["ch", "n"])

    return docs.select(F.col(text_col).cast("string")).mapInArrow(run, "ch string, n long").groupBy("ch").agg(F.sum("n").alias("n"))


def usage(pieces: DataFrame) -> DataFrame:
    """(book_id, font, chars): the distinct characters set in each font, in order of first use.

    ``pieces`` holds (book_id, font, pos, text). Each piece is reduced to its own distinct characters
    before anything is shuffled.
    """
    own = F.posexplode(F.filter(F.array_distinct(F.split("text", "")), lambda c: c != ""))
    first = pieces.select("book_id", "font", "pos", own.alias("at", "ch")).groupBy("book_id", "font", "ch").agg(F.min(F.struct("pos", "at")).alias("first"))
    lists = first.groupBy("book_id", "font").agg(F.array_sort(F.collect_list(F.struct("first", "ch"))).alias("x"))
    return lists.select("book_id", "font", F.array_join(F.transform("x", lambda c: c["ch"]), "").alias("chars"))


def in_cmap(chars: DataFrame, cmap: DataFrame) -> DataFrame:
    """Characters (font, codepoint, ...) that their font's map holds."""
    return chars.join(cmap.select("font", "codepoint").distinct(), ["font", "codepoint"], "left_semi")


def missing_in_cmap(chars: DataFrame, cmap: DataFrame) -> DataFrame:
    return chars.join(cmap.select("font", "codepoint").distinct(), ["font", "codepoint"], "left_anti")


def status(recognised: Column, confidence: Column, failed: Column, least: float = 0.8) -> Column:
    """Outcome of recognising one glyph, the first that applies."""
    clean = F.regexp_replace(F.coalesce(recognised, F.lit("")), r"\s+", "")
    return (
        F.when(failed, "OCR_EXCEPTION").when(clean == "", "OCR_EMPTY").when(F.length(clean) > 1, "OCR_MULTI_CHAR")
        .when(confidence < least, "OCR_LOW_CONF").otherwise("ok")
    )


def ctc_decode(scores: Column, classes: int, alphabet: str) -> Column:
    """struct(text, score) of a flat array of steps x classes scores; class 0 is the blank."""
    steps = F.transform(F.sequence(F.lit(0), (F.size(scores) / classes).cast("int") - 1), lambda t: F.slice(scores, t * classes + 1, F.lit(classes)))
    best = F.transform(steps, lambda p: F.struct((F.array_position(p, F.array_max(p)) - 1).cast("int").alias("k"), F.array_max(p).cast("double").alias("s")))
    kept = F.filter(best, lambda x, i: (x["k"] != 0) & F.when(i == 0, True).otherwise(x["k"] != F.get(best, i - 1)["k"]))
    chars = F.transform(kept, lambda x: F.substring(F.lit(alphabet), x["k"], F.lit(1)))
    total = F.aggregate(kept, F.lit(0.0), lambda a, x: a + x["s"])
    return F.struct(F.array_join(chars, "").alias("text"), F.when(F.size(kept) > 0, total / F.size(kept)).otherwise(F.lit(0.0)).alias("score"))


def permute(chars: DataFrame, seed: int = 0) -> DataFrame:
    """(book_id, font, src, dst): an injection of each font's obfuscated characters into its pools.

    Within (book, font, pool) the characters are ranked by a seeded hash and each takes the next one's
    place, so it is a permutation of the used code points without a fixed point (from two on).
    """
    pool = F.when(F.ascii("ch") < 0x80, F.lit("ascii")).when(F.ascii("ch").between(0xFF00, 0xFFEF), F.lit("fullwidth")).otherwise(F.lit("wide"))
    rows = chars.where(text.char_class(F.col("ch")) == "obfuscated").select("book_id", "font", "ch", pool.alias("pool")).distinct()
    w = Window.partitionBy("book_id", "font", "pool").orderBy(F.xxhash64("book_id", "font", "ch", F.lit(seed)), "ch")
    first = F.first("ch").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rows.withColumn("dst", F.coalesce(F.lead("ch").over(w), first)).select("book_id", "font", F.col("ch").alias("src"), "dst")


def draw(chars: DataFrame, kept: DataFrame | None = None, seed: int = 0) -> DataFrame:
    """(book_id, font, src, dst): each obfuscatable character of a font (book_id, font, ch) under a code
    point drawn from its pool, each once and never its own.

    ``kept`` (book_id, font, ch) are characters that stay as they are: their code points are not drawn.
    A font's characters of one pool are at most as many as the pool holds; if the pool has not enough
    left, or only the character itself, they stay as they are.
    """
    rows = chars.where(text.char_class(F.col("ch")) == "obfuscated").select("book_id", "font", "ch", text.pool_name(F.col("ch")).alias("pool")).distinct()
    lists = rows.groupBy("book_id", "font", "pool").agg(F.array_sort(F.collect_list("ch")).alias("chars"))
    if kept is not None:
        keep = kept.groupBy("book_id", "font").agg(F.collect_set("ch").alias("kept"))
        lists = lists.join(keep, ["book_id", "font"], "left")
    else:
        lists = lists.withColumn("kept", F.lit(None).cast("array<string>"))

    def targets(book, font, pool, chars, kept):
        drawn = random.Random(f"{seed}/{book}/{font}/{pool}")
        stay = set(kept or ())
        free = [c for c in map(chr, text.pool(pool)) if c not in stay]
        if len(free) < len(chars):
            return []
        picked = drawn.sample(free, len(chars))
        for i, c in enumerate(chars):  # a character that drew itself changes with the next one
            if picked[i] == c:
                if len(chars) > 1:
                    j = (i + 1) % len(chars)
                    picked[i], picked[j] = picked[j], picked[i]
                else:
                    others = [x for x in free if x != c]
                    if not others:
                        return []
                    picked[i] = drawn.choice(others)
        if any(c == p for c, p in zip(chars, picked, strict=True)):  # the last swap met its own: shift all
            order = sorted(picked)
            while any(c == p for c, p in zip(chars, order, strict=True)):
                order = order[1:] + order[:1]
                if order == sorted(picked):
                    return []
            picked = order
        return [{"src": c, "dst": p} for c, p in zip(chars, picked, strict=True)]

    made = F.udf(targets, "array<struct<src:string,dst:string>>")("book_id", "font", "pool", "chars", "kept")
    return lists.select("book_id", "font", F.explode(made).alias("x")).select("book_id", "font", "x.*")


def small_glyph(width: Column, height: Column, font_size: Column, share: float) -> Column:
    """Whether a glyph's box is small beside its font size, in either direction."""
    limit = F.greatest(F.lit(1.0), font_size * share)
    return (F.greatest(F.lit(1), width) <= limit) | (F.greatest(F.lit(1), height) <= limit)


def period_like(ink_width: Column, ink_height: Column, width: Column, height: Column) -> Column:
    """Whether the ink of a picture is a full stop's: little of it and nearly square. Null or no ink: false."""
    w, h = F.greatest(F.lit(1), ink_width), F.greatest(F.lit(1), ink_height)
    small = (w <= 0.38 * F.greatest(F.lit(1), width)) & (h <= 0.46 * F.greatest(F.lit(1), height))
    return F.coalesce(small & (w / h).between(0.55, 1.6) & (ink_width > 0) & (ink_height > 0), F.lit(False))


def normalise(recognised: Column, hint: Column, period: Column) -> Column:
    """What a glyph shows: without blanks, and full stops of any kind, also a zero with a full stop's ink,
    as the ideographic one where the character read is an obfuscation hint."""
    clean = F.regexp_replace(F.coalesce(recognised, F.lit("")), r"\s+", "")
    stop = clean.isin(*text.PERIODS) | ((clean == text.ZERO_PERIOD) & F.coalesce(period, F.lit(False)))
    return F.when(text.is_hint(hint) & stop, F.lit(text.PERIOD)).otherwise(clean)
