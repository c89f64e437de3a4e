"""Job requests, progress and results as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The tasks, and the directions of text conversion.
TASKS = (
    "reformat_epub", "decrypt_epub", "encrypt_epub", "encrypt_font", "decrypt_font",
    "webp_to_img", "image_compress", "image_to_webp", "chinese_convert", "replace_cover",
)
DIRECTIONS = ("s2t", "t2s")


def rollup(files: DataFrame) -> DataFrame:
    """Per task: counts by status and the final status of the lattice.

    No failure and no skip (or no file): success. Failures with nothing else: error. Else partial.
    """
    out = files.groupBy("task_id").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("status") == "success").alias("success"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(F.col("status") == "skipped").alias("skipped"),
    )
    return out.withColumn("final", final_status(F.col("success"), F.col("failed"), F.col("skipped"))).withColumn("ok", F.col("failed") == 0)


def final_status(success: Column, failed: Column, skipped: Column) -> Column:
    return F.when((failed == 0) & (skipped == 0), "success").when(failed == 0, "partial").when(success + skipped > 0, "partial").otherwise("error")


def progress(files: DataFrame) -> DataFrame:
    """Percent done after each file of a task, two places, half to even."""
    w = Window.partitionBy("task_id")
    k = F.row_number().over(w.orderBy("pos"))
    return files.withColumn("progress", F.bround(100.0 * k / F.count("*").over(w), 2))


def last_events(events: DataFrame, n: int = 300) -> DataFrame:
    """The newest n events of each task; the planner limits each task's rows before the shuffle."""
    k = F.row_number().over(Window.partitionBy("task_type").orderBy(F.desc("event_id")))
    return events.withColumn("rank", k).where(F.col("rank") <= n)


def running_totals(days: DataFrame) -> DataFrame:
    """Lifetime totals after each day; the days are few, so one ordered window does."""
    w = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return days.select("day", *(F.sum(c).over(w).alias(c) for c in ("total", "success", "failed")))


def responses(turns: DataFrame) -> DataFrame:
    """Each request with the reply that follows it in its session (null: none)."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    after = turns.withColumns({"reply_turn": F.lead("turn").over(w), "reply_role": F.lead("role").over(w), "reply_chars": F.lead(F.length("text")).over(w)})
    answered = F.col("reply_role") == "assistant"
    return after.where("role = 'user'").select("conv_id", "turn", F.when(answered, F.col("reply_turn")).alias("reply_turn"), F.when(answered, F.col("reply_chars")).cast("long").alias("reply_chars"))


def option_error(task: Column, quality: Column, direction: Column) -> Column:
    """Why a task's options are refused; null if they are not."""
    return (
        F.when(~task.isin(*TASKS), "unknown task")
        .when(task.isin("image_compress", "image_to_webp") & ~F.coalesce(quality, F.lit(82)).between(1, 100), "quality must be 1 to 100")
        .when((task == "chinese_convert") & ~F.coalesce(direction.isin(*DIRECTIONS), F.lit(False)), "unknown direction")
    )
