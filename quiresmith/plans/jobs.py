"""Job bookkeeping over the event stream's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quiresmith.operators import jobs
from quiresmith.registry import register
from quiresmith.tables import table


def _files(spark, sf_dir):
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_id") % 7 == 0, "skipped").otherwise("success")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("task_id"), F.col("event_id").alias("pos"), status.alias("status"))


_FILES = "f AS (SELECT user_id AS task_id, event_id AS pos, CASE WHEN event_type = 'error' THEN 'failed' WHEN event_id % 7 = 0 THEN 'skipped' ELSE 'success' END AS status FROM events)"


@register(
    "task_rollup",
    f"""WITH {_FILES}, c AS (SELECT task_id, count(*) AS total, count(*) FILTER (WHERE status = 'success') AS success, count(*) FILTER (WHERE status = 'failed') AS failed,
        count(*) FILTER (WHERE status = 'skipped') AS skipped FROM f GROUP BY task_id)
        SELECT *, CASE WHEN failed = 0 AND skipped = 0 THEN 'success' WHEN failed = 0 THEN 'partial' WHEN success + skipped > 0 THEN 'partial' ELSE 'error' END AS final, failed = 0 AS ok FROM c""",
)
def task_rollup(spark, sf_dir):
    return jobs.rollup(_files(spark, sf_dir))


@register(
    "task_progress",
    f"WITH {_FILES} SELECT task_id, pos, status, round_even(100.0::DOUBLE * row_number() OVER (PARTITION BY task_id ORDER BY pos) / count(*) OVER (PARTITION BY task_id), 2) AS progress FROM f",
)
def task_progress(spark, sf_dir):
    return jobs.progress(_files(spark, sf_dir))


@register(
    "last_n_events",
    "SELECT event_id, event_type AS task_type, rank FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS rank FROM events) WHERE rank <= 300",
)
def last_n_events(spark, sf_dir):
    return jobs.last_events(table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("task_type")))


@register(
    "lifetime_totals",
    f"""WITH g AS (SELECT CAST(ts AS DATE) AS day, count(*) AS total, count(*) FILTER (WHERE event_type <> 'error') AS success, count(*) FILTER (WHERE event_type = 'error') AS failed FROM events GROUP BY 1)
        SELECT day, CAST(sum(total) OVER w AS BIGINT) AS total, CAST(sum(success) OVER w AS BIGINT) AS success, CAST(sum(failed) OVER w AS BIGINT) AS failed FROM g WINDOW w AS (ORDER BY day ROWS UNBOUNDED PRECEDING)""",
)
def lifetime_totals(spark, sf_dir):
    failed = F.col("event_type") == "error"
    days = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("total"), F.count_if(~failed).alias("success"), F.count_if(failed).alias("failed"))
    return jobs.running_totals(days)


@register(
    "request_response",
    """SELECT conv_id, turn, CASE WHEN r = 'assistant' THEN t END AS reply_turn, CASE WHEN r = 'assistant' THEN n END AS reply_chars FROM (
       SELECT conv_id, turn, role, lead(turn) OVER w AS t, lead(role) OVER w AS r, lead(length(text)) OVER w AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user'""",
)
def request_response(spark, sf_dir):
    return jobs.responses(table(spark, sf_dir, "conversations"))


@register(
    "option_validation",
    """SELECT event_id, task, CASE WHEN task NOT IN ('image_compress', 'image_to_webp', 'chinese_convert', 'replace_cover') THEN 'unknown task'
       WHEN task LIKE 'image%' AND NOT (quality BETWEEN 1 AND 100) THEN 'quality must be 1 to 100' WHEN task = 'chinese_convert' AND coalesce(direction, '') NOT IN ('s2t', 't2s') THEN 'unknown direction' END AS error
       FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'image_compress' WHEN 1 THEN 'image_to_webp' WHEN 2 THEN 'chinese_convert' WHEN 3 THEN 'replace_cover' ELSE 'nothing' END AS task,
             event_id % 130 AS quality, CASE event_id % 3 WHEN 0 THEN 's2t' WHEN 1 THEN 'x2y' END AS direction FROM events)""",
)
def option_validation(spark, sf_dir):
    tasks = F.array(*map(F.lit, ("image_compress", "image_to_webp", "chinese_convert", "replace_cover", "nothing")))
    task = F.element_at(tasks, (F.col("event_id") % 5 + 1).cast("int"))
    direction = F.when(F.col("event_id") % 3 == 0, "s2t").when(F.col("event_id") % 3 == 1, "x2y")
    return table(spark, sf_dir, "events").select("event_id", task.alias("task"), jobs.option_error(task, F.col("event_id") % 130, direction).alias("error"))


@register("props_extract", "SELECT event_id, json_extract_string(props, '$.k') AS k, json_keys(props)[1] AS first_key FROM events")
def props_extract(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.get(F.json_object_keys("props"), 0).alias("first_key"))
