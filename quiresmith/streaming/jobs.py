"""A streaming front end: requests and events as unbounded tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quiresmith.operators import runner

REQUEST = "task_id string, task_type string, input_files array<string>, output_dir string, options map<string,string>"
EVENT = "task_id string, event string, status string, progress double, message string, current_file string, ts timestamp"


def new_books(spark: SparkSession, directory: str) -> DataFrame:
    """Archives as they appear in a folder."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    stream = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.[eE][pP][uU][bB]").option("recursiveFileLookup", True).load(directory)
    return stream.select(F.element_at(F.split("path", "/"), -1).alias("book_id"), "path", "length", "content")


def serve(spark: SparkSession, directory: str, sink: Callable[[dict], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Run every request (JSON lines in ``directory``) and hand one response to ``sink``; errors are
    responses too, and the stream goes on."""

    def batch(df: DataFrame, _: int) -> None:
        for row in df.toLocalIterator():
            try:
                request = runner.Request.of({k: v for k, v in row.asDict(recursive=True).items() if v is not None})
                sink({"request_id": request.task_id, "ok": True, "result": runner.run(spark, request)["result"]})
            except Exception as e:
                sink({"request_id": row.task_id, "ok": False, "error": f"{type(e).__name__}: {e}"})

    stream = spark.readStream.schema(REQUEST).json(directory)
    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def counters(events: DataFrame) -> DataFrame:
    """Finished files by task and status, kept up to date (update mode)."""
    return events.where("event = 'task.file.finished'").groupBy("task_id", "status").agg(F.count("*").alias("n"))


def hourly(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Finished files per hour; hours close once the watermark has passed them (append mode)."""
    done = events.where("event = 'task.file.finished'").withWatermark("ts", late)
    return done.groupBy(F.window("ts", "1 hour").alias("w"), "status").agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), "status", "n")
