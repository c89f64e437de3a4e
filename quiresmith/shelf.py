"""Durable intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where the session names none and runs in this process (tests) is a temporary folder set; on a
    cluster that is an error, for its machines share no local folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="quiresmith-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # a file left behind harms nothing
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jvm.org.apache.hadoop.conf.Configuration()).delete(p, True)


_roots: set[str] = set()


def clear(spark: SparkSession) -> None:
    """Delete all tables that operators of this process have left on shelves; results not yet read are lost."""
    while _roots:
        _delete(spark, _roots.pop())


class Shelf:
    """Intermediate tables of one operator call, as parquet in the shared folder.

    A written table cuts the lineage and survives lost executors. ``drop`` removes one that a later
    table has replaced; those that a returned DataFrame still reads stay until ``clear`` or until the
    driver's Python ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        if not _roots:
            atexit.unregister(clear)
            atexit.register(clear, spark)
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/quiresmith/{name}-{uuid.uuid4().hex}"
        self._n = 0
        _roots.add(self.root)

    def put(self, df: DataFrame) -> DataFrame:
        self._n += 1
        path = f"{self.root}/{self._n}"
        schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema])
        df.write.parquet(path)
        out = self.spark.read.schema(schema).parquet(path)
        out._shelf_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        if path := getattr(df, "_shelf_path", None):
            _delete(self.spark, path)
