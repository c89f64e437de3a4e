"""Shared plumbing: whole-text Arrow maps and hash samples."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quiresmith.shelf import Shelf, shared_dir  # noqa: F401

#: Bytes of text handed to a text function at once; one longer text makes a call of its own.
CHUNK_CHARS = 1_500_000
#: Bytes of an Arrow batch of texts.
MAX_BATCH_BYTES = 4 << 20


def chunks(texts: pa.Array, most: int = CHUNK_CHARS) -> Iterator[tuple[int, list[str | None]]]:
    """A string column in lists of consecutive texts of at most ``most`` bytes together (one text at
    least), with the place of each. Only one list exists as Python strings at a time."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    upto = np.cumsum(size)
    at = 0
    while at < len(texts):
        before = upto[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(upto, before + most, "right")))
        yield at, texts.slice(at, end - at).to_pylist()
        at = end


def map_texts(
    df: DataFrame,
    keep: Sequence[Column],
    text: Column,
    make: Callable[[], Callable[[list[str | None]], dict[str, list]]],
    fields: Sequence[T.StructField],
) -> DataFrame:
    """Rows of ``keep`` columns plus what a Python function derives from each whole text.

    ``make`` builds the function once per task, so models are set up once; the function gets lists
    of texts, bounded by CHUNK_CHARS, and returns one list per field. Narrow: no shuffle.
    """
    bound_batches(df.sparkSession)
    kept = df.select(*keep, text.cast("string").alias("__text"))
    names = kept.columns[:-1]
    schema = T.StructType([*kept.schema.fields[:-1], *fields])
    new = to_arrow_schema(T.StructType(list(fields)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            for at, texts in chunks(batch.column(len(names))):
                got = f(texts)
                cols = [batch.column(i).slice(at, len(texts)) for i in range(len(names))]
                cols += [x if isinstance(x := got[k.name], (pa.Array, pa.ChunkedArray)) else pa.array(x, type=k.type) for k in new]
                yield pa.RecordBatch.from_arrays(cols, names=[*names, *new.names])

    return kept.mapInArrow(run, schema)


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's bound on an Arrow batch to MAX_BATCH_BYTES, unless it is lower already.

    Long texts else make batches of many times that, in the JVM and in the Python worker at once.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name, None)
    if now is None or int("".join(c for c in now if c.isdigit()) or 0) * (1 if now.rstrip("bB").isdigit() else 1 << 20) > MAX_BATCH_BYTES:
        spark.conf.set(name, str(MAX_BATCH_BYTES))


def hash01(*cols: Column, seed: int = 0) -> Column:
    """A uniform number in [0, 1) that depends on the columns alone."""
    return F.pmod(F.xxhash64(*cols, F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))


def sample_rows(df: DataFrame, most: int, *by: Column, seed: int = 0) -> DataFrame:
    """About ``most`` rows at random by the hash of ``by``; all rows where there are no more.

    The documented bound of the classifiers' training samples. Counts first, so ``df`` should be
    cheap to count; nothing else in this library drops rows this way.
    """
    n = df.count()
    return df if n <= most else df.where(hash01(*by, seed=seed) < most / n)
