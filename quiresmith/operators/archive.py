"""The archive sink: members back into archives, written whole or not at all."""

from __future__ import annotations

import io
import os
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiresmith.functions import package


def build(members: list[tuple[str, bytes]]) -> bytes:
    """An archive with ``mimetype`` first and stored, the rest deflated, without times; reads back clean."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for path, data in sorted(members, key=lambda m: m[0] != "mimetype"):
            info = zipfile.ZipInfo(path, (1980, 1, 1, 0, 0, 0))
            info.compress_type = zipfile.ZIP_STORED if path == "mimetype" else zipfile.ZIP_DEFLATED
            z.writestr(info, data)
    with zipfile.ZipFile(io.BytesIO(out.getvalue())) as z:
        if bad := z.testzip():
            raise ValueError(f"damaged member {bad}")
    return out.getvalue()


def pack(members: DataFrame) -> DataFrame:
    """(book_id, content, error): one archive for each book of (book_id, ord, path, content).

    Rows are dealt by book and sorted, and each task writes one book after the other; a book is
    bounded by the scan's limits, so no group outgrows a task.
    """
    rows = members.select("book_id", "ord", "path", "content").repartition("book_id").sortWithinPartitions("book_id", "ord", "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, held = None, []

        def done() -> pa.RecordBatch:
            try:
                data, error = build(held), None
            except Exception as e:
                data, error = None, f"{type(e).__name__}: {e}"
            return pa.RecordBatch.from_arrays([pa.array([book]), pa.array([data], pa.binary()), pa.array([error], pa.string())], names=["book_id", "content", "error"])

        for b in batches:
            for one, path, data in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if held and one != book:
                    yield done()
                    held = []
                book = one
                held.append((path, data or b""))
        if held:
            yield done()

    return rows.mapInArrow(run, "book_id string, content binary, error string")


def write(archives: DataFrame, directory: str) -> DataFrame:
    """Write (book_id, name, content) into a folder that all executors share; returns what was written.

    Each archive goes to a temporary name first and is renamed when complete, so a retried task
    replaces its own file and no reader ever sees half of one. Run the result to write.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        os.makedirs(directory, exist_ok=True)
        for b in batches:
            paths = []
            for name, data in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                path = os.path.join(directory, os.path.basename(name))
                part = f"{path}.{uuid.uuid4().hex}.part"
                with open(part, "wb") as f:
                    f.write(data)
                os.replace(part, path)
                paths.append(path)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(paths, pa.string())], names=["book_id", "output_path"])

    return archives.where("content IS NOT NULL").select("book_id", "name", "content").mapInArrow(run, "book_id string, output_path string")


def stamp(members: DataFrame) -> DataFrame:
    """Members with the provenance mark in every package document; marked ones stay as they are."""

    def mark(data):
        if data is None:  # Spark hands a function all rows, also those that its branch is not for
            return None
        text = package.decode(bytes(data))
        marked = package.stamp(text)
        return bytes(data) if marked == text else package.as_utf8(marked).encode()

    return members.withColumn("content", F.when(F.col("ext") == "opf", F.udf(mark, "binary")(F.when(F.col("ext") == "opf", F.col("content")))).otherwise(F.col("content")))
