"""Whole jobs: a request over many books, in one plan, with a row for everything that happened."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiresmith.functions import naming
from quiresmith.operators import archive, fonts, jobs, rewrite, workspace
from quiresmith.shelf import Shelf
from quiresmith.sources import epub


@dataclass
class Request:
    task_type: str
    input_files: list[str]
    output_dir: str
    task_id: str = field(default_factory=lambda: uuid.uuid4().hex)
    options: dict[str, Any] = field(default_factory=dict)

    @classmethod
    def of(cls, payload: Mapping[str, Any]) -> Request:
        """From a mapping with snake- or camel-case keys; ValueError without a task type."""

        def pick(*names, default=None):
            return next((payload[n] for n in names if payload.get(n) is not None), default)

        if not (task := pick("task_type", "taskType")):
            raise ValueError("a request needs a task type")
        files = pick("input_files", "inputFiles", default=[])
        return cls(task, list(files), pick("output_dir", "outputDir", default="."), pick("task_id", "taskId", default=uuid.uuid4().hex), dict(pick("options", default={})))


def validate(request: Request) -> None:
    """ValueError before anything runs if the task or its options are not sound."""
    o = request.options
    if request.task_type not in jobs.TASKS:
        raise ValueError(f"unknown task {request.task_type}")
    for name in ("quality", "webp_quality"):
        q = o.get(name, 82)
        if isinstance(q, bool) or not isinstance(q, int) or not 1 <= q <= 100:
            raise ValueError(f"{name} must be a whole number from 1 to 100")
    for name in ("png_to_jpg", "png_quantize"):
        if not isinstance(o.get(name, False), bool):
            raise ValueError(f"{name} must be true or false")
    if request.task_type == "chinese_convert" and o.get("direction") not in jobs.DIRECTIONS:
        raise ValueError("direction must be s2t or t2s")
    if request.task_type == "replace_cover" and not o.get("covers"):
        raise ValueError("covers must map books to images")
    if request.task_type == "decrypt_font" and not callable(o.get("recognise")):
        raise ValueError("a recogniser must be plugged in")


def _process(spark: SparkSession, request: Request, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members out, skipped (book_id, message)) of a task."""
    task, o = request.task_type, request.options
    none = members.select("book_id", F.lit("").alias("message")).where(F.lit(False))
    policies = {"reformat_epub": rewrite.REFORMAT, "decrypt_epub": rewrite.DECRYPT, "encrypt_epub": rewrite.ENCRYPT}
    if task in policies:
        done = rewrite.run(members, policies[task])
        why = "already obfuscated" if task == "encrypt_epub" else "nothing to restore"
        return done["members"], done["skipped"].select("book_id", F.lit(why).alias("message"))
    good = members.where("error IS NULL")
    out, skipped = good, none
    modes = {"image_compress": "compress", "image_to_webp": "webp", "webp_to_img": "webp_to_image"}
    if task in modes:
        if task == "webp_to_img":
            have = good.where("ext = 'webp'").select("book_id").distinct()
            skipped = good.select("book_id").distinct().join(have, "book_id", "left_anti").withColumn("message", F.lit("no WebP image"))
        out = workspace.convert_images(good, modes[task], o.get("codec", workspace.builtin_codec), o.get("png_to_jpg", False))["members"]
    elif task == "chinese_convert":
        out = workspace.convert_text(good, o.get("table", {}))["members"]
    elif task == "replace_cover":
        rows = [(_qualified(spark, k)[0], bytes(v)) for k, v in o["covers"].items()]
        covers = spark.createDataFrame(rows, "book_id string, cover binary")
        skipped = good.select("book_id").distinct().join(covers.select("book_id"), "book_id", "left_anti").withColumn("message", F.lit("no cover given"))
        out = workspace.replace_covers(good, epub.packages(good), covers)
    elif task in ("encrypt_font", "decrypt_font"):
        have = good.where(F.col("ext").isin("ttf", "otf", "woff")).select("book_id").distinct()
        skipped = good.select("book_id").distinct().join(have, "book_id", "left_anti").withColumn("message", F.lit("no embedded font"))
        targets = _targets(spark, request, good)
        if targets is not None:
            named = targets.select("book_id").distinct()
            skipped = skipped.unionByName(have.join(named, "book_id", "left_anti").withColumn("message", F.lit("no font chosen")))
        if task == "encrypt_font":
            out = fonts.obfuscate(good, o.get("seed", 0), targets)["members"]
        else:
            found = fonts.recover(good, o["recognise"], o.get("min_confidence", 0.8), o.get("ocr_char_policy", "strict"))
            if targets is not None:
                found = found.join(fonts.target_fonts(good, targets), ["book_id", "font"], "left_semi")
            out = restore_text(good, found)
            out = fonts.remove_references(out, found.select("book_id", F.col("font").alias("path")))
    return archive.stamp(out).join(skipped.select("book_id"), "book_id", "left_anti"), skipped


def _qualified(spark: SparkSession, path: str) -> tuple[str, bool]:
    """A path as Spark names it, and whether it is there, by the file system that it lies in."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.makeQualified(p).toString(), fs.exists(p)


def _targets(spark: SparkSession, request: Request, members: DataFrame) -> DataFrame | None:
    """(book_id, family) of the fonts that a request wants changed; None if it names none at all.

    ``target_font_families_by_file`` goes by the input file, ``target_font_families`` for all others.
    """
    by_file, default = request.options.get("target_font_families_by_file") or {}, request.options.get("target_font_families") or []
    if not by_file and not default:
        return None
    own = {_qualified(spark, k)[0]: [str(f) for f in v if f] for k, v in by_file.items() if isinstance(v, list)}
    rows = [(b, f) for b, families in own.items() for f in families]
    named = spark.createDataFrame(rows, "book_id string, family string")
    others = members.select("book_id").distinct().where(~F.col("book_id").isin(sorted(own)))
    return named.unionByName(others.withColumn("family", F.explode(F.array(*map(F.lit, default)).cast("array<string>"))))


def restore_text(members: DataFrame, char_map: DataFrame) -> DataFrame:
    """Documents with the characters of each font replaced by what they show."""
    tables = char_map.groupBy("book_id", "font").agg(F.map_from_entries(F.collect_list(F.struct("src", "dst"))).alias("moves"))
    per_book = tables.groupBy("book_id").agg(F.map_from_entries(F.collect_list(F.struct("font", "moves"))).alias("tables"))
    return fonts.apply_tables(members, per_book)


def run(spark: SparkSession, request: Request) -> dict[str, Any]:
    """Run a request. Returns ``files`` (one row a book: book_id, status, message, output_path), ``events``
    and ``result``, the roll-up.

    Books are read, changed, packed and written in one distributed plan; one that fails, is no EPUB or
    was processed before is a row, and the others go on. A book is known by its path: files of one
    name are books of their own, and of their outputs in one folder the later ones are numbered.
    """
    validate(request)
    suffix = naming.CONVERTED_SUFFIX.get(request.options.get("direction")) if request.task_type == "chinese_convert" else naming.OUTPUT_SUFFIX[request.task_type]
    given = {_qualified(spark, f)[0]: f for f in reversed(request.input_files)}
    there = {q for q, f in given.items() if _qualified(spark, f)[1]}
    wanted = spark.createDataFrame([(q,) for q in sorted(given)], "book_id string")
    low = F.lower("book_id")
    done_before = wanted.where(low.endswith(f"{suffix.lower()}.epub")).select("book_id", F.lit("skipped").alias("status"), F.lit("already processed").alias("message"))
    files = sorted(q for q in there if q.lower().endswith(".epub") and not q.lower().endswith(f"{suffix.lower()}.epub"))
    absent = wanted.where(~F.col("book_id").isin(files) & ~low.endswith(f"{suffix.lower()}.epub")).select("book_id", F.lit("failed").alias("status"), F.lit("no EPUB file").alias("message"))
    rows = done_before.unionByName(absent).withColumn("output_path", F.lit(None).cast("string"))
    if files:
        members = epub.members(epub.books(spark, files))
        out, skipped = _process(spark, request, members)
        seen: dict[str, int] = {}
        numbers = []
        for f in files:
            name = f.rpartition("/")[2]
            seen[name] = seen.get(name, 0) + 1
            numbers.append((f, "" if seen[name] == 1 else f"_{seen[name]}"))
        number = spark.createDataFrame(numbers, "book_id string, number string")
        packed = archive.pack(out).join(number, "book_id").withColumn("name", F.concat(naming.stem(epub.file_name(F.col("book_id"))), "number", F.lit(f"{suffix}.epub"))).drop("number")
        packed = Shelf(spark, "packed").put(packed)  # read twice: archives and failures
        written = archive.write(packed, request.output_dir)
        ok = written.select("book_id", F.lit("success").alias("status"), F.lit("").alias("message"), "output_path")
        bad = members.where("error IS NOT NULL").select("book_id", F.lit("failed").alias("status"), F.col("error").alias("message")).unionByName(
            packed.where("error IS NOT NULL").select("book_id", F.lit("failed").alias("status"), F.col("error").alias("message"))
        )
        passed = skipped.select("book_id", F.lit("skipped").alias("status"), "message")
        rows = rows.unionByName(ok).unionByName(bad.unionByName(passed).withColumn("output_path", F.lit(None).cast("string")))
    # one row a book comes back: the request names the books, so this is as small as the request
    got = sorted(({**r.asDict(), "book_id": given.get(r["book_id"], r["book_id"])} for r in rows.collect()), key=lambda r: r["book_id"])
    return {"files": got, "events": events(request, got), "result": result(request, got)}


def result(request: Request, files: list[dict]) -> dict[str, Any]:
    n = {s: sum(f["status"] == s for f in files) for s in ("success", "failed", "skipped")}
    if not n["failed"]:
        final = "partial" if n["skipped"] else "success"
    else:
        final = "partial" if n["success"] + n["skipped"] else "error"
    picked = {k: [{"input_file": f["book_id"], "message": f["message"]} for f in files if f["status"] == k] for k in ("failed", "skipped")}
    return {
        "ok": not n["failed"], "status": final, "outputs": [f["output_path"] for f in files if f["status"] == "success"],
        "errors": picked["failed"], "skipped": picked["skipped"], "summary": {"total": len(files), **n}, "task_id": request.task_id,
    }


def events(request: Request, files: list[dict]) -> list[dict]:
    """Started, each file's end with the percent done, finished."""
    base = {"task_id": request.task_id, "total_files": len(files)}
    out = [{**base, "event": "task.started", "progress": 0.0}]
    for i, f in enumerate(files, 1):
        out.append({**base, "event": "task.file.finished", "current_file": f["book_id"], "current_index": i, "status": f["status"], "message": f["message"], "output_path": f["output_path"], "progress": round(100 * i / len(files), 2)})
    return [*out, {**base, "event": "task.finished", "progress": 100.0, "status": result(request, files)["status"]}]


def json_line(value: Any) -> str:
    """One ASCII line of JSON; lone surrogates become replacement characters."""

    def clean(x):
        if isinstance(x, str):
            return x.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
        if isinstance(x, Mapping):
            return {clean(k): clean(v) for k, v in x.items()}
        return [clean(v) for v in x] if isinstance(x, (list, tuple)) else x

    return json.dumps(clean(value), ensure_ascii=True)
