"""Unique names: greedy numbering, slim variants, output names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The suffix that each task gives its output, and text conversion by its direction.
OUTPUT_SUFFIX = {
    "reformat_epub": "_reformat_epub", "decrypt_epub": "_decrypt_epub", "encrypt_epub": "_encrypt_epub", "encrypt_font": "_encrypt_font",
    "decrypt_font": "_decrypt_font", "webp_to_img": "_webp_to_img", "image_compress": "_image_compress",
    "image_to_webp": "_image_to_webp", "replace_cover": "_replace_cover",
}
CONVERTED_SUFFIX = {"s2t": "_chinese_convert_tc", "t2s": "_chinese_convert_sc"}
SLIM = r"(?i)[~_-]?slim$"


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^./]*$", "")


def suffix(name: Column) -> Column:
    return F.regexp_extract(name, r"(\.[^./]*)$", 1)


def unique_names(names: Column, separator: str = "_", first: int = 1) -> Column:
    """An ordered array of file names made unique: each takes its own name or the first free numbered one.

    Names that earlier ones were given count as taken, so a, a, a_1 gives a, a_1, a_1_1.
    """

    def place(done: Column, name: Column) -> Column:
        numbered = F.transform(
            F.sequence(F.lit(first), F.size(done) + first),
            lambda i: F.concat(stem(name), F.lit(separator), i.cast("string"), suffix(name)),
        )
        free = F.filter(numbered, lambda n: ~F.array_contains(done, n))
        return F.concat(done, F.array(F.when(~F.array_contains(done, name), name).otherwise(F.element_at(free, 1))))

    return F.aggregate(names, F.array().cast("array<string>"), place)


def is_slim(name: Column) -> Column:
    return stem(name).rlike(SLIM)


def slim_base(name: Column) -> Column:
    return F.concat(F.regexp_replace(stem(name), SLIM, ""), suffix(name))


def output_suffix(task: Column, direction: Column | None = None) -> Column:
    table = F.create_map(*(F.lit(x) for kv in OUTPUT_SUFFIX.items() for x in kv))
    plain = F.try_element_at(table, task)
    if direction is None:
        return plain
    return F.when(task == "chinese_convert", F.when(direction == "s2t", CONVERTED_SUFFIX["s2t"]).when(direction == "t2s", CONVERTED_SUFFIX["t2s"])).otherwise(plain)
