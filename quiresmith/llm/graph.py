"""Connected components by alternating large-star and small-star steps.

Each step is a grouped minimum (combined map-side) and a join, so no vertex's neighbours are ever
gathered in one task; the edge list is rewritten to the shared folder after each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiresmith.llm.common import Shelf


def _state(edges: DataFrame) -> tuple[int, int]:
    n, h = edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31)))).first()
    return n, h or 0


def components(edges: DataFrame, a: str, b: str, shelf: Shelf) -> DataFrame:
    """(id, root): the smallest id that each end of an edge reaches, both of type long.

    Ends without an edge to another id are absent. Null ends link with nothing.
    """
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    now = shelf.put(
        edges.where(x.isNotNull() & y.isNotNull() & (x != y))
        .select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v"))
        .distinct()
    )
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = shelf.put(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = shelf.put(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        shelf.drop(large)
        shelf.drop(now)
        now, before, state = after, state, _state(after)
        if state == before:
            break
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(roots)
