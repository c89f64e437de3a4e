"""The style cascade on rows: precedence, layers, inheritance, variables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def precedence() -> Column:
    """Importance, layer (the other way round among important ones), specificity, scope, order."""
    layer = F.when(F.col("important"), -F.col("layer")).otherwise(F.col("layer"))
    return F.struct(F.col("important"), layer.alias("layer"), "a", "b", "c", "proximity", "ord")


def winners(matches: DataFrame, by: Sequence[str]) -> DataFrame:
    """The match of the highest precedence of each element; a grouped maximum, combined map-side."""
    best = matches.groupBy(*by).agg(F.max_by(F.struct("rule", "font"), precedence()).alias("x"))
    return best.select(*by, "x.rule", "x.font")


def resolve(matches: DataFrame, by: Sequence[str]) -> DataFrame:
    """Winners, one revert-layer step resolved: it drops matches of its importance in its layer and above."""
    top = matches.groupBy(*by).agg(F.max_by(F.struct("important", "layer", "font"), precedence()).alias("w"))
    reverting = top.where("w.font = 'revert-layer'")
    left = matches.join(reverting, list(by), "left")
    left = left.where(F.col("w").isNull() | ~((F.col("important") == F.col("w.important")) & (F.col("layer") >= F.col("w.layer"))))
    return winners(left.drop("w"), by)


def first_seen_rank(names: DataFrame) -> DataFrame:
    """(layer, layer_order): rank of each layer name by first appearance. Names are few, so one sort."""
    first = names.groupBy("layer").agg(F.min("pos").alias("pos"))
    return first.select("layer", F.dense_rank().over(Window.orderBy("pos")).cast("long").alias("layer_order"))


def inherit(nodes: DataFrame, depth: int) -> DataFrame:
    """(node, value): each node's own value or that of its nearest ancestor that has one.

    Every round joins nodes with their present pointer and doubles its reach, so log2(depth) rounds do.
    """
    now = nodes.select("node", "parent", "value")
    reach = 1
    while reach < depth:
        up = now.select(F.col("node").alias("parent"), F.col("parent").alias("far"), F.col("value").alias("theirs"))
        now = now.join(up, "parent", "left").select("node", F.when(F.col("value").isNull(), F.col("far")).alias("parent"), F.coalesce("value", "theirs").alias("value"))
        reach *= 2
    return now.select("node", "value")


def resolve_variables(variables: DataFrame, rounds: int) -> DataFrame:
    """(scope, name, value): references to other properties of the scope replaced, 2^rounds steps deep.

    What still is a reference then is a circle or names nothing: null.
    """
    now = variables
    for _ in range(rounds):
        other = now.select("scope", F.concat(F.lit("var("), "name", F.lit(")")).alias("value"), F.col("value").alias("next"))
        now = now.join(other, ["scope", "value"], "left").select("scope", "name", F.coalesce("next", "value").alias("value"))
    return now.withColumn("value", F.when(~F.col("value").startswith("var("), F.col("value")))


def without_families(families: Column, targets: Sequence[str]) -> Column:
    low = [t.lower() for t in targets]
    return F.filter(families, lambda f: ~F.lower(f).isin(low))
