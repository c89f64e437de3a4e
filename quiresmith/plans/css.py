"""The relational core of the style cascade: precedence, layers, inheritance, variables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quiresmith.operators import cascade
from quiresmith.registry import register
from quiresmith.tables import table

#: Rules over page elements: (rule, matches, important, layer, a, b, c, proximity, ord, font).
_RULES = [
    (1, "nav", False, 9, 0, 0, 1, 0, 1, "menu.ttf"), (2, "div", False, 9, 0, 0, 1, 0, 2, "box.ttf"), (3, "div", False, 9, 0, 1, 1, 0, 3, "ad.ttf"),
    (4, "article", False, 1, 0, 0, 1, 0, 4, "low.ttf"), (5, "article", False, 2, 0, 0, 1, 0, 5, "high.ttf"), (6, "h1", True, 2, 0, 0, 1, 0, 6, "late.ttf"),
    (7, "h1", True, 1, 0, 0, 1, 0, 7, "early.ttf"), (8, "p", False, 9, 0, 0, 1, -2, 8, "far.ttf"), (9, "p", False, 9, 0, 0, 1, -1, 9, "near.ttf"),
    (10, "p", False, 9, 0, 0, 1, -1, 10, "near2.ttf"), (11, "footer", False, 9, 1, 0, 0, 0, 11, "revert-layer"), (12, "footer", False, 3, 0, 0, 1, 0, 12, "foot.ttf"),
]
_VALUES = ", ".join(f"({r[0]}, '{r[1]}', {str(r[2]).lower()}, {', '.join(map(str, r[3:9]))}, '{r[9]}')" for r in _RULES)
_WITH = f"WITH rules(rule, tag, important, layer, a, b, c, proximity, ord, font) AS (VALUES {_VALUES})"


def _rules(spark):
    return spark.createDataFrame(_RULES, "rule int, tag string, important boolean, layer int, a int, b int, c int, proximity int, ord int, font string")


def _elements(spark, sf_dir):
    """Elements of every page, each tag once."""
    tags = F.array_distinct(F.regexp_extract_all("html", F.lit("<([a-z][a-z0-9]*)"), F.lit(1)))
    return table(spark, sf_dir, "pages").select("page_id", F.explode(tags).alias("tag"))


_ELEMENTS = "e AS (SELECT page_id, unnest(list_distinct(regexp_extract_all(html, '<([a-z][a-z0-9]*)', 1))) AS tag FROM pages)"
_ORDER = "important DESC, CASE WHEN important THEN -layer ELSE layer END DESC, a DESC, b DESC, c DESC, proximity DESC, ord DESC"


@register(
    "css_cascade",
    _WITH + f", {_ELEMENTS}, r AS (SELECT page_id, tag, rule, font, row_number() OVER (PARTITION BY page_id, tag ORDER BY {_ORDER}) AS k FROM e JOIN rules USING (tag)) SELECT page_id, tag, rule, font FROM r WHERE k = 1",
)
def css_cascade(spark, sf_dir):
    """The winning rule of each element: one grouped maximum over a struct key."""
    return cascade.winners(_elements(spark, sf_dir).join(_rules(spark), "tag"), ["page_id", "tag"])


@register(
    "revert_layer",
    _WITH + f""", {_ELEMENTS}, m AS (SELECT * FROM e JOIN rules USING (tag)),
    f AS (SELECT *, row_number() OVER (PARTITION BY page_id, tag ORDER BY {_ORDER}) AS k FROM m),
    w AS (SELECT page_id, tag, important AS wi, layer AS wl, font AS wf FROM f WHERE k = 1),
    s AS (SELECT m.*, w.* EXCLUDE (page_id, tag) FROM m JOIN w USING (page_id, tag) WHERE wf <> 'revert-layer' OR NOT (important = wi AND layer >= wl)),
    g AS (SELECT *, row_number() OVER (PARTITION BY page_id, tag ORDER BY {_ORDER}) AS k FROM s)
    SELECT page_id, tag, rule, font FROM g WHERE k = 1""",
)
def revert_layer(spark, sf_dir):
    """Winners after a revert-layer winner has taken its own and higher layers with it."""
    return cascade.resolve(_elements(spark, sf_dir).join(_rules(spark), "tag"), ["page_id", "tag"])


@register(
    "layer_order",
    """SELECT event_type AS layer, dense_rank() OVER (ORDER BY min(event_id)) AS layer_order FROM events GROUP BY event_type""",
)
def layer_order(spark, sf_dir):
    return cascade.first_seen_rank(table(spark, sf_dir, "events").select(F.col("event_type").alias("layer"), F.col("event_id").alias("pos")))


@register(
    "inherit_walk",
    """SELECT c_custkey, coalesce(CASE WHEN c_acctbal > 9000 THEN 'own' END, CASE WHEN n_nationkey % 4 = 0 THEN n_name END, CASE WHEN r_regionkey <> 2 THEN r_name END, 'initial') AS font
       FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
)
def inherit_walk(spark, sf_dir):
    """Nearest decided ancestor in a tree of nodes, found by doubling steps."""
    r, n, c = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    nodes = (
        r.select(F.concat(F.lit("r"), "r_regionkey").alias("node"), F.lit(None).cast("string").alias("parent"), F.when(F.col("r_regionkey") != 2, F.col("r_name")).alias("value"))
        .unionByName(n.select(F.concat(F.lit("n"), "n_nationkey").alias("node"), F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.when(F.col("n_nationkey") % 4 == 0, F.col("n_name")).alias("value")))
        .unionByName(c.select(F.concat(F.lit("c"), "c_custkey").alias("node"), F.concat(F.lit("n"), "c_nationkey").alias("parent"), F.when(F.col("c_acctbal") > 9000, "own").alias("value")))
    )
    out = cascade.inherit(nodes, 4).where(F.col("node").startswith("c"))
    return out.select(F.substring("node", 2, 20).cast("long").alias("c_custkey"), F.coalesce("value", F.lit("initial")).alias("font"))


@register(
    "var_resolution",
    """WITH RECURSIVE vars(name, value) AS (VALUES ('--a', 'var(--b)'), ('--b', 'var(--c)'), ('--c', 'Serif'), ('--x', 'var(--y)'), ('--y', 'var(--x)'), ('--z', 'var(--none)'), ('--d', 'Mono')),
       walk(start, value, depth) AS (SELECT name, value, 0 FROM vars UNION ALL
         SELECT w.start, v.value, w.depth + 1 FROM walk w JOIN vars v ON w.value = 'var(' || v.name || ')' WHERE w.depth < 8)
       SELECT n_name, v.name, (SELECT max(value) FROM walk w WHERE w.start = v.name AND NOT starts_with(w.value, 'var(')) AS value FROM nation, vars v""",
)
def var_resolution(spark, sf_dir):
    """Custom properties that name each other; circles and unknown names resolve to nothing."""
    rows = [("--a", "var(--b)"), ("--b", "var(--c)"), ("--c", "Serif"), ("--x", "var(--y)"), ("--y", "var(--x)"), ("--z", "var(--none)"), ("--d", "Mono")]
    found = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.lit(v).alias("value")) for n, v in rows)))
    scoped = table(spark, sf_dir, "nation").select(F.col("n_name").alias("scope"), found.alias("x")).select("scope", "x.*")
    return cascade.resolve_variables(scoped, 4).select(F.col("scope").alias("n_name"), "name", "value")


@register(
    "family_except",
    """SELECT n_name, array_to_string(list_filter(['Hidden', 'serif', n_name], lambda x: lower(x) NOT IN ('hidden', 'japan')), ', ') AS families FROM nation""",
)
def family_except(spark, sf_dir):
    families = F.array(F.lit("Hidden"), F.lit("serif"), F.col("n_name"))
    return table(spark, sf_dir, "nation").select("n_name", F.array_join(cascade.without_families(families, ["Hidden", "Japan"]), ", ").alias("families"))
