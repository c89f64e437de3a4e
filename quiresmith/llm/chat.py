"""Reply trees: root-to-leaf paths by iterative self-joins, ranked, formatted as conversations."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quiresmith.llm.common import Shelf

# The template. A turn is HEAD role AFTER text END; whatever of these stands in a role or text is
# broken up by a backslash, and so is a backslash.
HEAD, AFTER, END = "### ", ": ", " </turn>\n"
_CONTROL = re.compile(r"[\\#: ]|</turn>")
_ESCAPED = {"\\": "\\\\", "#": "\\#", "</turn>": "<\\/turn>", ":": "\\:", " ": "\\ "}
_TEXT_CONTROL = re.compile(r"[\\#]|</turn>")


def escape(text: str, role: bool = False) -> str:
    return (_CONTROL if role else _TEXT_CONTROL).sub(lambda m: _ESCAPED[m[0]], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The conversation in the template, and the places (code points) of the assistant's texts."""
    out, mask, at = [], [], 0
    for role, text in turns:
        head = HEAD + escape(role, role=True) + AFTER
        body = escape(text)
        if role == "assistant":
            mask.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(out), mask


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    turns = []
    for part in formatted.split(END)[:-1]:
        head, _, body = part.partition(AFTER)
        if not head.startswith(HEAD):
            raise ValueError("not a formatted turn")
        turns.append((unescape(head[len(HEAD) :]), unescape(body)))
    return turns


def paths(nodes: DataFrame, shelf: Shelf, branches: int = 1) -> DataFrame:
    """(tree, leaf, node, up): the nodes of each chosen root-to-leaf path, ``up`` steps above its leaf.

    ``nodes`` holds (tree, node, parent, score), all but score not null save for a root's parent; a
    parent that is not in the tree makes a root. Self-joins double the steps: after round j each leaf
    knows its ancestors less than 2^j steps away, so a thread of a thousand turns takes ten rounds.
    Paths of a tree are ranked by their mean score (null counts as 0), the higher first, then by leaf;
    the first ``branches`` are chosen. Nodes on or below a circle have no root and no path.
    """
    links = nodes.where("parent IS NOT NULL").select("tree", "node", F.col("parent").alias("above"))
    known = nodes.select("tree", F.col("node").alias("above"))
    jump = shelf.put(links.join(known, ["tree", "above"], "left_semi").select("tree", "node", "above"))
    roots = nodes.join(jump.select("tree", "node"), ["tree", "node"], "left_anti").select("tree", F.col("node").alias("root"))
    inner = jump.select("tree", F.col("above").alias("node")).distinct()
    reach = shelf.put(nodes.join(inner, ["tree", "node"], "left_anti").select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up")))
    most, step = nodes.count(), 1
    while step <= most and not jump.isEmpty():
        far = reach.join(jump, ["tree", "node"]).select("tree", "leaf", F.col("above").alias("node"), (F.col("up") + step).alias("up"))
        more = shelf.put(reach.unionByName(far))
        longer = jump.alias("x").join(jump.alias("y"), (F.col("x.tree") == F.col("y.tree")) & (F.col("x.above") == F.col("y.node")))
        longer = shelf.put(longer.select("x.tree", "x.node", F.col("y.above").alias("above")))
        shelf.drop(reach)
        reach, jump, step = more, longer, 2 * step
    # a path counts if its top is a root
    tops = reach.join(roots, (reach.tree == roots.tree) & (reach.node == roots.root), "left_semi").select("tree", "leaf")
    scored = reach.join(nodes.select("tree", "node", "score"), ["tree", "node"]).groupBy("tree", "leaf").agg(F.avg(F.coalesce("score", F.lit(0.0))).alias("mean"))
    order = Window.partitionBy("tree").orderBy(F.desc("mean"), "leaf")
    chosen = scored.join(tops, ["tree", "leaf"], "left_semi").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= branches)
    return reach.join(chosen.select("tree", "leaf"), ["tree", "leaf"])


_FORMATTED = T.StructType(
    [
        T.StructField("formatted", T.StringType()),
        T.StructField("mask", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))),
    ]
)


def conversations(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """(tree, leaf, formatted, mask): one conversation for each chosen path of each reply tree.

    ``nodes`` holds (tree, node, parent, role, text, score); mask lists the places of assistant texts
    in ``formatted``, in code points. Null texts and roles count as empty. Rows without a tree or a
    node cannot be placed and are left out; a tree of which rows repeat a node is formatted with one
    of them (the least by role, text, parent). An empty table gives an empty result. Other columns
    are ignored, whatever their names.
    """
    shelf = Shelf(nodes.sparkSession, "chat")
    said = F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.col("parent").alias("parent"), F.col("score").cast("double").alias("score"))
    one = nodes.where("tree IS NOT NULL AND node IS NOT NULL").select("tree", "node", said.alias("said")).groupBy("tree", "node").agg(F.min("said").alias("said"))
    one = shelf.put(one.select("tree", "node", "said.parent", "said.score", "said.role", "said.text"))
    chosen = paths(one.select("tree", "node", "parent", "score"), shelf, branches)
    turns = chosen.join(one.select("tree", "node", "role", "text"), ["tree", "node"])
    lists = turns.groupBy("tree", "leaf").agg(F.sort_array(F.collect_list(F.struct((-F.col("up")).alias("at"), "role", "text"))).alias("turns"))
    schema = T.StructType([lists.schema["tree"], lists.schema["leaf"], *_FORMATTED.fields])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [format_turns([(t["role"], t["text"]) for t in x]) for x in b.column(2).to_pylist()]
            texts = pa.array([d[0] for d in done], pa.string())
            masks = pa.array([[{"start": s, "stop": e} for s, e in d[1]] for d in done], kind)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), texts, masks], names=schema.names)

    return lists.select("tree", "leaf", "turns").mapInArrow(run, schema)


def threads(rows: DataFrame) -> DataFrame:
    """Reply trees of flat conversations (conv_id, turn, role, text): each row replies to the one before.

    Rows of a conversation stand by turn (null first), equal turns by role and text; rows with a null
    conv_id form a conversation of their own. A tree is named by ``=`` and its conv_id, or nothing. The
    turns of one conversation come together in one task, as the text made of them must.
    """
    tree = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("tree")
    rows = rows.select(tree, "turn", "role", "text")
    at = F.row_number().over(Window.partitionBy("tree").orderBy("turn", "role", "text")).cast("long")
    rows = rows.withColumn("node", at)
    return rows.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


_DIGEST = "conv_id string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(formatted: DataFrame, kind: str = "long") -> DataFrame:
    """Per conversation of ``threads`` what can be read back from ``formatted`` and ``mask`` alone;
    ``kind`` is the type of conv_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for tree, text, mask in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                turns = hashlib.sha256()
                read = read_turns(text)
                for role, said in read:
                    turns.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                loss = "".join(unescape(text[m["start"] : m["stop"]]) for m in mask)
                rows.append((tree[1:] if tree else None, len(read), turns.hexdigest(), len(loss), hashlib.sha256(loss.encode("utf-8", "surrogatepass")).hexdigest(), len(text)))
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in _DIGEST.split(", ")])

    return formatted.select("tree", "formatted", "mask").mapInArrow(run, _DIGEST).withColumn("conv_id", F.col("conv_id").cast(kind))
