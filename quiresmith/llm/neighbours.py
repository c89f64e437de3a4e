"""Near-duplicate embeddings by NN-descent."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiresmith.llm.common import Shelf, hash01
from quiresmith.llm.graph import components

#: Neighbours that each vector keeps, neighbours up to which a saturated list is enlarged, by what factor
#: at a time, and reverse neighbours that a round looks at.
NEIGHBOURS, MOST_NEIGHBOURS, ENLARGE, REVERSE = 10, 40, 4, 6
#: Share of the pairs at the threshold that the cells of the first graph should hold together, trees of random
#: hyperplanes that it is made from at least, and vectors aimed at in a cell. Two trees at least: the cells of
#: one are closed, and rounds of neighbours-of-neighbours could never leave them.
FIRST, TREES, CELL = 0.75, 2, 48
#: Gain of an edge, on average, below which rounds have stopped improving (an edge is worth 1 and its
#: similarity).
IMPROVED = 0.01
#: Rounds at most before lists are enlarged or audited (they end when they stop improving), and forests
#: before the exact search.
ROUNDS, ATTEMPTS = 8, 3
#: Audited vectors of each kind, those without a link that one audit holds at most, and the recall at
#: which an attempt is accepted.
AUDITED, AUDITED_MOST, RECALL = 256, 8192, 0.97
#: Vectors of a tile, of a tile of the exact search, and rows that a tile is compared in.
BLOCK, EXACT_BLOCK, STEP = 4096, 8192, 1024
_SLACK = 1e-12  # sums of doubles in another order
_ANGLE = 1e-6  # angles from the arc cosine of doubles


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of rows that agree in the first ``keys`` columns, of a stream that is sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        rows = list(zip(*(b.column(i).to_pylist() for i in range(keys)), strict=True))
        start = 0
        for i in range(1, len(rows) + 1):
            if start == 0 and held and rows[0] != last:
                yield pa.Table.from_batches(held)
                held = []
            if i == len(rows) or rows[i] != rows[start]:
                part = b.slice(start, i - start)
                if held and rows[start] == last:
                    held.append(part)
                else:
                    if held:
                        yield pa.Table.from_batches(held)
                    held = [part]
                last = rows[start]
                start = i
    if held:
        yield pa.Table.from_batches(held)


_EDGES = "u long, v long, sim double"


def _edge_batch(u, v, s) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.float64())], names=["u", "v", "sim"])


def _best(ids: np.ndarray, x: np.ndarray, k: int):
    """Edges from each of a few vectors to its k most similar others."""
    s = x @ x.T
    np.fill_diagonal(s, -2.0)
    k = min(k, len(ids) - 1)
    at = np.argpartition(-s, k - 1, axis=1)[:, :k] if k < len(ids) - 1 else np.array([[j for j in range(len(ids)) if j != i] for i in range(len(ids))])
    rows = np.repeat(np.arange(len(ids)), k)
    cols = at.ravel()
    return ids[rows], ids[cols], s[rows, cols]


def _trees(planes: int, threshold: float) -> int:
    """Trees of so many planes whose cells hold a share FIRST of the pairs at the threshold.

    A random plane parts two vectors with the probability of their angle over pi, so the share that one
    tree holds falls as the planes grow with the input; more trees make up for it.
    """
    held = (1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi) ** planes
    return max(TREES, math.ceil(math.log(1 - FIRST) / math.log(1 - held))) if held < 1 else TREES


def _forest(vectors: DataFrame, n: int, threshold: float, seed: int, k: int, shelf: Shelf) -> DataFrame:
    """(u, v, sim): the best neighbours within cells of random hyperplanes, over all trees.

    Cells that got too many vectors (near copies) are dealt out by hash, so no cell grows with the
    input; rounds of neighbours-of-neighbours join what that separates.
    """
    planes = max(0, math.ceil(math.log2(max(1, n / CELL))))
    trees = _trees(planes, threshold)

    def cells(batches):
        for b in batches:
            ids, lists = b.column(0), b.column(1)
            size = np.diff(lists.offsets.to_numpy()) if len(lists) else np.zeros(0, int)
            out = []
            for d in np.unique(size):
                rows = np.flatnonzero(size == d)
                part = lists.take(pa.array(rows))
                x = _matrix(part)
                normals = np.random.default_rng([seed, int(d)]).standard_normal((trees, planes, int(d)))
                for t in range(trees):
                    bits = (x @ normals[t].T > 0) @ (1 << np.arange(planes, dtype=np.int64)) if planes else np.zeros(len(rows), np.int64)
                    cell = (int(d) * trees + t << 32) + bits
                    out.append(pa.RecordBatch.from_arrays([pa.array(cell), ids.take(pa.array(rows)), part], names=["cell", "id", "vector"]))
            yield from out

    kind = vectors.schema["vector"].dataType.simpleString()
    dealt = shelf.put(vectors.select("id", "vector").mapInArrow(cells, f"cell long, id long, vector {kind}"))
    big = dealt.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > 3 * CELL)
    parts = F.coalesce(F.ceil(F.col("n") / (2 * CELL)), F.lit(1))
    dealt = dealt.join(big, "cell", "left").withColumn("part", F.pmod(F.xxhash64("id", "cell"), parts))

    def run(batches):
        for g in _groups(batches, 2):
            if g.num_rows > 1:
                ids = g.column("id").to_numpy()
                yield _edge_batch(*_best(ids, _unit(_matrix(g.column("vector").combine_chunks())), k))

    dealt = dealt.select("cell", "part", "id", "vector").repartition("cell", "part").sortWithinPartitions("cell", "part")
    return dealt.mapInArrow(run, _EDGES)


def _top(edges: DataFrame, k: int, lists: DataFrame | None = None) -> DataFrame:
    """The best edges of each vector: k, or as many as ``lists`` (id, size) grants it."""
    from pyspark.sql.window import Window

    edges = edges.groupBy("u", "v").agg(F.max("sim").alias("sim"))
    rank = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("sim"), "v"))
    if lists is None:
        return edges.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")
    edges = edges.withColumn("rank", rank).where(F.col("rank") <= MOST_NEIGHBOURS)
    edges = edges.join(lists.withColumnRenamed("id", "u"), "u", "left").where(F.col("rank") <= F.coalesce("size", F.lit(k)))
    return edges.select("u", "v", "sim")


def _worst(graph: DataFrame, k: int, lists: DataFrame | None) -> DataFrame:
    """(id, worst, full): what a neighbour must beat to enter a list, and whether the list is full."""
    held = graph.groupBy(F.col("u").alias("id")).agg(F.min("sim").alias("worst"), F.count("*").alias("n"))
    if lists is None:
        held = held.withColumn("size", F.lit(k))
    else:
        held = held.join(lists, "id", "left").withColumn("size", F.coalesce("size", F.lit(k)))
    return held.select("id", F.when(F.col("n") >= F.col("size"), F.col("worst")).otherwise(F.lit(-2.0)).alias("worst"), (F.col("n") >= F.col("size")).alias("full"))


def _descend(vectors: DataFrame, graph: DataFrame, k: int, lists: DataFrame | None = None, centers: DataFrame | None = None) -> DataFrame:
    """Edges by which a round of neighbours-of-neighbours improves the graph, around ``centers`` (id) if given.

    Around every vector its neighbours and a bounded number of its reverse neighbours (the best of
    each of REVERSE slots) are compared with each other; pairs that beat the worst neighbour of
    either end come out.
    """
    slot = F.pmod(F.xxhash64("u"), F.lit(REVERSE))
    back = graph.groupBy(F.col("v").alias("g"), slot.alias("slot")).agg(F.max(F.struct("sim", "u")).alias("x")).select("g", F.col("x.u").alias("id"))
    around = graph.select(F.col("u").alias("g"), F.col("v").alias("id")).unionByName(back)
    if centers is not None:
        around = around.join(centers.select(F.col("id").alias("g")), "g", "left_semi")
    carried = vectors.select("id", "vector").join(_worst(graph, k, lists).select("id", "worst"), "id", "left")
    rows = around.join(carried, "id").select("g", "id", F.coalesce("worst", F.lit(-2.0)).alias("worst"), "vector")
    rows = rows.repartition("g").sortWithinPartitions("g")

    def run(batches):
        u, v, s, held = [], [], [], 0
        for g in _groups(batches, 1):
            if g.num_rows < 2:
                continue
            # a neighbour that is a reverse neighbour too stands here twice
            ids, once = np.unique(g.column("id").to_numpy(), return_index=True)
            x = _unit(_matrix(g.column("vector").combine_chunks())[once])
            sim = x @ x.T
            np.fill_diagonal(sim, -3.0)
            i, j = np.nonzero(sim > g.column("worst").to_numpy()[once, None] + _SLACK)
            u.append(ids[i])
            v.append(ids[j])
            s.append(sim[i, j])
            held += len(i)
            if held > 100_000:
                yield _edge_batch(np.concatenate(u), np.concatenate(v), np.concatenate(s))
                u, v, s, held = [], [], [], 0
        if u:
            yield _edge_batch(np.concatenate(u), np.concatenate(v), np.concatenate(s))

    return rows.mapInArrow(run, _EDGES)


def _worth(graph: DataFrame) -> float:
    """Edges and their similarities, summed: what rounds improve."""
    return graph.agg(F.sum(F.col("sim") + 1)).first()[0] or 0.0


def neighbour_graph(
    vectors: DataFrame, n: int, threshold: float, k: int, shelf: Shelf, seed: int = 0, rounds: int | None = None, before: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """((u, v, sim), (id)): NN-descent's graph, and the vectors whose lists are still saturated.

    The first graph comes from cells of random hyperplanes, joined with ``before``. Rounds of
    neighbours-of-neighbours improve it until they hardly do. A list that holds nothing but links is
    saturated: it is enlarged to ENLARGE times its size and rounds around such vectors follow, until
    none is saturated or lists hold MOST_NEIGHBOURS.
    """
    rounds = ROUNDS if rounds is None else rounds
    edges = _forest(vectors, n, threshold, seed, k, shelf)
    graph = shelf.put(_top(edges if before is None else edges.unionByName(before), k))
    lists, centers, active, size = None, None, n, k
    worth = _worth(graph) if rounds else 0.0
    while True:
        for _ in range(rounds):
            after = shelf.put(_top(graph.unionByName(_descend(vectors, graph, k, lists, centers)), k, lists))
            shelf.drop(graph)
            graph, before = after, worth
            worth = _worth(graph)
            if worth - before < IMPROVED * size * active:
                break
        full = shelf.put(_worst(graph, k, lists).where(F.col("full") & (F.col("worst") >= threshold)).select("id"))
        active = full.count()
        if size >= MOST_NEIGHBOURS or not active or not rounds:
            return graph, full
        size = min(ENLARGE * size, MOST_NEIGHBOURS)
        grown = full.withColumn("size", F.lit(size))
        lists = shelf.put(grown if lists is None else grown.unionByName(lists.join(full, "id", "left_anti")))
        centers = full


def _pairs(tiles: DataFrame, threshold: float) -> DataFrame:
    """(a, b, sure), a <= b: pairs of tiles (tile, scope, center, radius) of one scope that may hold a
    link between them; sure: all of their vectors link.

    ``radius`` is the largest angle between the center and a vector of the tile. Two vectors are no
    farther apart than their centers and both radii together, and no nearer than that between the
    centers less both radii; what this leaves open is to be compared. Centers are compared in blocks,
    each pair of blocks in a task of its own.
    """
    limit = math.acos(max(-1.0, min(1.0, threshold)))
    sizes = tiles.groupBy("scope").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / STEP)).cast("int").alias("blocks"))
    rows = tiles.join(sizes, "scope").withColumn("block", F.pmod(F.xxhash64("tile"), F.col("blocks")).cast("int"))
    mate = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = rows.select("scope", "block", mate.alias("mate"), "tile", "center", "radius")
    rows = rows.select("scope", F.least("block", "mate").alias("a"), F.greatest("block", "mate").alias("b"), "block", "tile", "radius", "center")
    rows = rows.repartition("scope", "a", "b").sortWithinPartitions("scope", "a", "b")

    def run(batches):
        for g in _groups(batches, 3):
            tile, radius, block = (g.column(c).to_numpy() for c in ("tile", "radius", "block"))
            x = _matrix(g.column("center").combine_chunks())
            a, b = g.column("a")[0].as_py(), g.column("b")[0].as_py()
            left, right = np.flatnonzero(block == a), np.flatnonzero(block == b)
            angle = np.arccos(np.clip(x[left] @ x[right].T, -1, 1))
            if a == b:
                np.fill_diagonal(angle, 0.0)
            both = radius[left][:, None] + radius[right][None, :]
            i, j = np.nonzero(angle - both <= limit + _ANGLE)
            sure = (angle + both)[i, j] <= limit - _ANGLE
            u, v = tile[left[i]], tile[right[j]]
            if a == b:
                once = u <= v
                u, v, sure = u[once], v[once], sure[once]
            for at in range(0, len(u), 100_000):
                p, q = u[at : at + 100_000], v[at : at + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(p, q)), pa.array(np.maximum(p, q)), pa.array(sure[at : at + 100_000])], names=["a", "b", "sure"])

    return rows.mapInArrow(run, "a long, b long, sure boolean")


def _tiles(vectors: DataFrame, dealt: DataFrame) -> DataFrame:
    """(tile, scope, center, radius) of the tiles that ``dealt`` (id, tile, scope) puts vectors in."""
    rows = dealt.select("id", "tile", "scope").join(vectors.select("id", "vector"), "id").select("tile", "scope", "vector")
    rows = rows.repartition("tile").sortWithinPartitions("tile")

    def run(batches):
        for g in _groups(batches, 1):
            x = _unit(_matrix(g.column("vector").combine_chunks()))
            center = x.mean(axis=0)
            size = np.sqrt(center @ center)
            center = center / size if size > 1e-9 else x[0]
            radius = float(np.arccos(np.clip(x @ center, -1, 1)).max()) if len(x) > 1 else 0.0
            yield pa.RecordBatch.from_arrays(
                [g.column("tile").combine_chunks()[:1], g.column("scope").combine_chunks()[:1], pa.array([center.tolist()], pa.list_(pa.float64())), pa.array([radius])],
                names=["tile", "scope", "center", "radius"],
            )

    return rows.mapInArrow(run, "tile long, scope long, center array<double>, radius double")


def _joined(near: np.ndarray) -> np.ndarray:
    """For each left and right vector of a bipartite table of links the first left vector it hangs with, or -1."""
    m, k = near.shape
    head = np.full(m + k, -1)
    degree = near.any(axis=1)
    for i in range(m):
        if degree[i] and head[i] < 0:
            head[i] = i
            todo = np.array([i])
            while len(todo):
                cols = np.flatnonzero(near[todo].any(axis=0) & (head[m:] < 0))
                head[m + cols] = i
                rows = np.flatnonzero(near[:, cols].any(axis=1) & (head[:m] < 0)) if len(cols) else cols
                head[rows] = i
                todo = rows
    return head


def _compare(vectors: DataFrame, dealt: DataFrame, pairs: DataFrame, threshold: float, shelf: Shelf) -> DataFrame:
    """(id, root, n, other): every pair of tiles compared vector by vector, each in a task of its own.

    ``dealt`` holds (id, root, tile), ``pairs`` holds (a, b, sure). A row tells the weight of those that
    link to a vector in one pair of tiles, and the root of one of those it hangs with there; the pairs
    of vectors themselves never leave the task. Sure pairs are counted by the weights of their tiles:
    no vector of theirs moves.
    """
    whole = dealt.join(vectors.select("id", "weight"), "id")
    tiles = shelf.put(whole.groupBy("tile").agg(F.sum("weight").alias("all"), F.min("root").alias("tile_root")))
    sure = pairs.where("sure").select("a", "b")
    sure = sure.unionByName(sure.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b")))
    sure = sure.join(tiles.select(F.col("tile").alias("b"), "all", "tile_root"), "b")
    sure = sure.groupBy(F.col("a").alias("tile")).agg(F.sum("all").alias("all"), F.max((F.col("a") == F.col("b")).cast("int")).alias("self"), F.min("tile_root").alias("other"))
    counted = whole.join(sure, "tile").select("id", "root", (F.col("all") - F.col("self") * F.col("weight")).alias("n"), "other")
    pairs = pairs.where("NOT sure").select("a", "b")
    side = pairs.select("a", "b", F.col("a").alias("tile")).unionByName(pairs.where("a <> b").select("a", "b", F.col("b").alias("tile")))
    rows = dealt.join(vectors.select("id", "vector", "weight"), "id").join(side, "tile").select("a", "b", "tile", "id", "root", "weight", "vector")
    rows = rows.repartition("a", "b").sortWithinPartitions("a", "b")

    def run(batches):
        for g in _groups(batches, 2):
            ids, roots, weight, tile = (g.column(c).to_numpy() for c in ("id", "root", "weight", "tile"))
            x = _unit(_matrix(g.column("vector").combine_chunks()))
            a, b = g.column("a")[0].as_py(), g.column("b")[0].as_py()
            left, right = np.flatnonzero(tile == a), np.flatnonzero(tile == b)
            near = np.empty((len(left), len(right)), bool)
            for at in range(0, len(left), STEP):
                near[at : at + STEP] = x[left[at : at + STEP]] @ x[right].T >= threshold
            if a == b:
                np.fill_diagonal(near, False)
            n = np.zeros(len(ids))
            for at in range(0, len(left), STEP):
                part, i = near[at : at + STEP], left[at : at + STEP]
                if part.any():
                    part = part.astype(np.float64)
                    n[i] += part @ weight[right]
                    if a != b:
                        n[right] += weight[i] @ part
            head = _joined(near)
            first, last = head[: len(left)], head[len(left) :]
            hit = np.concatenate([left, right])
            to = np.concatenate([np.where(first >= 0, left[first], left), np.where(last >= 0, left[last], right)])
            n = n[hit].astype(np.int64)
            if a == b:  # each vector stands on both sides, which ties its two heads
                n[len(left) :] = 0
            keep = (n > 0) | (roots[hit] != roots[to])
            hit, to, n = hit[keep], to[keep], n[keep]
            yield pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(roots[hit]), pa.array(n), pa.array(roots[to])], names=["id", "root", "n", "other"])

    return shelf.put(rows.mapInArrow(run, "id long, root long, n long, other long").unionByName(counted))


def _merged(roots: DataFrame, found: DataFrame, shelf: Shelf) -> DataFrame:
    """``roots`` (id, root) after the links of ``found`` have joined components."""
    up = components(found.select("root", "other").where("root <> other").distinct(), "root", "other", shelf)
    up = up.select(F.col("id").alias("root"), F.col("root").alias("top"))
    return shelf.put(roots.join(up, "root", "left").select("id", F.coalesce("top", "root").alias("root")))


def _exact(vectors: DataFrame, n: int, threshold: float, shelf: Shelf) -> tuple[DataFrame, DataFrame]:
    """(counts, roots) of all vectors, each compared with every other that tiles do not rule out."""
    tile = F.xxhash64(F.size("vector"), F.pmod(F.xxhash64("id"), F.lit(max(1, math.ceil(n / EXACT_BLOCK)))))
    dealt = shelf.put(vectors.select("id", F.col("id").alias("root"), tile.alias("tile"), (-F.size("vector")).cast("long").alias("scope")))
    found = _compare(vectors, dealt, shelf.put(_pairs(_tiles(vectors, dealt), threshold)), threshold, shelf)
    counts = shelf.put(found.groupBy("id").agg(F.sum("n").alias("n")))
    linked = components(found.select("root", "other"), "root", "other", shelf)
    return counts, linked


def _audit(vectors: DataFrame, counts: DataFrame, full: DataFrame, n: int, threshold: float) -> dict:
    """Recall of links by vector, of random vectors held against all rows, each kind apart.

    The kinds are vectors of components without a saturated list, of those with one (``full``, id), and
    vectors for which no link was found.
    Of the last as many are held as it takes to tell that those which have links after all are too
    few to matter beside the vectors with links; where that is more than AUDITED_MOST, ``held`` is
    False and nothing was compared.
    """
    known = counts.where("n > 0").join(full.select("id").withColumn("full", F.lit(True)), "id", "left")
    kinds = vectors.select("id", "vector").join(known.select("id", "n", "full"), "id", "left")
    kind = F.when(F.col("n").isNull(), 0).when(F.col("full"), 2).otherwise(1)
    kinds = kinds.withColumn("kind", kind)
    many = {r.kind: r["count"] for r in kinds.groupBy("kind").count().collect()}
    alone, linked = many.get(0, 0), many.get(1, 0) + many.get(2, 0)
    # 3 / m bounds a share of which m draws show nothing (at 95 %)
    need = min(alone, max(AUDITED, math.ceil(3 * alone / max(1e-9, (1 - RECALL) * linked))) if linked else alone)
    out = {"vectors": n, "recall": 0.0, "held": need <= AUDITED_MOST, "links": 0, "of": 0}
    if not out["held"]:
        return out
    share = {0: need, 1: AUDITED, 2: AUDITED}
    rate = F.coalesce(*(F.when(F.col("kind") == k, F.lit(1.0 if m >= many.get(k, 0) else m / many[k])) for k, m in share.items()))
    picked = kinds.where(hash01(F.col("id"), seed=4) < rate).select("id", "vector", "kind", F.coalesce("n", F.lit(0)).alias("n")).collect()
    by_size: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for d in {len(r.vector) for r in picked}:
        own = [r for r in picked if len(r.vector) == d]
        by_size[d] = (np.array([r.id for r in own]), _unit(np.array([r.vector for r in own], float)))

    def run(batches):
        for b in batches:
            size = np.diff(b.column(2).offsets.to_numpy()) if b.num_rows else np.zeros(0, int)
            for d, (ids, q) in by_size.items():
                rows = np.flatnonzero(size == d)
                if not len(rows):
                    continue
                x = _unit(_matrix(b.column(2).take(pa.array(rows))))
                own, weight = b.column(0).to_numpy()[rows], b.column(1).to_numpy()[rows]
                for at in range(0, len(ids), STEP):
                    near = q[at : at + STEP] @ x.T >= threshold
                    near &= ids[at : at + STEP, None] != own[None, :]
                    there = near @ weight
                    hit = there > 0
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at : at + STEP][hit]), pa.array(there[hit])], names=["id", "n"])

    true = vectors.select("id", "weight", "vector").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("there"))
    there = {r.id: r.there for r in true.collect()}
    recall = {}
    for k in (1, 2):
        own = [min(r.n, there[r.id]) / there[r.id] for r in picked if r.kind == k and r.id in there]
        recall[k] = sum(own) / len(own) if own else 1.0
    held = [r for r in picked if r.kind == 0]
    missed = alone * sum(r.id in there for r in held) / max(1, len(held))
    recall[0] = linked / (linked + missed) if linked + missed else 1.0
    out["links"] = sum(min(r.n, there.get(r.id, 0)) for r in picked)
    out["of"] = sum(there.values())
    out["recall"] = min(recall.values())
    return out


def _rounds(vectors: DataFrame, n: int, threshold: float, k: int, shelf: Shelf, report: Callable[[dict], None] | None) -> tuple[DataFrame | None, DataFrame | None, float]:
    """(counts (id, n), roots (id, root), recall) of distinct vectors (id, vector, weight)."""
    graph = None
    for attempt in range(ATTEMPTS if n > 1 else 0):
        graph, full = neighbour_graph(vectors, n, threshold, k, shelf, attempt, before=graph)
        near = shelf.put(graph.where(F.col("sim") >= threshold))
        roots = shelf.put(components(near, "u", "v", shelf))
        # components are compared inside; those with a saturated list also with each other
        crowded = full.join(roots, "id").select("root").distinct().withColumn("crowded", F.lit(True))
        sizes = roots.groupBy("root").agg(F.count("*").alias("size")).join(crowded, "root", "left")
        tile = F.xxhash64("root", F.pmod(F.xxhash64("id"), F.greatest(F.lit(1), F.ceil(F.col("size") / BLOCK))))
        scope = F.when(F.col("crowded"), -F.col("dim")).otherwise(F.col("root"))
        dims = vectors.select("id", F.size("vector").cast("long").alias("dim"))
        dealt = shelf.put(roots.join(sizes, "root").join(dims, "id").select("id", "root", "crowded", tile.alias("tile"), scope.alias("scope")))
        pairs = shelf.put(_pairs(_tiles(vectors, dealt), threshold))
        done = _compare(vectors, dealt.select("id", "root", "tile"), pairs, threshold, shelf)
        counts = shelf.put(done.groupBy("id").agg(F.sum("n").alias("n")))
        audit = _audit(vectors, counts, dealt.where("crowded"), n, threshold)
        if report:
            report({"attempt": attempt, **audit})
        if audit["recall"] >= RECALL:
            return counts, _merged(roots, done, shelf), audit["recall"]
        if not audit["held"]:
            break
    if n < 2:
        return None, None, 1.0
    if report:
        report({"attempt": "exact", "vectors": n, "recall": 1.0})
    return *_exact(vectors, n, threshold, shelf), 1.0


def near_duplicates(
    table: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding",
    k: int = NEIGHBOURS, report: Callable[[dict], None] | None = None,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept, recall) for every row of ``table``.

    Vectors link at a cosine of at least ``threshold``, in double precision; n_links counts the other
    vectors linked directly, component_id is the smallest vec_id that links reach, kept tells whether
    that is the vector itself, recall is what the audit measured (the same in all rows).

    Equal vectors form one class and are never paired. Classes get a first neighbour graph from cells
    of random hyperplanes, which rounds of NN-descent refine; saturated lists are enlarged step by
    step, see ``neighbour_graph``. Edges of at least the threshold make components, of whatever size.
    The vectors of each are then compared tile by tile, so that n_links counts all links inside, and
    components with lists saturated to the end also with each other, save where centers and radii rule
    a link out or prove that all link. Random vectors are held against all rows, see ``_audit``: below
    a recall of RECALL another forest is added, and after ATTEMPTS, or where so few vectors have links
    that an audit cannot tell, all vectors are compared tile by tile, whose cost is the square of
    their number; a recall below RECALL is never returned. ``report`` gets the recall of each attempt.

    Vectors that are null, zero, empty, or hold null or non-finite components link with nothing, nor
    do rows with a null id (component_id null, kept false). Vectors of different lengths never link.
    Repeated rows count as copies of each other; an id that stands for several vectors ties their
    components. Other columns are ignored, whatever their names. An empty table gives an empty result.
    """
    shelf = Shelf(table.sparkSession, "neighbours")
    kind = "float" if table.schema[vector_col].dataType.simpleString() == "array<float>" else "double"
    vector = F.col(vector_col).cast(f"array<{kind}>")
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), vector.alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    usable = F.coalesce(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & finite, F.lit(False))
    rows = shelf.put(rows.withColumn("vector", F.when(usable, F.transform("vector", lambda x: x + F.lit(0.0).cast(kind)))))
    vectors = rows.where("vector IS NOT NULL").groupBy("vector").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"))
    # written before and after: the numbers must not change when a task is run again
    vectors = shelf.put(shelf.put(vectors).withColumn("id", F.monotonically_increasing_id()))
    ids = shelf.put(rows.join(vectors.select("vector", "id"), "vector", "left").select("vec_id", "id"))
    n = vectors.count()
    counts, roots, recall = _rounds(vectors, n, threshold, k, shelf, report)
    known = vectors.select("id", "least", "weight")
    if counts is not None:
        own = ids.where("id IS NOT NULL").distinct()
        first = own.groupBy("vec_id").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first <> last")
        tied = shelf.put(own.join(first.select("vec_id", "first"), "vec_id").where("id <> first").select("id", "first"))
        if not tied.isEmpty():
            both = roots.select("id", F.col("root").alias("first")).unionByName(tied)
            roots = shelf.put(components(both, "id", "first", shelf))
        known = known.join(counts, "id", "left").join(roots, "id", "left")
    else:
        known = known.withColumns({"n": F.lit(None).cast("long"), "root": F.lit(None).cast("long")})
    known = shelf.put(known.withColumn("root", F.coalesce("root", "id")))
    least = known.groupBy("root").agg(F.min("least").alias("component_id"))
    known = known.join(least, "root").select("id", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id")
    out = ids.join(known, "id", "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id"))
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"), F.lit(recall).alias("recall"),
    )
