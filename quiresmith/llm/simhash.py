"""SimHash near-duplicates: pigeonhole blocks, a join on blocks, verified Hamming distance."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quiresmith.llm.common import Shelf, bound_batches, map_texts
from quiresmith.llm.graph import components

#: A-Z to a-z; all other bytes stay.
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Differing bits up to which fingerprints link.
DISTANCE = 2
#: Rows of one block key that are still compared in pairs.
PAIRED_BLOCK = 64
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(text: str | None, width: int = 3) -> int:
    """64-bit SimHash of the word shingles of a text, as a signed number.

    Words are runs of characters other than space and U+0009-U+000D, A-Z lower-cased. Each shingle
    counts as often as it occurs; a text of fewer words is one shingle, one without words gives 0.
    """
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    if len(words) < width:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    seen = np.fromiter((xxh64_intdigest(g, 42) for g in grams), dtype="<u8")
    octets = seen.view(np.uint8).reshape(-1, 8)
    if len(seen) < 1000:
        ones = np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    else:
        ones = np.concatenate([(np.bincount(octets[:, j], minlength=256) @ _BITS)[::-1] for j in range(8)])
    bits = np.packbits(2 * ones > len(seen), bitorder="little")
    return int(bits.view("<i8")[0])


def _fingerprints(width: int) -> Callable:
    return lambda: lambda texts: {"fp": [fingerprint(t, width) for t in texts]}


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fp long): the fingerprint of every whole text."""
    return map_texts(
        docs, [F.col(id_col).alias("doc_id")], F.col(text_col), _fingerprints(width), [T.StructField("fp", T.LongType())]
    )


def block_keys(fp: Column) -> Column:
    """Keys of which two fingerprints of at most DISTANCE differing bits share at least one.

    The 64 bits are cut into DISTANCE + 2 blocks. Differing bits spoil at most DISTANCE of them, so
    at least two whole blocks agree; a key is the number and the bits of a pair of blocks.
    """
    n = DISTANCE + 2
    cuts = [64 * i // n for i in range(n + 1)]
    blocks = [F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in itertools.pairwise(cuts)]
    pairs = list(itertools.combinations(range(n), 2))
    return F.array(*(F.xxhash64(F.lit(k), blocks[i], blocks[j]) for k, (i, j) in enumerate(pairs)))


def links(prints: DataFrame, shelf: Shelf, paired: int = PAIRED_BLOCK) -> DataFrame:
    """(a, b): edges between representatives whose closure joins all fingerprints within DISTANCE.

    ``prints`` holds distinct fingerprints (fp, rep). Blocks of at most ``paired`` fingerprints are
    joined with themselves and each pair is verified. Larger blocks, which groups of near copies
    make, go an exact linear way: two fingerprints differ in at most two bits exactly if one value
    is at most one flipped bit away from both. So each is dealt to its 65 such values, and a value
    links those that it gathered, 65 at most, to the smallest.
    """
    keyed = prints.select("fp", "rep", F.explode(block_keys(F.col("fp"))).alias("key"))
    crowded = shelf.put(keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > paired).select("key"))
    pairs = keyed.join(crowded, "key", "left_anti")
    left, right = pairs.alias("x"), pairs.alias("y")
    differ = F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp")))
    found = left.join(
        right, (F.col("x.key") == F.col("y.key")) & (F.col("x.fp") < F.col("y.fp")) & (differ <= DISTANCE)
    ).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))
    crowd = keyed.join(crowded, "key", "left_semi").select("fp", "rep").distinct()
    near = F.expr("concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i)))")
    met = crowd.select("rep", F.explode(near).alias("value"))
    hubs = met.groupBy("value").agg(F.min("rep").alias("hub"), F.max("rep").alias("last")).where("hub <> last").drop("last")
    met = met.join(hubs, "value").where("rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b"))
    return found.unionByName(met)


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, paired: int = PAIRED_BLOCK
) -> DataFrame:
    """(doc_id, fp long, component_id long) for every row of ``docs``.

    Documents whose fingerprints differ in at most DISTANCE bits link; component_id is the
    smallest doc_id that links reach, itself included. Exact copies share one fingerprint and are
    linked through it, never in pairs.

    Null text counts as empty, and all texts without words share fingerprint 0. A row with a null id
    keeps its fingerprint, links with nothing and has a null component_id. Repeated rows stay and
    share a component; an id that stands for several texts ties their components. Other columns of
    ``docs`` are ignored, whatever their names. An empty table gives an empty result.
    """
    shelf = Shelf(docs.sparkSession, "simhash")
    prints = shelf.put(fingerprints(docs, id_col, text_col, width).withColumn("doc_id", F.col("doc_id").cast("long")))
    known = prints.where("doc_id IS NOT NULL")
    distinct = shelf.put(known.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    # a representative is a doc_id, so an id of several texts ties their groups by itself if it is one
    many = known.groupBy("doc_id").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low <> high").select("doc_id")
    tied = known.join(many, "doc_id").join(distinct, "fp").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    roots = components(links(distinct, shelf, paired).unionByName(tied), "a", "b", shelf)
    by_print = distinct.join(roots, distinct.rep == roots.id, "left").select("fp", F.coalesce("root", "rep").alias("component_id"))
    out = prints.join(by_print, "fp", "left")
    return out.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


#: Blocks of a wide fingerprint, bits of a block, and 64-bit words of the whole.
WIDE_BLOCKS, BLOCK_BITS = 64, 20
WIDE_WORDS = WIDE_BLOCKS * BLOCK_BITS // 64
#: Bits of its first 128 in which two candidates may differ, and rows of a block key compared in one task.
EARLY_DISTANCE, TOGETHER = 36, 1 << 16
_TURNS = np.random.default_rng(3).integers(1, 1 << 63, WIDE_WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def wide_fingerprint(text: str | None, width: int) -> tuple[list[int], bytes]:
    """A fingerprint of WIDE_WORDS words, as signed numbers, of the distinct word shingles of a text, and
    a 128-bit hash of its words. Words and shingles are those of ``fingerprint``; without any the list is empty."""
    from xxhash import xxh3_128_digest, xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    same = xxh3_128_digest(b" ".join(words))
    if not words:
        return [], same
    grams = {b" ".join(words)} if len(words) < width else set(map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)))
    seen = np.fromiter((xxh64_intdigest(g, 42) for g in grams), np.uint64, len(grams))
    ones = np.zeros(64 * WIDE_WORDS, np.int64)
    for at in range(0, len(seen), 255):  # sums of 255 bits fit a byte
        mixed = seen[at : at + 255, None] * _TURNS
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
        ones += np.add.reduce(np.unpackbits(mixed.astype("<u8").view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(seen), bitorder="little").view("<i8").tolist(), same


def _wide(width: int) -> Callable:
    def run(texts):
        made = [wide_fingerprint(t, width) for t in texts]
        return {"wide": [m[0] for m in made], "same": [m[1] for m in made]}

    return lambda: run


def wide_keys(wide: Column) -> Column:
    """The blocks of a wide fingerprint, each with its number."""
    blocks = []
    for i in range(WIDE_BLOCKS):
        word, at = divmod(i * BLOCK_BITS, 64)
        bits = F.shiftrightunsigned(F.get(wide, F.lit(word)), at)
        if at + BLOCK_BITS > 64:
            bits = bits.bitwiseOR(F.shiftleft(F.get(wide, F.lit(word + 1)), 64 - at))
        blocks.append(bits.bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)) + F.lit(i << BLOCK_BITS))
    return F.array(*blocks)


def wide_distance(similarity: float) -> float:
    """Bits that wide fingerprints differ in, on average, at a similarity (Jaccard) of the shingles."""
    return 64 * WIDE_WORDS * math.acos(2 * similarity / (1 + similarity)) / math.pi


def _leaders(rows: DataFrame) -> DataFrame:
    """(a, b, key) of rows (key, part, id, x, y): within each key and part every leader's near ones, and
    with b null the leaders of keys that are dealt to parts (part not negative). The first row is a leader, and so is each that no leader before is near to.
    A group of near copies gives a row each, not all pairs."""
    rows = rows.select("key", "part", "id", "x", "y").repartition("key", "part").sortWithinPartitions("key", "part", "id")

    def run(batches):
        a, b, k = [], [], []

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else [], pa.int64()) for c in (a, b, k)], names=["a", "b", "key"])
            b_null = pc.if_else(pc.less(out.column(1), 0), pa.scalar(None, pa.int64()), out.column(1))
            return pa.RecordBatch.from_arrays([out.column(0), b_null, out.column(2)], names=["a", "b", "key"])

        size = 0
        for key, part, ids, x, y in _key_groups(batches):
            open_, at = np.ones(len(ids), bool), 0
            while at < len(ids):
                near = np.bitwise_count(x ^ x[at]) + np.bitwise_count(y ^ y[at]) <= EARLY_DISTANCE
                near[at] = False
                open_[at] = False
                open_ &= ~near
                hit = ids[near] if part < 0 else np.append(ids[near], -1)
                if len(hit):
                    a.append(np.full(len(hit), ids[at]))
                    b.append(hit)
                    k.append(np.full(len(hit), key))
                    size += len(hit)
                at = int(open_.argmax()) if open_.any() else len(ids)
            if size > 100_000:
                yield flush()
                a, b, k, size = [], [], [], 0
        if size:
            yield flush()

    return rows.mapInArrow(run, "a long, b long, key long")


def _key_groups(batches):
    """(key, part, ids, x, y) of a stream sorted by key and part; rows alone in an undealt key are passed over."""
    held: list[tuple] = []
    last = None
    for batch in batches:
        columns = [batch.column(i).to_numpy() for i in range(5)]
        n = batch.num_rows
        if not n:
            continue
        key, part = columns[0], columns[1]
        cuts = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]) | (part[1:] != part[:-1])) + 1, [n]])
        look = (np.diff(cuts) > 1) | (part[cuts[:-1]] >= 0)
        look[[0, -1]] = True  # they may go on in other batches
        for g in np.flatnonzero(look):
            s, e = cuts[g], cuts[g + 1]
            now = (int(key[s]), int(part[s]))
            if held and now != last:
                if last[1] >= 0 or sum(len(h[0]) for h in held) > 1:
                    yield *last, *_joined(held)
                held = []
            last = now
            held.append([c[s:e] for c in columns[2:]])
    if held and (last[1] >= 0 or sum(len(h[0]) for h in held) > 1):
        yield *last, *_joined(held)


def _joined(held):
    ids, x, y = (np.concatenate([h[i] for h in held]) for i in range(3))
    return ids, x.view(np.uint64), y.view(np.uint64)


def similar(texts: DataFrame, shelf: Shelf, width: int = 5, least: float = 0.8) -> DataFrame:
    """(id, root) of ``texts`` (id, text), ids distinct: the smallest id that links of near copies reach;
    rows that link with none are absent.

    Two texts link if the Jaccard similarity of their word shingles is at least ``least``. Each text gets
    a fingerprint of WIDE_BLOCKS * BLOCK_BITS bits. Close fingerprints share a block (at a similarity of
    0.8 in 92 of 100 cases, at 0.85 in 98), so candidates are the rows of a block key, where each is held
    against the leaders of its key by the first 128 bits; a key of more rows than TOGETHER is dealt to
    several tasks whose leaders meet again. Candidates are verified by the Hamming distance of the
    whole fingerprints, and where that is nearer to the bound than four standard errors by the shingles
    themselves. Equal texts are one class and never meet in pairs. Texts that are no copies share a
    block key by chance, one in 2^BLOCK_BITS; corpora of many times that number want longer blocks.
    """
    made = map_texts(texts, [F.col("id")], F.col("text"), _wide(width), [T.StructField("wide", T.ArrayType(T.LongType())), T.StructField("same", T.BinaryType())])
    made = shelf.put(made)
    classes = shelf.put(made.groupBy("same").agg(F.min("id").alias("rep"), F.first("wide").alias("wide")))
    keyed = classes.where(F.size("wide") > 0).select(F.col("rep").alias("id"), F.get("wide", F.lit(0)).alias("x"), F.get("wide", F.lit(1)).alias("y"), F.explode(wide_keys(F.col("wide"))).alias("key"))
    crowded = shelf.put(keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > TOGETHER))
    part = F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / TOGETHER))
    rows = keyed.join(crowded, "key", "left").withColumn("part", F.coalesce(part, F.lit(-1)).cast("long"))
    found = shelf.put(_leaders(rows))
    edges = found.where("b IS NOT NULL").select("a", "b")
    again = found.where("b IS NULL").select("key", F.col("a").alias("id")).distinct()
    again = again.join(classes.select(F.col("rep").alias("id"), F.get("wide", F.lit(0)).alias("x"), F.get("wide", F.lit(1)).alias("y")), "id").withColumn("part", F.lit(-1).cast("long"))
    edges = edges.unionByName(_leaders(again).where("b IS NOT NULL").select("a", "b"))
    edges = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    both = edges.join(classes.select(F.col("rep").alias("a"), F.col("wide").alias("left")), "a").join(classes.select(F.col("rep").alias("b"), F.col("wide").alias("right")), "b")
    differ = F.aggregate(F.zip_with("left", "right", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, d: s + d)
    bound = wide_distance(least)
    share = bound / (64 * WIDE_WORDS)
    slack = 4 * math.sqrt(64 * WIDE_WORDS * share * (1 - share))
    both = shelf.put(both.select("a", "b", differ.alias("bits")).where(F.col("bits") <= bound + slack))
    sure = both.where(F.col("bits") < bound - slack).select("a", "b")
    roots = shelf.put(components(sure, "a", "b", shelf))
    # only what still joins components is looked at in the texts
    top = roots.withColumnRenamed("root", "top")
    doubt = both.where(F.col("bits") >= bound - slack).select("a", "b")
    doubt = doubt.join(top.select(F.col("id").alias("a"), F.col("top").alias("p")), "a", "left").join(top.select(F.col("id").alias("b"), F.col("top").alias("q")), "b", "left")
    doubt = doubt.where(F.coalesce("p", "a") != F.coalesce("q", "b")).select("a", "b")
    near = shelf.put(_verified(doubt, texts, width, least))
    same = made.join(classes.select("same", "rep"), "same").where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    return components(sure.unionByName(near).unionByName(same), "a", "b", shelf)


def _verified(pairs: DataFrame, texts: DataFrame, width: int, least: float) -> DataFrame:
    """Pairs (a, b) of ids whose texts' shingles have a Jaccard similarity of at least ``least``."""
    bound_batches(texts.sparkSession)
    rows = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("p")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("q")), "b").select("a", "b", "p", "q")

    def shingles(text):
        words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
        return {tuple(words)} if len(words) < width else set(zip(*(words[i:] for i in range(width)), strict=False))

    def run(batches):
        for b in batches:
            keep = []
            for p, q in zip(b.column(2), b.column(3), strict=True):
                x, y = shingles(p.as_py()), shingles(q.as_py())
                common = len(x & y)
                keep.append(common >= least * (len(x) + len(y) - common))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(mask), b.column(1).filter(mask)], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def distinct_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, least: float = 0.8) -> DataFrame:
    """``docs`` with one row of each group of near copies, see ``similar``: the one with the smallest id
    (null last), of several rows with that id the first as they were read.

    A null text counts as empty; texts without words are copies of each other. Rows with null ids and
    repeated rows, with the same text or another, are treated as documents of their own. All columns
    are kept, whatever their names. An empty table gives an empty result.
    """
    shelf = Shelf(docs.sparkSession, "distinct")
    names = docs.columns
    hidden = docs.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(names)))
    # written with its numbers, which must not change when a task is run again
    rows = shelf.put(hidden.withColumn("id", F.monotonically_increasing_id()))
    key, text = f"c{names.index(id_col)}", f"c{names.index(text_col)}"
    roots = similar(rows.select("id", F.col(text).cast("string").alias("text")), shelf, width, least)
    grouped = roots.join(rows.select("id", F.col(key).alias("key")), "id")
    order = F.struct(F.col("key").isNull().alias("unknown"), "key", "id")
    stays = grouped.groupBy("root").agg(F.min(order).alias("stays"))
    gone = grouped.join(stays, "root").where(F.col("id") != F.col("stays.id")).select("id")
    kept = rows.join(shelf.put(gone), "id", "left_anti")
    return kept.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)))


def hex_of(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
