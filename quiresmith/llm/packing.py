"""Cost-balanced packing of token sequences."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quiresmith.llm.common import Shelf, bound_batches, chunks
from quiresmith.llm.tokens import Encoder

SEQUENCE = 1024
#: Attention cost of a piece of n tokens: LINEAR * n + QUADRATIC * n * n.
LINEAR, QUADRATIC = 1.0, 1.0 / 1024
#: Tokens packed together at least: a window holds about so many, and one document more.
WINDOW_TOKENS = 1_500_000
#: Partitions whose last tokens, less than a sequence of each, are packed together.
TOGETHER = 512
_END = np.zeros(1, "<u4").tobytes()


def cost(n):
    return LINEAR * n + QUADRATIC * n * n


def assign(lengths: list[int], size: int = SEQUENCE) -> list[tuple[int, int, int, int]]:
    """(document, start, length, sequence) of pieces that fill whole sequences; the rest stays over.

    Documents are cut into pieces of ``size`` and a remainder. There are as many sequences as the
    tokens fill completely. Pieces go in descending length to the sequence of the lowest cost that
    has room for them whole; if none has, the lowest-cost sequence with room takes a part and the
    rest is dealt again. What no room is left for is returned with sequence -1.
    """
    m = sum(lengths) // size
    load = np.zeros(m)
    room = np.full(m, size, np.int64)
    out: list[tuple[int, int, int, int]] = []
    whole = [(d, s) for d, n in enumerate(lengths) for s in range(0, n - size + 1, size)]
    # pieces of the full size come first in descending order and each takes an empty sequence
    for k, (d, s) in enumerate(whole):
        out.append((d, s, size, k))
    load[: len(whole)] = cost(size)
    room[: len(whole)] = 0
    rest = sorted(((n % size, d, n - n % size) for d, n in enumerate(lengths) if n % size), key=lambda x: (-x[0], x[1]))
    open_at = len(whole)
    if open_at < m:
        load, room = load[open_at:], room[open_at:]
    else:
        load, room = load[:0], room[:0]
    for n, d, s in rest:
        while n:
            if not len(room):
                out.append((d, s, n, -1))
                break
            fits = room >= n
            if fits.any():
                k = int(np.where(fits, load, np.inf).argmin())
                take = n
            else:
                k = int(np.where(room > 0, load, np.inf).argmin())
                take = int(room[k])
                if not take:
                    out.append((d, s, n, -1))
                    break
            out.append((d, s, take, open_at + k))
            load[k] += cost(take)
            room[k] -= take
            s, n = s + take, n - take
    return out


def powers_of_two(n: int) -> list[int]:
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


_OUT = [
    ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType()),
    ("doc_tokens", T.LongType()), ("sequence_id", T.LongType()), ("offset", T.LongType()),
]


class _Packer:
    """Packs window after window of one partition; what fills no sequence waits for the next window."""

    def __init__(self, partition: int, size: int, with_ids: bool):
        self.size, self.with_ids = size, with_ids
        self.next = partition << 32
        self.waiting: list[tuple] = []  # (id, ids, start, tokens of the document)
        self.tokens = 0

    def add(self, key, ids: bytes, start: int, total: int) -> None:
        self.waiting.append((key, ids, start, total))
        self.tokens += len(ids) // 4

    def pack(self) -> Iterator[tuple]:
        pieces = assign([len(ids) // 4 for _, ids, _, _ in self.waiting], self.size)
        full: dict[int, list] = {}
        over = []
        for d, s, n, k in pieces:
            key, ids, start, total = self.waiting[d]
            part = (key, ids[4 * s : 4 * (s + n)], start + s, total)
            (over if k < 0 else full.setdefault(k, [])).append(part)
        for k in sorted(full):
            yield from self._emit(full[k])
        self.waiting, self.tokens = over, sum(len(p[1]) // 4 for p in over)

    def finish(self) -> Iterator[tuple]:
        """What fills no sequence, cut into sequences at powers of two: they need no padding."""
        yield from self.pack()
        queue = list(reversed(self.waiting))
        for size in powers_of_two(self.tokens):
            parts, room = [], size
            while room:
                key, ids, start, total = queue.pop()
                n = min(room, len(ids) // 4)
                parts.append((key, ids[: 4 * n], start, total))
                if 4 * n < len(ids):
                    queue.append((key, ids[4 * n :], start + n, total))
                room -= n
            yield from self._emit(parts)
        self.waiting, self.tokens = [], 0

    def _emit(self, parts: list[tuple]) -> Iterator[tuple]:
        offset = 0
        for key, ids, start, total in parts:
            n = len(ids) // 4
            yield (key, start, n, zlib.crc32(ids), total, self.next, offset, *([np.frombuffer(ids, "<u4").astype(np.int32)] if self.with_ids else []))
            offset += n
        self.next += 1


def pack(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
    size: int = SEQUENCE, window: int = WINDOW_TOKENS, with_ids: bool = False,
) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]): one row per piece.

    A document is its text's ids (strings of added tokens in it are those tokens) and a final 0. Each
    input partition packs its own documents, window after window, and carries what fills no sequence
    on to the next; what a partition has left in the end, less than a sequence, is packed with that of
    up to TOGETHER partitions. Only the last few sequences of these are shorter, each a power of two
    long, so that nothing is padded. No document is shuffled but for those tokens, and a window's
    memory does not grow with the input. Costs are balanced within a window.

    A null or empty text is the single id 0. Repeated rows and null ids are packed like any others;
    other columns are ignored, whatever their names. An empty table gives an empty result.
    """
    bound_batches(docs.sparkSession)
    shelf = Shelf(docs.sparkSession, "packing")
    kept = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("__text"))
    fields = [kept.schema["doc_id"], *(T.StructField(n, t) for n, t in _OUT)]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    schema = T.StructType(fields)
    # rows without a sequence are what a partition has left: their ids wait
    first = T.StructType([*fields, T.StructField("waiting", T.BinaryType()), T.StructField("together", T.IntegerType())])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow, arrow_first = to_arrow_schema(schema), to_arrow_schema(first)

    def batch(pieces, kinds) -> pa.RecordBatch:
        columns = list(zip(*pieces, strict=True)) or [[] for _ in kinds]
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = Encoder(tokenizer_path)
        partition = TaskContext.get().partitionId()
        packer = _Packer(partition, size, with_ids)
        for b in batches:
            for at, texts in chunks(b.column(1)):
                keys = b.column(0).slice(at, len(texts)).to_pylist()
                for key, ids in zip(keys, encoder.encode(texts), strict=True):
                    ids += _END
                    packer.add(key, ids, 0, len(ids) // 4)
                if packer.tokens >= window:
                    yield batch([(*p, None, None) for p in packer.pack()], arrow_first)
        yield batch([(*p, None, None) for p in packer.pack()], arrow_first)
        none = [None] * with_ids
        yield batch([(key, start, len(ids) // 4, None, total, None, None, *none, ids, partition // TOGETHER) for key, ids, start, total in packer.waiting], arrow_first)

    done = shelf.put(kept.mapInArrow(run, first))
    left = done.where("waiting IS NOT NULL").select("together", "doc_id", "start", "waiting", "doc_tokens")
    left = left.repartition("together").sortWithinPartitions("together", "doc_id", "start", F.xxhash64("waiting"))

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, packer = None, None
        for b in batches:
            for together, key, start, ids, total in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if together != now:
                    if packer:
                        yield batch(packer.finish(), arrow)
                    now, packer = together, _Packer((1 << 30) + together, size, with_ids)
                packer.add(key, ids, start, total)
        if packer:
            yield batch(packer.finish(), arrow)

    return done.where("waiting IS NULL").select(schema.names).unionByName(left.mapInArrow(rest, schema))
