"""Cost-balanced packing of documents into sequences of a fixed number of tokens.

A document of n tokens fills floor(n / size) sequences by itself; what remains goes to a pool. A pool's pieces are
assigned in descending order, each to the sequence of lowest estimated cost that has room left, and are cut where they
don't fit. A pool of k sequences leaves less than one sequence of padding in all.

Pools are formed within a task, so nothing is shuffled and no source can make one of them large.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .bpe import chunks, codec
from .common import whole_text

SEQUENCE = 1024
#: Documents' remainders packed together: bounds the memory of a task, not the result's completeness.
POOL = 8192
#: Attention cost of a piece of n tokens: LINEAR * n + QUADRATIC * n * n, relative to one token's linear work.
LINEAR, QUADRATIC = 1.0, 1.0 / 1024
END_ID = 0

PIECES = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def assign(lengths: list[int], size: int, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """(item, start in item, length, sequence, offset) for items of at most ``size`` tokens.

    ceil(sum / size) sequences; items in descending length, ties in the order given; each to the sequence of lowest
    cost with room, ties to the lower sequence; an item that doesn't fit there fills it and goes on to the next.
    """
    n = -(-sum(lengths) // size)
    heap = [(0.0, s) for s in range(n)]
    used = [0] * n
    out = []
    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        start, left = 0, lengths[item]
        while left:
            cost, s = heapq.heappop(heap)
            put = min(left, size - used[s])
            out.append((item, start, put, s, used[s]))
            used[s] += put
            start, left = start + put, left - put
            if used[s] < size:
                heapq.heappush(heap, (cost + linear * put + quadratic * put * put, s))
    return out


def pack(docs: DataFrame, path: str, size: int = SEQUENCE, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of all documents: id, start, length, ids, doc_tokens, sequence_id, offset.

    ``ids`` holds the piece's token ids as little-endian unsigned 32-bit integers; every document ends with id 0, so an
    empty or null text is one token. Rows that repeat an id are packed each. Null ids stay null. An empty table has no
    pieces. Other columns are not read. ``sequence_id`` is unique in the table: the task's number in the high bits.
    """

    rows = docs.select(F.col(id).alias("id"), whole_text(text).alias("text"))
    key_type = to_arrow_type(rows.schema["id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        end = np.array([END_ID], dtype=c.dtype).tobytes()
        next_sequence = TaskContext.get().partitionId() << 36
        pool: list[tuple] = []  # (id, start, ids of the remainder, tokens of the document)
        schema = pa.schema(
            [("id", key_type), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
             ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
        )

        def table(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(cols, schema, strict=True)], schema=schema)

        def packed() -> list[tuple]:
            nonlocal next_sequence
            placed = assign([len(p[2]) for p in pool], size)
            rows = []
            for item, start, n, s, offset in placed:
                key, first, ids, total = pool[item]
                rows.append((key, first + start, n, ids[start : start + n].astype("<u4").tobytes(), total, next_sequence + s, offset))
            next_sequence += 1 + max((p[3] for p in placed), default=-1)
            pool.clear()
            return rows

        for batch in batches:
            keys = batch.column(0)
            for first, texts in chunks(batch.column(1)):
                rows = []
                for i, raw in enumerate(c.encode(texts), first):
                    ids = c.ids(raw + end)
                    key, total = keys[i].as_py(), len(ids)
                    whole = total - total % size
                    for k in range(0, whole, size):
                        rows.append((key, k, size, ids[k : k + size].astype("<u4").tobytes(), total, next_sequence, 0))
                        next_sequence += 1
                    if whole < total:
                        pool.append((key, whole, ids[whole:].copy(), total))
                if len(pool) >= POOL:
                    rows += packed()
                if rows:
                    yield table(rows)
        if pool:
            yield table(packed())

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, {PIECES}").withColumnRenamed("id", id)


def cost_packing(docs: DataFrame, path: str) -> DataFrame:
    """op10: the pieces with a checksum of their ids."""
    return pack(docs, path).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
