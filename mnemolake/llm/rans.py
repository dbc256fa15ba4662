"""Token ids as files: a static range asymmetric numeral system over interleaved blocks.

A segment is a run of documents in id order with about SEGMENT token ids. It has one frequency table, taken from all
its ids and shared by its blocks of BLOCK ids. A block is independent: its ids are dealt to LANES interleaved states,
and it carries a CRC-32 of its ids. Every STEPS steps a checkpoint keeps the states and the place in the stream, so the
parts of a block decode side by side. One segment is one row of a Parquet table, with the ids and lengths of its
documents in columns; readers need nothing but the row.

States are 64-bit integers of at least 2^31, renewed by 32-bit words; frequencies add up to 2^SCALE.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import scratch_path
from .bpe import chunks, codec
from .common import whole_text

SCALE = 20
LOW = 1 << 31
LANES = 128
STEPS = 256
BLOCK = LANES * STEPS * 4
SEGMENT = 1 << 21
#: Below it, ids are counted by position instead of sorted.
DENSE = 1 << 22
END_ID = 0
MAGIC = b"RANS0001"


def quantise(counts: np.ndarray) -> np.ndarray:
    """Frequencies that add up to 2^SCALE, at least 1 for each count over 0."""
    total = int(counts.sum())
    if not total:
        return np.zeros(len(counts), dtype=np.int64)
    if np.count_nonzero(counts) > 1 << SCALE:
        raise ValueError("more symbols than frequency slots")
    f = np.where(counts > 0, np.maximum(1, counts.astype(np.int64) * (1 << SCALE) // total), 0)
    over = int(f.sum()) - (1 << SCALE)
    order = np.argsort(-f, kind="stable")
    if over < 0:
        f[order[0]] -= over
    for s in order.tolist():
        if over <= 0:
            break
        take = min(over, int(f[s]) - 1)
        f[s] -= take
        over -= take
    return f


class _Table:
    """Frequencies and their running sums for the symbols that occur, in ascending order."""

    def __init__(self, symbols: np.ndarray, freq: np.ndarray):
        self.symbols = symbols.astype(np.int64)
        self.freq = freq.astype(np.uint64)
        self.cum = (np.cumsum(freq) - freq).astype(np.uint64)

    def pack(self) -> bytes:
        steps = np.diff(self.symbols, prepend=0).astype("<u4").tobytes() + self.freq.astype("<u4").tobytes()
        body = zlib.compress(steps, 6)
        return struct.pack("<II", len(self.symbols), len(body)) + body

    @classmethod
    def unpack(cls, data: memoryview) -> tuple[_Table, int]:
        n, size = struct.unpack_from("<II", data)
        flat = np.frombuffer(zlib.decompress(data[8 : 8 + size]), dtype="<u4").astype(np.int64)
        return cls(np.cumsum(flat[:n]), flat[n:]), 8 + size


def _encode_blocks(index: np.ndarray, table: _Table) -> list[tuple[list[np.ndarray], list[int], np.ndarray]]:
    """For blocks of equal length (rows of ``index``): states and stream places at each checkpoint, and the words.

    Steps run backwards, so that decoding runs forwards. All blocks advance together.
    """
    blocks, n = index.shape
    steps = -(-n // LANES)
    state = np.full((blocks, LANES), LOW, dtype=np.uint64)
    words, owner = [], []
    kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    written = np.zeros(blocks, dtype=np.int64)
    for t in range(steps - 1, -1, -1):
        at = index[:, t * LANES : (t + 1) * LANES]
        x = state[:, : at.shape[1]]
        f, c = table.freq[at], table.cum[at]
        full = x >= f << np.uint64(63 - SCALE)
        if full.any():
            rows, lanes = np.nonzero(full)
            out = x[rows, lanes]
            words.append(out.astype(np.uint32))  # the low 32 bits
            owner.append(rows)
            x[rows, lanes] = out >> np.uint64(32)
            written += full.sum(axis=1)
        q = x // f
        x[...] = (q << np.uint64(SCALE)) + (x - q * f) + c
        if t % STEPS == 0:
            kept[t] = (state.copy(), written.copy())
    if words:
        # Backwards by step, forwards by lane within a step, then together by block.
        flat, own = np.concatenate(words[::-1]), np.concatenate(owner[::-1])
        order = np.argsort(own, kind="stable")
        flat, bounds = flat[order], np.searchsorted(own[order], np.arange(blocks + 1))
    else:
        flat, bounds = np.empty(0, dtype=np.uint32), np.zeros(blocks + 1, dtype=np.int64)
    out = []
    for b in range(blocks):
        states = [kept[t][0][b] for t in sorted(kept)]
        places = [int(written[b] - kept[t][1][b]) for t in sorted(kept)]
        out.append((states, places, flat[bounds[b] : bounds[b + 1]]))
    return out


def encode_segment(ids: np.ndarray) -> bytes:
    """A self-contained segment of any ids under 2^32; no ids make a segment of no blocks."""
    if len(ids) and int(ids.max()) < DENSE:
        every = np.bincount(ids)
        symbols = np.flatnonzero(every)
        counts = every[symbols]
        inverse = (np.cumsum(every > 0) - 1)[ids]
    else:
        symbols, inverse, counts = np.unique(ids, return_inverse=True, return_counts=True)
    table = _Table(symbols, quantise(counts))
    out = [MAGIC, struct.pack("<QI", len(ids), -(-len(ids) // BLOCK)), table.pack()]
    even = len(ids) // BLOCK * BLOCK
    groups = [inverse[:even].reshape(-1, BLOCK), inverse[even:].reshape(1, -1)]
    at = 0
    for group in groups:
        if not group.size:
            continue
        for states, places, words in _encode_blocks(group, table):
            n = group.shape[1]
            check = zlib.crc32(ids[at : at + n].astype("<u4").tobytes())
            out.append(struct.pack("<IIII", n, len(words), len(states), check))
            out.append(np.array(places, dtype="<u4").tobytes())
            out.append(np.stack(states).astype("<u8").tobytes())
            out.append(words.astype("<u4").tobytes())
            at += n
    return b"".join(out)


def _decode_parts(states: np.ndarray, starts: np.ndarray, words: np.ndarray, table: _Table, lookup: np.ndarray, n: int) -> np.ndarray:
    """Indices of ``n`` ids from each checkpoint (a row of ``states``), all side by side."""
    parts = len(states)
    out = np.empty((parts, n), dtype=np.int64)
    state, place = states.copy(), starts.copy()
    mask, shift = np.uint64((1 << SCALE) - 1), np.uint64(SCALE)
    for k in range(0, n, LANES):
        width = min(LANES, n - k)
        x = state[:, :width]
        slot = x & mask
        s = lookup[slot.astype(np.int64)]
        out[:, k : k + width] = s
        x[...] = table.freq[s] * (x >> shift) + slot - table.cum[s]
        low = x < LOW
        if low.any():
            rows, lanes = np.nonzero(low)
            n_low = low.sum(axis=1)
            rank = np.arange(len(rows)) - np.repeat(np.cumsum(n_low) - n_low, n_low)
            x[rows, lanes] = (x[rows, lanes] << np.uint64(32)) | words[place[rows] + rank]
            place += n_low
    return out


def decode_segment(data: bytes) -> np.ndarray:
    """The ids of a segment; an error where a checksum doesn't hold."""
    view = memoryview(data)
    if view[:8] != MAGIC:
        raise ValueError("not a segment of token ids")
    total, blocks = struct.unpack_from("<QI", view, 8)
    table, size = _Table.unpack(view[20:])
    lookup = np.repeat(np.arange(len(table.symbols)), table.freq.astype(np.int64))
    ids = np.empty(total, dtype=np.int64)
    at, pos = 20 + size, 0
    jobs: dict[int, list[tuple]] = {}  # by number of ids: (first id, states, words, place)
    checks = []
    for _ in range(blocks):
        n, n_words, marks, check = struct.unpack_from("<IIII", view, at)
        at += 16
        places = np.frombuffer(view, "<u4", marks, at)
        at += 4 * marks
        states = np.frombuffer(view, "<u8", marks * LANES, at).reshape(marks, LANES)
        at += 8 * marks * LANES
        words = np.frombuffer(view, "<u4", n_words, at)
        at += 4 * n_words
        for m in range(marks):
            first = m * STEPS * LANES
            jobs.setdefault(min(STEPS * LANES, n - first), []).append((pos + first, states[m], words, int(places[m])))
        checks.append((pos, n, check))
        pos += n
    for n, work in jobs.items():
        flat, base, seen = [], {}, 0
        for _, _, words, _ in work:
            if id(words) not in base:
                base[id(words)] = seen
                flat.append(words)
                seen += len(words)
        # A state is read beyond its stream only where the data are damaged; the padding lets the checksum say so.
        stream = np.concatenate([*flat, np.zeros(LANES * STEPS, dtype=np.uint32)]).astype(np.uint64)
        starts = np.array([base[id(words)] + place for _, _, words, place in work], dtype=np.int64)
        found = _decode_parts(np.stack([s for _, s, _, _ in work]).astype(np.uint64), starts, stream, table, lookup, n)
        for (first, *_), row in zip(work, found, strict=True):
            ids[first : first + n] = table.symbols[row]
    for first, n, check in checks:
        if zlib.crc32(ids[first : first + n].astype("<u4").tobytes()) != check:
            raise ValueError(f"checksum of the block at id {first} doesn't hold")
    return ids


def write(docs: DataFrame, folder: str, path: str, id: str = "doc_id", text: str = "text") -> None:
    """Encode all documents with the tokenizer at ``path`` and write their segments in ascending id order.

    Each document ends with id 0, so a null or empty text is one id. Null ids come first; rows that repeat an id follow
    each other in the order of a hash of their text. Other columns are not read. An empty table has no segments. The
    texts are dealt by ranges of id, so a task holds one run of documents and at most one segment of ids.
    """
    kind = docs.schema[id].dataType
    key_type = to_arrow_type(kind)
    rows = docs.select(F.col(id).alias("id"), whole_text(text).alias("text"))
    tie = F.xxhash64("text")
    ordered = rows.repartitionByRange("id", tie).sortWithinPartitions("id", tie).select("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        end = np.array([END_ID], dtype=c.dtype).tobytes()
        part, number, before = TaskContext.get().partitionId(), 0, 0
        keys: list = []
        raws: list[bytes] = []
        size = 0

        def segment() -> pa.RecordBatch:
            nonlocal before
            ids = np.frombuffer(b"".join(raws), dtype=c.dtype)
            lengths = [len(r) // c.dtype.itemsize for r in raws]
            data = [
                pa.array([part], pa.int32()),
                pa.array([number], pa.int32()),
                pa.array([before], pa.int64()),
                pa.array([len(ids)], pa.int64()),
                pa.array([keys], pa.list_(key_type)),
                pa.array([lengths], pa.list_(pa.int64())),
                pa.array([encode_segment(ids)], pa.binary()),
            ]
            before += len(ids)
            return pa.RecordBatch.from_arrays(data, names=["part", "segment", "before", "n_tokens", "ids", "lengths", "payload"])

        for batch in batches:
            for first, texts in chunks(batch.column(1)):
                for i, raw in enumerate(c.encode(texts), first):
                    keys.append(batch.column(0)[i].as_py())
                    raws.append(raw + end)
                    size += len(raws[-1]) // c.dtype.itemsize
                    if size >= SEGMENT:
                        yield segment()
                        number, size = number + 1, 0
                        keys.clear()
                        raws.clear()
        if raws:
            yield segment()

    schema = f"part int, segment int, before long, n_tokens long, ids array<{kind.simpleString()}>, lengths array<long>, payload binary"
    ordered.mapInArrow(run, schema).write.parquet(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(id, start, n_tokens, ids): the documents of the files in their order, ids as little-endian 32-bit integers.

    ``start`` counts the ids of all documents before. A row knows the ids before it in its part, so segments are decoded
    where they are read; the totals per part, one row for each task that wrote, are the only rows that come to the driver.
    """
    table = spark.read.parquet(folder)
    totals = table.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    before = [0, *accumulate(r.n for r in totals)]
    bases = spark.createDataFrame([(r.part, b) for r, b in zip(totals, before, strict=False)], "part int, base long")
    key = table.schema["ids"].dataType.elementType
    key_type = to_arrow_type(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                start, keys, lengths, payload = (batch.column(k)[i].as_py() for k in range(4))
                ids = decode_segment(payload).astype("<u4")
                ends = np.cumsum(lengths)
                for k in range(0, len(keys), 2000):
                    some = range(k, min(k + 2000, len(keys)))
                    data = [
                        pa.array([keys[j] for j in some], key_type),
                        pa.array([start + int(ends[j]) - lengths[j] for j in some], pa.int64()),
                        pa.array([lengths[j] for j in some], pa.int64()),
                        pa.array([ids[ends[j] - lengths[j] : ends[j]].tobytes() for j in some], pa.binary()),
                    ]
                    yield pa.RecordBatch.from_arrays(data, names=["id", "start", "n_tokens", "ids"])

    placed = table.join(F.broadcast(bases), "part").select((F.col("base") + F.col("before")).alias("start"), "ids", "lengths", "payload")
    return placed.mapInArrow(run, f"id {key.simpleString()}, start long, n_tokens long, ids binary")


def rans_files(docs: DataFrame, path: str) -> DataFrame:
    """op6: what the files say of each document."""
    folder = scratch_path(docs.sparkSession, "token-ids")
    write(docs, folder, path)
    return read(docs.sparkSession, folder).select(
        F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32")
    )
