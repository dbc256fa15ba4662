"""Near-dedup by exact Jaccard similarity of word shingles: every pair at 4/5 or more is found, none below counts.

A first pass counts shingles in a sketch of fixed size. A set is filed under the fifth of its shingles that the sketch
calls rarest, plus one: whatever the sketch says, it orders all shingles alike in all sets, and of two sets at 4/5 or more
the first fifths then share a shingle. A passage that very many documents hold comes last in the order, so documents
that have only such a passage in common do not meet.

First, sets whose texts' SimHash fingerprints link at the anchors of ``simhash`` are compared, and under a shingle every
set with the smallest one; then components are known, and only sets of different components that still meet are compared.
Fingerprints alone would lose most pairs at 4/5 and join others: every link is checked, and what they miss is found by shingles.
 Sizes and the shingles per part of the hash range bound the similarity from
above; only pairs that this bound lets through leave the task, first each set's nearest one, then the others. A shingle with
over TILE sets is dealt as tiles of two parts. Equal sets are one node. Shingles are known by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, save
from .common import attach, whole_text
from .simhash import LIMIT, components, fingerprints, keep_lowest, links

SHINGLE = 5
#: Counters of the sketch, and how many of them a row of its blocks holds.
COUNTERS = 1 << 20
BLOCK = 1 << 16
#: Parts of the hash range whose shingles are counted per set.
PARTS = 128
#: Sets under one shingle that one task compares.
TILE = 4096
#: Pairs of one task that are made distinct at once.
PAIRS = 1 << 20

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_P, _Q = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))


def shingles(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """Distinct 64-bit hashes of the runs of ``shingle`` words, ascending; a shorter text is one run, a blank one none."""
    words = text.encode().translate(_LOWER).split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    of = np.array([digest(w) for w in words], dtype=np.uint64)
    k = min(shingle, len(words))
    run = np.zeros(len(words) - k + 1, dtype=np.uint64)
    for i in range(k):
        run = run * _P + of[i : i + len(run)]
    run ^= run >> np.uint64(29)
    run *= _Q
    return np.unique(run ^ (run >> np.uint64(32)))


def _slots(found: np.ndarray) -> np.ndarray:
    return (found >> np.uint64(8)).astype(np.int64) & (COUNTERS - 1)


def sketch(docs: DataFrame, text: str = "text") -> np.ndarray:
    """How many rows hold a shingle of each slot: COUNTERS counts, whatever the table's size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, dtype=np.int32)
        for batch in batches:
            slots = [_slots(shingles(t.as_py())) for t in batch.column(0)]
            if slots:
                total += np.bincount(np.concatenate(slots), minlength=COUNTERS).astype(np.int32)
        blocks = [total[i : i + BLOCK].tobytes() for i in range(0, COUNTERS, BLOCK)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(blocks)), pa.int32()), pa.array(blocks)], names=["block", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                sums.setdefault(block, np.zeros(BLOCK, dtype=np.int64)).__iadd__(np.frombuffer(counts.as_buffer(), np.int32))
        data = [pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())]
        yield pa.RecordBatch.from_arrays(data, names=["block", "counts"])

    schema = "block int, counts binary"
    found = docs.select(whole_text(text).alias("text")).mapInArrow(count, schema).repartition("block").mapInArrow(add, schema)
    out = np.zeros(COUNTERS, dtype=np.int64)
    for r in found.collect():  # COUNTERS / BLOCK rows
        out[r.block * BLOCK : (r.block + 1) * BLOCK] = np.frombuffer(r.counts, np.int64)
    return out


def signatures(found: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """What a set is filed under: its rarest shingles, of which two sets at 4/5 or more share one."""
    if not len(found):
        return found
    order = np.argsort(counts[_slots(found)], kind="stable")  # ties: by hash
    return found[order[: len(found) // 5 + 1]]


def profile(found: np.ndarray) -> bytes:
    """Shingles per part of the hash range, 255 standing for more. Their differences bound that of the sets from below."""
    return np.minimum(np.bincount((found >> np.uint64(57)).astype(np.int64), minlength=PARTS), 255).astype(np.uint8).tobytes()


def filed(docs: DataFrame, counts: np.ndarray, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, text_hash, node, size, profile, sigs): hash of the text, of its set of shingles, and what the set is filed under."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for batch in batches:
            sets = [shingles(t.as_py()) for t in batch.column(1)]
            node = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], dtype=np.uint64).view(np.int64)
            size = pa.array([len(s) for s in sets], pa.int32())
            sigs = pa.array([signatures(s, counts).view(np.int64) for s in sets], pa.list_(pa.int64()))
            parts = pa.array([profile(s) for s in sets], pa.binary())
            data = [batch.column(0), batch.column(2), pa.array(node), size, parts, sigs]
            yield pa.RecordBatch.from_arrays(data, names=["id", "text_hash", "node", "size", "profile", "sigs"])

    rows = docs.select(F.col(id).alias("id"), whole_text(text).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, text_hash long, node long, size int, profile binary, sigs array<long>"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id)


def shared_rows(under: DataFrame) -> DataFrame:
    """(sig, node, size, head, head_size) of signatures with two sets or more; the head is the one with the smallest node.

    Rows are read as a stream in the order of sig and node; of a signature, a task holds its head only.
    """
    names = ["sig", "node", "size", "head", "head_size"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list[np.ndarray] | None = None  # the row before, with its head and whether it is the head
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            if last is not None:
                cols = [np.r_[x, c] for x, c in zip(last, cols, strict=False)]
            sig, node, _ = cols
            cols = [c[np.r_[True, (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])]] for c in cols]
            sig, node, size = cols
            first = np.r_[last is None or last[5][0], sig[1:] != sig[:-1]]
            at = np.maximum.accumulate(np.where(first, np.arange(len(sig)), 0))
            head, head_size = node[at], size[at]
            if not first[0]:
                head[at == 0], head_size[at == 0] = last[3], last[4]
            keep = ~first | np.r_[sig[1:] == sig[:-1], False]
            last = [c[-1:] for c in (sig, node, size, head, head_size, first)]
            keep[-1] = False
            yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in (sig, node, size, head, head_size)], names=names)
        if last is not None and not last[5][0]:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in last[:5]], names=names)

    rows = under.repartition("sig").sortWithinPartitions("sig", "node")
    return rows.mapInArrow(run, "sig long, node long, size int, head long, head_size int")


def _profiles(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, PARTS).astype(np.int16)


def possible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) that sizes and profiles allow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, both = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            apart = np.abs(_profiles(batch.column(3)) - _profiles(batch.column(4))).sum(axis=1)
            ok = 9 * apart <= both
            yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok])], names=["a", "b"])

    met = pairs
    for k in "ab":
        met = met.join(nodes.select(F.col("node").alias(k), F.col("size").alias(f"s{k}"), F.col("profile").alias(f"p{k}")), k)
    return met.select("a", "b", (F.col("sa") + F.col("sb")).alias("both"), "pa", "pb").mapInArrow(run, "a long, b long")


def across(rows: DataFrame, nodes: DataFrame, roots: DataFrame, nearest: bool) -> DataFrame:
    """(a, b): pairs under one signature, of different components, that sizes and profiles allow; ``nearest``: per set and
    signature the one with the nearest profile only."""
    of = nodes.select("node", "profile").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    met = rows.select("sig", "node", "size").join(of.drop("profile"), "node")
    mixed = met.groupBy("sig").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).filter("n > 2 and low < high")
    parts = F.ceil(F.col("n") / TILE).cast("int")
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    tiles = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.least(j, part) * F.col("parts") + F.greatest(j, part)
    )
    dealt = (
        met.join(mixed.select("sig", parts.alias("parts")), "sig")
        .withColumn("inner", part)
        .select("sig", F.explode(tiles).alias("tile"), "inner", "node", "size", "root", (F.col("parts") + 1).alias("step"))
        .join(nodes.select("node", "profile"), "node")
        .select("sig", "tile", (F.col("tile") % F.col("step") == 0).alias("own"), "inner", "node", "size", "root", "profile")
    )

    def compare(cols: list[np.ndarray], parts: np.ndarray) -> Iterator[np.ndarray]:
        own, inner, node, size, root = cols
        order = np.argsort(size, kind="stable")
        own, inner, node, size, root, parts = (c[order] for c in (own, inner, node, size, root, parts))
        size = size.astype(np.int64)
        upto = np.searchsorted(size, size * 5 // 4, side="right")
        for i in range(len(node) - 1):
            j = np.arange(i + 1, upto[i])
            # Two sets of one part are compared in the part's own tile.
            j = j[(root[j] != root[i]) & (own[i] | (inner[j] != inner[i]))]
            if len(j):
                apart = 9 * np.abs(parts[j] - parts[i]).sum(axis=1) - size[j] - size[i]
                j = j[apart == apart.min()][:1] if nearest and apart.min() <= 0 else j[apart <= 0]
                if len(j):
                    yield np.stack([np.full(len(j), node[i]), node[j]], axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        out: list[np.ndarray] = []

        def flush(final: bool) -> None:
            key = np.concatenate([x[0] for x in held])
            cols = [np.concatenate(x) for x in zip(*(x[1] for x in held), strict=True)]
            parts = np.concatenate([x[2] for x in held])
            starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)])
            # The last tile may go on in the next batch.
            ends = np.r_[starts[1:], len(key)][: None if final else -1]
            for s, e in zip(starts, ends, strict=False):
                out.extend(compare([c[s:e] for c in cols], parts[s:e]))
            s = len(key) if final else starts[-1]
            held[:] = [(key[s:], [c[s:] for c in cols], parts[s:])]

        def pairs() -> pa.RecordBatch:
            found = np.unique(np.concatenate(out), axis=0)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(found.min(axis=1)), pa.array(found.max(axis=1))], names=["a", "b"])

        for batch in batches:
            if batch.num_rows:
                c = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(7)]
                held.append((np.stack([c[0], c[1].astype(np.int64)], axis=1), c[2:], _profiles(batch.column(7))))
                if sum(len(x[0]) for x in held) >= 20_000:
                    flush(False)
                if sum(map(len, out)) >= PAIRS:
                    yield pairs()
        if held:
            flush(True)
        if out:
            yield pairs()

    by = ["sig", "tile"]
    return dealt.repartition(*by).sortWithinPartitions(*by).mapInArrow(run, "a long, b long").distinct()


def similar(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """Those of the saved ``pairs`` (a, b) of nodes whose sets have a Jaccard similarity of 4/5 or more, saved."""
    either = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = save(either.join(nodes.select("node", "text_hash"), "node").select("text_hash"), "wanted")
    texts = docs.select(whole_text(text).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    small = wanted.count() <= 500_000
    texts = texts.join(F.broadcast(wanted) if small else wanted, "text_hash", "left_semi").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t.as_py()) for t in batch.column(0)]
            node = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], dtype=np.uint64).view(np.int64)
            lists = pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(node), lists], names=["node", "found"])

    sets = save(texts.mapInArrow(run, "node long, found array<long>").dropDuplicates(["node"]), "sets")
    heads = pairs.groupBy("a").agg(F.count("*").alias("n"))
    left = sets.select(F.col("node").alias("a"), F.col("found").alias("fa")).join(heads, "a")
    met = attach(pairs.join(sets.select(F.col("node").alias("b"), F.col("found").alias("fb")), "b"), left, "a", "n")
    both = F.size(F.array_intersect("fa", "fb"))
    found = save(met.filter(9 * both >= 4 * (F.size("fa") + F.size("fb"))).select("a", "b"), "similar")
    discard(wanted, sets)
    return found


def linked_prints(docs: DataFrame, nodes: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(a, b): nodes whose SimHash fingerprints differ in at most LIMIT bits, a < b; not all pairs, but they span what links join.

    Nodes of one fingerprint meet the smallest of them, and the smallest ones of linked fingerprints meet each other.
    """
    prints = fingerprints(docs, id, text).select("text_hash", "fp").distinct()
    of = save(nodes.filter("size > 0").select("node", "text_hash").join(prints, "text_hash").select("node", "fp"), "fingerprints")
    heads = save(of.groupBy("fp").agg(F.min("node").alias("head")), "heads")
    same = attach(of.withColumn("n", F.lit(1)), heads.join(of.groupBy("fp").agg(F.count("*").alias("rows")), "fp"), "fp", "rows")
    near = links(heads.select("fp"), LIMIT)
    for k in "ab":
        near = near.join(heads.select(F.col("fp").alias(k), F.col("head").alias(f"head_{k}")), k)
    ends = same.filter("node <> head").select("head", "node").union(near.select("head_a", "head_b"))
    return ends.select(F.least("head", "node").alias("a"), F.greatest("head", "node").alias("b"))


def near_groups(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, text_hash, component_id): the smallest id that is reachable over pairs of similar texts.

    Texts without words, null ones included, are one group. Rows that repeat an id are one node's rows where their sets
    are equal. Null ids are passed over in component_id, which is null only where all ids of a component are. An empty
    table gives an empty result. Other columns are not read.
    """
    prints = save(filed(docs, sketch(docs, text), id, text), "filed")
    nodes = save(
        prints.groupBy("node").agg(
            F.min(id).alias("low"),
            F.count("*").alias("rows"),
            F.min("text_hash").alias("text_hash"),
            F.first("size").alias("size"),
            F.first("profile").alias("profile"),
        ),
        "nodes",
    )
    rows = save(shared_rows(prints.select(F.explode("sigs").alias("sig"), "node", "size")), "buckets")
    near = 4 * F.greatest("size", "head_size") <= 5 * F.least("size", "head_size")
    stars = rows.filter((F.col("node") != F.col("head")) & near).select(F.col("head").alias("a"), F.col("node").alias("b"))
    tested = save(possible(stars.union(linked_prints(docs, nodes, id, text)).distinct(), nodes), "pairs")
    edges = similar(tested, nodes, docs, text)
    linked = save(components(edges), "components")
    for nearest in (True, False):
        pairs = save(across(rows, nodes, linked, nearest).join(tested, ["a", "b"], "left_anti"), "pairs")
        if pairs.isEmpty():
            discard(pairs)
            continue
        more = similar(pairs, nodes, docs, text)
        tested = tested.unionByName(pairs)
        if not more.isEmpty():
            edges = edges.unionByName(more)
            linked = save(components(edges), "components")
    discard(rows)
    rooted = nodes.join(linked, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"), F.sum("rows").alias("rows"))
    of_node = attach(rooted.select("root", "node", F.col("rows").alias("n")), lowest, "root", "rows")
    by_node = save(of_node.select("node", "component_id", "n"), "components")
    return attach(prints.select(id, "text_hash", "node"), by_node, "node", "n").select(id, "text_hash", "component_id")


def near_dedup(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group, the one with the smallest id, with its own columns. Rows with a null id stay."""
    return keep_lowest(docs, near_groups(docs, id, text), id, text)
