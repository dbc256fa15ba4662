"""SimHash near-dedup by anchor points.

Fingerprints of 64 bits are cut into blocks, so many that two fingerprints at distance ``limit`` differ in at most one
bit in some block. In each block the anchors are the words of a covering code: the Hamming code on the first 15 bits,
every word on the others. It has covering radius 1: each block value has one home anchor that differs in at most one
of those 15 bits. Two values at distance 1 lie within radius 1 + 1 of each other's home anchor, so a fingerprint is
replicated to every anchor within 2 and compared there with the fingerprints at home: no pair within ``limit`` is lost.

Which anchors lie within 2 of a value depends on its syndrome alone: 16 lists of bit patterns to flip.

Equal fingerprints are one node. Per anchor only the edges of a spanning forest leave the task, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import discard, save
from .common import attach, whole_text

SHINGLE = 4
LIMIT = 4
SEED = 42
#: Members of one anchor compared by full expansion; larger anchors are searched from node to node.
EXPAND = 512
#: Pairs expanded at once.
PAIRS = 1 << 21
#: Members of one anchor per task. A larger anchor is dealt to tiles, each holding two of its parts.
TILE = 500_000
#: Documents that go, 16 bytes each, of at most this number are broadcast.
SMALL = 500_000

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """A bit is 1 if it is set in over half of the shingles' hashes; no words: 0."""
    words = text.encode().translate(_LOWER).split()
    if not words:
        return 0
    flat = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    k = min(shingle, len(words))
    stops = ends[k - 1 :].tolist()
    starts = [0, *(ends[: len(words) - k] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(flat[a:b], SEED) for a, b in zip(starts, stops, strict=True)], dtype="<u8")
    set_bits = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 4096):
        part = hashes[i : i + 4096].view(np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, text_hash, fp): 64-bit hash of the text and fingerprint, both as signed longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], dtype=np.uint64)
            data = [batch.column(0), batch.column(2), pa.array(fps.view(np.int64))]
            yield pa.RecordBatch.from_arrays(data, names=["id", "text_hash", "fp"])

    rows = docs.select(F.col(id).alias("id"), whole_text(text).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, text_hash long, fp long").withColumnRenamed("id", id)


def blocks_for(limit: int) -> list[tuple[int, int]]:
    """(first bit, bits) of each block: two fingerprints within ``limit`` differ by at most 1 in one of them."""
    n = limit // 2 + 1
    cuts = [64 * i // n for i in range(n + 1)]
    if 64 // n < 16:
        raise ValueError("limits over 6 would make blocks of under 16 bits")
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _syndrome(value: int) -> int:
    """Of the first 15 bits: xor of the positions, counted from 1, that are set."""
    s = 0
    for i in range(15):
        if value >> i & 1:
            s ^= i + 1
    return s


def flips(bits: int, radius: int) -> list[list[int]]:
    """By syndrome: every pattern of at most ``radius`` bits that turns a value with it into an anchor."""
    out: list[list[int]] = [[] for _ in range(16)]
    for n in range(radius + 1):
        for at in combinations(range(bits), n):
            pattern = sum(1 << i for i in at)
            out[_syndrome(pattern)].append(pattern)
    return out


def anchored(fps: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(block, anchor, fp, home): each fingerprint at its home anchor and at all anchors within radius 2, per block."""
    rows = []
    for k, (first, bits) in enumerate(blocks_for(limit)):
        value = F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << bits) - 1))
        position_masks = [sum(1 << i for i in range(15) if (i + 1) >> j & 1) for j in range(4)]
        syndrome: Column = F.lit(0)
        for j, mask in enumerate(position_masks):
            parity = F.bit_count(value.bitwiseAND(F.lit(mask))).bitwiseAND(F.lit(1))
            syndrome = syndrome + parity * (1 << j)
        near = F.array(*[F.array(*[F.lit(p).cast("long") for p in pats]) for pats in flips(bits, 2)])
        home_flip = F.get(F.array(*[F.lit(1 << i >> 1).cast("long") for i in range(16)]), F.col("s").cast("int"))
        rows.append(
            fps.select("fp", value.alias("v"), syndrome.alias("s"))
            .select("fp", "v", home_flip.alias("h"), F.explode(F.get(near, F.col("s").cast("int"))).alias("p"))
            .select(
                F.lit(k).alias("block"),
                F.col("v").bitwiseXOR(F.col("p")).alias("anchor"),
                "fp",
                (F.col("p") == F.col("h")).alias("home"),
            )
        )
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest node of each node's component, of ``n`` nodes with edges a-b."""
    label = np.arange(n)
    while True:
        x, y = label[a], label[b]
        if np.array_equal(x, y):
            return label
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(label, up := label[label]):
            label = up


def _search(fp: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of one large anchor, from node to the nodes it reaches first."""
    rest, left, right = np.arange(len(fp)), [], []
    while len(rest):
        todo, rest = [rest[0]], rest[1:]
        while todo and len(rest):
            at = todo.pop()
            near = np.bitwise_count(fp[rest] ^ fp[at]) <= limit
            if near.any():
                new = rest[near]
                left.append(np.full(len(new), at))
                right.append(new)
                todo.extend(new.tolist())
                rest = rest[~near]
    none = np.empty(0, dtype=np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def _links(fp: np.ndarray, home: np.ndarray, group: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning edges (row, row) of the rows of some anchors; ``group`` ascends."""
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.empty(0, dtype=np.int64)
    size = np.diff(np.r_[first, len(group)])
    a, b = [], []
    for s, n in zip(first[size > EXPAND].tolist(), size[size > EXPAND].tolist(), strict=True):
        x, y = _search(fp[s : s + n], limit)
        a.append(x + s)
        b.append(y + s)
    of = np.repeat(np.arange(len(first)), size)
    at_home = np.flatnonzero(home & (size[of] <= EXPAND) & (size[of] > 1))
    cum = np.cumsum(size[of[at_home]])
    done = 0
    while done < len(at_home):
        stop = max(done + 1, int(np.searchsorted(cum, (cum[done - 1] if done else 0) + PAIRS, "right")))
        rows = at_home[done:stop]
        n = size[of[rows]]
        x = np.repeat(rows, n)
        y = np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[of[rows]], n)
        near = (np.bitwise_count(fp[x] ^ fp[y]) <= limit) & (fp[x] != fp[y])
        a.append(x[near])
        b.append(y[near])
        done = stop
    none = np.empty(0, dtype=np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def links(fps: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(a, b): edges with the components of "within ``limit`` bits", a forest per task and anchor, each a < b.

    ``fps`` has distinct values in fp. Anchors with more than TILE members are split: their members fall into parts,
    and each pair of parts is one tile, so that no task holds more than two parts of one anchor.
    """
    rows = anchored(fps, limit)
    # An anchor's members have their homes within radius 3 of it, and fewer than 128 anchors lie there.
    crowd = rows.filter("home").groupBy("block", "anchor").count().agg(F.max("count")).first()[0] or 0
    if crowd * 128 <= TILE:
        dealt = rows.select("block", "anchor", F.lit(0).alias("tile"), "fp", "home")
    else:
        sizes = rows.groupBy("block", "anchor").agg(F.count("*").alias("members")).filter(F.col("members") > TILE)
        parts = F.ceil(F.col("members") / TILE).cast("int")
        part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
        pairs = F.transform(
            F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.least(j, part) * F.col("parts") + F.greatest(j, part)
        )
        tile = F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(pairs)
        dealt = rows.join(
            sizes.select("block", "anchor", parts.alias("parts")), ["block", "anchor"], "left"
        ).select("block", "anchor", F.explode(tile).alias("tile"), "fp", "home")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def edges(final: bool) -> Iterator[pa.RecordBatch]:
            key, fp, home = (np.concatenate(x) for x in zip(*held, strict=True))
            same = np.all(key[1:] == key[:-1], axis=1)
            group = np.r_[0, np.cumsum(~same)]
            # The last anchor may go on in the next batch.
            n = len(fp) if final else int(np.searchsorted(group, group[-1]))
            held[:] = [(key[n:], fp[n:], home[n:])]
            if n:
                a, b = _links(fp[:n], home[:n], group[:n], limit)
                if len(a):
                    nodes, at = np.unique(np.r_[fp[a], fp[b]], return_inverse=True)
                    root = _roots(at[: len(a)], at[len(a) :], len(nodes))
                    tail = np.flatnonzero(root != np.arange(len(nodes)))
                    signed = nodes.view(np.int64)
                    x, y = signed[root[tail]], signed[tail]
                    data = [pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))]
                    yield pa.RecordBatch.from_arrays(data, names=["a", "b"])

        for batch in batches:
            key = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)], axis=1)
            fp = batch.column(3).to_numpy(zero_copy_only=False).view(np.uint64)
            held.append((key, fp, batch.column(4).to_numpy(zero_copy_only=False).astype(bool)))
            if sum(len(x[1]) for x in held) >= 100_000:
                yield from edges(False)
        if held:
            yield from edges(True)

    by = ["block", "anchor", "tile"]
    return dealt.repartition(*by).sortWithinPartitions(*by).mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each component, for the nodes of ``edges`` (a, b), by alternating stars.

    Each round connects the larger neighbours of every node to its smallest one, then the smaller ones. Rounds go on
    until no edge changes; each is a table in the shared folder, and the one before it is deleted.
    """

    def star(e: DataFrame, larger: bool) -> DataFrame:
        if larger:
            pairs = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
                e.select(F.col("b").alias("u"), F.col("a").alias("v"))
            )
        else:
            pairs = e.select(F.col("b").alias("u"), F.col("a").alias("v"))
        low = pairs.groupBy("u").agg(F.least(F.min("v"), "u").alias("m"), F.count("*").alias("n"))
        # The centre of a large star has very many neighbours: it meets its minimum by broadcast.
        joined = attach(pairs, low, "u", "n")
        if larger:
            out = joined.filter("v > u").select(F.col("v").alias("x"), "m")
        else:
            out = joined.select(F.col("v").alias("x"), "m").unionByName(low.select(F.col("u").alias("x"), "m"))
        ends = out.filter("x <> m").select(F.least("x", "m").alias("a"), F.greatest("x", "m").alias("b"))
        return save(ends.distinct(), "star")

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())

    now = save(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    seen = mark(now)
    while seen[0]:
        half = star(now, True)
        discard(now)
        then = star(half, False)
        discard(half)
        now, before, seen = then, seen, mark(then)
        if seen == before:
            break
    # Every remaining edge leads from the root to one of its nodes.
    roots = now.select("a").distinct().select(F.col("a").alias("node"), F.col("a").alias("root"))
    return roots.unionByName(now.select(F.col("b").alias("node"), F.col("a").alias("root")))


def near_groups(docs: DataFrame, id: str = "doc_id", text: str = "text", limit: int = LIMIT, shingle: int = SHINGLE) -> DataFrame:
    """(id, text_hash, fp, component_id): the smallest id that is reachable over links of at most ``limit`` differing bits.

    Texts without words, null ones included, have fingerprint 0. Rows that repeat an id are one node's rows. Null ids
    are passed over in component_id, which is null only where all ids of a component are. An empty table gives an
    empty result. Other columns are not read.
    """
    prints = save(fingerprints(docs, id, text, shingle), "fingerprints")
    nodes = save(prints.groupBy("fp").agg(F.min(id).alias("low"), F.count("*").alias("rows")), "nodes")
    linked = components(links(nodes.select("fp"), limit))
    rooted = nodes.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"), F.sum("rows").alias("rows"))
    of_node = attach(rooted.select("root", "fp", F.col("rows").alias("n")), lowest, "root", "rows")
    by_print = save(of_node.select("fp", "component_id", "n"), "components")
    return attach(prints, by_print, "fp", "n").select(id, "text_hash", "fp", "component_id")


def near_dedup(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group, the one with the smallest id, with its own columns.

    Rows with a null id stay; rows that repeat an id and a text stay or go together. What goes is known by id and text
    hash; up to SMALL of these pairs are broadcast, so that no text is shuffled.
    """
    return keep_lowest(docs, near_groups(docs, id, text), id, text)


def keep_lowest(docs: DataFrame, groups: DataFrame, id: str, text: str) -> DataFrame:
    """The rows of ``docs`` whose id is the component_id that ``groups`` (id, text_hash, component_id) gives them."""
    gone = save(groups.filter(F.col(id) != F.col("component_id")).select(id, "text_hash").distinct(), "gone")
    keys = gone.select(F.col(id).alias("_gone_id"), F.col("text_hash").alias("_gone_text"))
    same = (docs[id] == F.col("_gone_id")) & (F.xxhash64(F.coalesce(docs[text].cast("string"), F.lit(""))) == F.col("_gone_text"))
    return docs.join(F.broadcast(keys) if gone.count() <= SMALL else keys, same, "left_anti")


def simhash_near_dedup(docs: DataFrame) -> DataFrame:
    """op9: fingerprint and component of every document."""
    return near_groups(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
