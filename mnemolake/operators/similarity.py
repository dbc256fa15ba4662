"""Exact and near duplicates: token-set joins, MinHash bands, consolidation, matching."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import LongType

from ..functions import text as tx
from ..session import cut_lineage, discard, save
from .graph import connected_components
from .selection import LAST_LINKS


def token_sets(memories: DataFrame, hashed: bool = False) -> DataFrame:
    """(memory_id, words, digest): distinct sorted tokens; rows without tokens are left out.

    With ``hashed`` the words are the 64-bit hashes that the similarity joins know them by, which move and store smaller.
    """
    words = memories.select("memory_id", tx.token_set(F.col("content")).alias("words"))
    sets = words.withColumn("digest", F.sha2(F.array_join("words", " "), 256)).filter(F.size("words") > 0)
    return sets.withColumn("words", hashes(F.col("words"))) if hashed else sets


def hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def collapse_copies(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Representatives (rep, n, words) of equal token sets, and members (memory_id, rep).

    Copies meet in a map-side combine on the digest, so a text repeated by a
    third of all rows ships one row per task; similarity joins then run on
    representatives only.
    """
    reps = sets.groupBy("digest").agg(
        F.min("memory_id").alias("rep"), F.count("*").alias("n"), F.first("words").alias("words")
    )
    members = sets.select("memory_id", "digest").join(reps.select("digest", "rep"), "digest")
    return reps.select("rep", "n", "words"), members.select("memory_id", "rep")


def exact_copies(memories: DataFrame) -> DataFrame:
    """(digest, n, first_id) of texts that occur more than once, after trimming and lower-casing."""
    sig = F.sha2(F.lower(F.trim("content")), 256)
    return (
        memories.groupBy(sig.alias("digest"))
        .agg(F.count("*").alias("n"), F.min("memory_id").alias("first_id"))
        .filter("n > 1")
    )


#: Counters of the sketch of term counts, and how many of them a row of its blocks holds.
COUNTERS = 1 << 20
BLOCK = 1 << 16
#: Terms whose rows are formed at once, rows whose pairs are, and bytes of bitmaps that are compared at once.
SLICE = 1 << 17
ROWS = 1 << 15
BYTES = 1 << 25
#: 64-bit words of the largest bitmap, as a power of two.
WIDEST = 7
#: Parts that the prefixes are dealt to at least, and sets per part beyond that.
PARTS = 16
PART_SETS = 1 << 15
#: Groups of sets whose pairs are checked tile by tile, at least, and terms of a group beyond that.
GROUPS = 4
GROUP_TERMS = 1 << 23


def _hashed(sets: DataFrame) -> DataFrame:
    """(node, id, size, terms) of (id, words), saved: words as 64-bit hashes. Sets without words resemble nothing and are left out."""
    terms = F.col("words") if sets.schema["words"].dataType.elementType == LongType() else hashes(F.col("words"))
    rows = sets.select("id", F.size("words").alias("size"), terms.alias("terms")).filter("size > 0")
    return save(rows.select(F.monotonically_increasing_id().alias("node"), "id", "size", "terms"), "sets")


def _slots(terms: np.ndarray) -> np.ndarray:
    return (terms & (COUNTERS - 1)).astype(np.int64)


def _sketch(sets: DataFrame) -> np.ndarray:
    """How many sets hold a term of each slot: COUNTERS counts, whatever the number of sets."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, dtype=np.int32)
        for batch in batches:
            total += np.bincount(_slots(batch.column(0).flatten().to_numpy()), minlength=COUNTERS).astype(np.int32)
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
    found = sets.select("terms").mapInArrow(count, schema).repartition("block").mapInArrow(add, schema)
    out = np.zeros(COUNTERS, dtype=np.int64)
    for r in found.collect():  # COUNTERS / BLOCK rows
        out[r.block * BLOCK : (r.block + 1) * BLOCK] = np.frombuffer(r.counts, np.int64)
    return out


def _least_overlap(size: np.ndarray, share: float) -> np.ndarray:
    return np.ceil(size * share - 1e-9).astype(np.int64)


def _bitmaps(terms: np.ndarray, row: np.ndarray, width: np.ndarray) -> list[bytes]:
    """Per set the parities of its terms' counts by hash, in ``64 << width`` bits."""
    bit = (terms.view(np.uint64) >> np.uint64(40)).astype(np.int64) & ((64 << width[row]) - 1)
    odd, counts = np.unique(row * (64 << WIDEST) + bit, return_counts=True)
    odd = odd[counts % 2 == 1]
    at, bit = odd // (64 << WIDEST), odd % (64 << WIDEST)
    ends = np.cumsum(1 << width)
    words = np.zeros(int(ends[-1]), dtype=np.uint64)
    np.bitwise_or.at(words, (ends - (1 << width))[at] + bit // 64, np.uint64(1) << (bit % 64).astype(np.uint64))
    return [words[e - n : e].tobytes() for e, n in zip(ends.tolist(), (1 << width).tolist(), strict=True)]


def _bits_per_term(threshold: float) -> float:
    """Bits of a set's bitmap per term. The share of terms that may differ asks for five times as many; under 0.7, where many
    unrelated texts come close to the threshold, more bits keep their pairs from leaving the task."""
    apart = (1 - threshold) / (1 + threshold)
    return max(5 * apart, 180 * apart**3)


def _prefixes(sets: DataFrame, counts, threshold: float, side: int = 0, parts: int = PARTS) -> DataFrame:
    """(part, node, size, side, marks, bits): a set's rarest-first prefix, dealt by term to ``parts`` parts.

    Two sets with Jaccard >= t share t of the larger one's terms at least, and 2t / (1 + t) of the smaller one's. So their
    first common term lies in the first ``size - ceil(share * size) + 1`` terms of each, in one order for all sets. A mark
    is a term's upper half and its place in the set. ``bits`` is the bitmap of the whole set; a part gets it once a set.
    """
    bits_per_term = _bits_per_term(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = counts.value
        for batch in batches:
            ends = np.cumsum(batch.column(1).to_numpy().astype(np.int64))
            start = 0
            while start < batch.num_rows:
                stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + SLICE, side="right")))
                slice_ = batch.slice(start, stop - start)
                start = stop
                size = slice_.column(1).to_numpy().astype(np.int64)
                terms = slice_.column(2).flatten().to_numpy()
                row = np.repeat(np.arange(len(size)), size)
                width = np.clip(np.ceil(np.log2(np.maximum(size * bits_per_term, 64) / 64)), 0, WIDEST).astype(np.int64)
                bits = pa.array(_bitmaps(terms, row, width), pa.binary())
                seen = held[_slots(terms)]
                order = np.lexsort((terms, seen, row))
                terms, seen = terms[order], seen[order]
                place = np.arange(len(terms)) - (np.cumsum(size) - size)[row]
                # A term that no other set holds cannot be shared.
                keep = (place < (size - _least_overlap(size, threshold) + 1)[row]) & (seen > 1)
                terms, row, place = terms[keep], row[keep], place[keep]
                part = ((terms.view(np.uint64) >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)
                order = np.lexsort((part, row))
                terms, row, place, part = terms[order], row[order], place[order], part[order]
                first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (part[1:] != part[:-1])][: len(row)])
                marks = pa.ListArray.from_arrays(pa.array(np.r_[first, len(row)].astype(np.int32)), pa.array(terms >> 32 << 32 | place))
                at = pa.array(row[first])
                cols = [pa.array(part[first].astype(np.int32)), slice_.column(0).take(at), slice_.column(1).take(at)]
                cols += [pa.array(np.full(len(first), side, dtype=np.int32)), marks, bits.take(at)]
                yield pa.RecordBatch.from_arrays(cols, names=["part", "node", "size", "side", "marks", "bits"])

    schema = "part int, node long, size int, side int, marks array<long>, bits binary"
    return sets.select("node", "size", "terms").mapInArrow(run, schema)


def _apart(ends: np.ndarray, words: np.ndarray, log: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many bits the bitmaps of ``x`` and ``y`` differ, the longer one folded to the shorter: at most the terms that only one has."""
    out = np.zeros(len(x), dtype=np.int64)
    both = log[x] * (WIDEST + 1) + log[y]
    for code in np.flatnonzero(np.bincount(both)).tolist():
        at = np.flatnonzero(both == code)
        wx, wy = (1 << k for k in divmod(code, WIDEST + 1))
        low = min(wx, wy)
        for s in range(0, len(at), max(1, BYTES // (8 * max(wx, wy)))):
            part = at[s : s + max(1, BYTES // (8 * max(wx, wy)))]
            left, right = (
                np.bitwise_xor.reduce(words[(ends[i] - w)[:, None] + np.arange(w)].reshape(len(i), w // low, low), axis=1)
                for i, w in ((x[part], wx), (y[part], wy))
            )
            out[part] = np.bitwise_count(left ^ right).sum(axis=1)
    return out


def _folded(ends: np.ndarray, words: np.ndarray, log: np.ndarray, by: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bitmaps as ``_apart`` reads them, ``1 << by`` times narrower: a first look at pairs takes fewer bytes."""
    narrow = np.maximum(log - by, 0)
    stops = np.cumsum(1 << narrow)
    out = np.zeros(int(stops[-1]), dtype=np.uint64)
    for k in np.unique(log).tolist():
        at = np.flatnonzero(log == k)
        low = 1 << max(k - by, 0)
        for s in range(0, len(at), max(1, BYTES // (8 << k))):
            i = at[s : s + max(1, BYTES // (8 << k))]
            rows = words[(ends[i] - (1 << k))[:, None] + np.arange(1 << k)].reshape(len(i), -1, low)
            out[(stops[i] - low)[:, None] + np.arange(low)] = np.bitwise_xor.reduce(rows, axis=1)
    return stops, out, narrow


def _meeting(rows: DataFrame, threshold: float, sides: bool, parts: int = PARTS) -> DataFrame:
    """(x, y): nodes that share a prefix term and whose sizes, places and bitmaps allow the threshold; x has the smaller set.

    With ``sides`` only nodes of different sides meet. What a part's rows say rules most pairs out before they leave the task.
    """
    share = threshold / (1 + threshold)
    fold = round(np.log2(_bits_per_term(threshold) / (5 * (1 - threshold) / (1 + threshold))))
    inner_share = 2 * threshold / (1 + threshold)

    def met(cols: list[np.ndarray], bitmaps: list[tuple]) -> Iterator[np.ndarray]:
        term, at, place, node, size, side = cols
        inner = place < size - _least_overlap(size, inner_share) + 1
        # Ranges of inner rows, by term and size, that are small enough for a row and not too small.
        run = np.cumsum(np.r_[True, term[1:] != term[:-1]])
        step = int(size.max()) + 2
        order = np.flatnonzero(inner)
        order = order[np.lexsort((size[order], run[order]))]
        keys = run[order] * step + size[order]
        low = np.searchsorted(keys, run * step + np.ceil(size * threshold - 1e-9).astype(np.int64), side="left")
        n = np.searchsorted(keys, run * step + size, side="right") - low
        upto = np.cumsum(n)
        start = 0
        while start < len(n):
            stop = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + ROWS * 16, side="right")))
            k = n[start:stop]
            y = np.repeat(np.arange(start, stop), k)
            x = order[np.repeat(low[start:stop], k) + np.arange(len(y)) - np.repeat(np.cumsum(k) - k, k)]
            start = stop
            least = np.ceil((size[x] + size[y]) * share - 1e-9)
            ok = np.minimum(size[x] - place[x], size[y] - place[y]) >= least
            # Of two sets of one size the smaller node, or the left side, counts as the smaller one.
            if sides:
                ok &= (side[x] != side[y]) & ((size[x] < size[y]) | (side[x] < side[y]))
            else:
                ok &= (size[x] < size[y]) | (node[x] < node[y])
            x, y, least = x[ok], y[ok], least[ok]
            for bits in bitmaps:
                if len(x):
                    ok = size[x] + size[y] - _apart(*bits, at[x], at[y]) >= 2 * least
                    x, y, least = x[ok], y[ok], least[ok]
            if len(x):
                yield np.stack([node[x], node[y]], axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols: list[list[np.ndarray]] = []
        for batch in batches:
            if batch.num_rows:
                marks, bits = batch.column(3), batch.column(4)
                # A binary column's offsets stand before its bytes; rows may start behind the first one.
                stops = np.frombuffer(bits.buffers()[1], np.int32)[bits.offset : bits.offset + batch.num_rows + 1].astype(np.int64)
                raw = np.frombuffer(bits.buffers()[2], np.uint8)[stops[0] : stops[-1]].view(np.uint64).copy()
                lists = [marks.value_lengths().to_numpy().astype(np.int64), marks.flatten().to_numpy().copy()]
                plain = [batch.column(i).to_numpy().copy() for i in range(3)]
                cols.append([*plain, *lists, np.diff(stops) // 8, raw])
        if not cols:
            return
        node, size, side, n, marks, width, words = (np.concatenate(c) for c in zip(*cols, strict=True))
        cols.clear()
        size, ends, log = size.astype(np.int64), np.cumsum(width), np.log2(width).astype(np.int64)
        bitmaps = [(ends, words, log)]
        if fold:
            bitmaps.insert(0, _folded(ends, words, log, fold))
        at = np.repeat(np.arange(len(n)), n)
        order = np.argsort(marks >> 32, kind="stable")
        term, place, at = marks[order] >> 32, marks[order] & 0xFFFFFFFF, at[order]
        starts = np.r_[np.flatnonzero(np.r_[True, term[1:] != term[:-1]]), len(term)]
        out: list[np.ndarray] = []

        def pairs() -> pa.RecordBatch:
            found = np.unique(np.concatenate(out), axis=0)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["x", "y"])

        begin = 0
        while begin < len(term):
            end = int(starts[min(np.searchsorted(starts, begin + ROWS), len(starts) - 1)])  # whole terms
            i = at[begin:end]
            for found in met([term[begin:end], i, place[begin:end], node[i], size[i], side[i]], bitmaps):
                out.append(found)
                if sum(map(len, out)) >= BLOCK * 16:
                    yield pairs()
            begin = end
        if out:
            yield pairs()

    dealt = rows.repartitionById(parts, F.col("part")).drop("part")
    return dealt.mapInArrow(run, "x long, y long").distinct()


def _parts(n: int) -> int:
    """Into how many parts the prefixes of ``n`` sets go: few, as each takes the bitmap of a set, but none too large for a task."""
    return max(PARTS, n // PART_SETS)


def _common(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """(a, b): the pairs of one tile that reach the threshold, from rows (a, b, size, terms): sets have no ``b``, pairs no terms."""
    cols: list[list[np.ndarray]] = [[] for _ in range(5)]
    for batch in batches:
        is_set = batch.column(1).is_null()
        for k, rows in enumerate((batch.filter(is_set), batch.filter(pc.invert(is_set)))):
            if rows.num_rows and not k:
                cols[0].append(rows.column(0).to_numpy())
                cols[1].append(rows.column(2).to_numpy().astype(np.int64))
                cols[2].append(np.r_[rows.column(3).value_lengths().to_numpy(), rows.column(3).flatten().to_numpy()].astype(np.int64))
            elif rows.num_rows:
                cols[3].append(rows.column(0).to_numpy())
                cols[4].append(rows.column(1).to_numpy())
    if not cols[3]:
        return
    length = np.concatenate([x[: len(n)] for x, n in zip(cols[2], cols[0], strict=True)])
    flat = np.concatenate([x[len(n) :] for x, n in zip(cols[2], cols[0], strict=True)])
    node, size, a, b = (np.concatenate(cols[k]) for k in (0, 1, 3, 4))
    cols.clear()
    words, flat = np.unique(flat, return_inverse=True)
    order = np.argsort(node)
    a, b = (order[np.searchsorted(node, x, sorter=order)] for x in (a, b))
    start = np.cumsum(length) - length
    order = np.argsort(a, kind="stable")
    a, b = a[order], b[order]
    cuts = np.flatnonzero(np.r_[True, a[1:] != a[:-1], True])
    held = np.zeros(len(words), dtype=bool)
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        x = a[lo]
        own = flat[start[x] : start[x] + length[x]]
        held[own] = True
        for s in range(lo, hi, ROWS // 8):
            y = b[s : min(hi, s + ROWS // 8)]
            ends = np.cumsum(length[y])
            at = np.arange(ends[-1]) + np.repeat(start[y] - (ends - length[y]), length[y])
            common = np.add.reduceat(held[flat[at]], ends - length[y], dtype=np.int64)
            y = y[common / (size[x] + size[y] - common) >= threshold]
            if len(y):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(y), node[x])), pa.array(node[y])], names=["a", "b"])
        held[own] = False


def _in_tiles(pairs: DataFrame, sets: DataFrame, threshold: float, groups: int) -> DataFrame:
    """(a, b): those of the saved ``pairs`` of nodes that reach the threshold.

    A tile holds the sets of two groups of nodes, as far as its pairs name them, so a set moves ``groups`` times at most,
    however many pairs it is in.
    """

    def group(node: str) -> Column:
        return F.pmod(F.xxhash64(node), F.lit(groups)).cast("int")

    def tile(x: Column, y: Column) -> Column:
        return F.least(x, y) * groups + F.greatest(x, y)

    null = F.lit(None)
    dealt = pairs.select(tile(group("a"), group("b")).alias("tile"), "a", "b")
    tiles = F.transform(F.sequence(F.lit(0), F.lit(groups - 1)), lambda g: tile(g, group("node")))
    named = dealt.select("tile", F.col("a").alias("node")).union(dealt.select("tile", "b")).distinct()
    placed = sets.select("node", "size", F.array_distinct("terms").alias("terms"), F.explode(tiles).alias("tile"))
    if pairs.count() < 2 * groups * sets.count():
        placed = placed.join(named, ["tile", "node"], "left_semi")
    rows = placed.select("tile", F.col("node").alias("a"), null.cast("long").alias("b"), "size", "terms")
    rows = rows.unionByName(dealt.select("tile", "a", "b", null.cast("int").alias("size"), null.cast("array<long>").alias("terms")))
    rows = rows.repartitionById(groups * groups, F.col("tile")).drop("tile")
    return rows.mapInArrow(lambda batches: _common(batches, threshold), "a long, b long")


def _verify(pairs: DataFrame, left: DataFrame, right: DataFrame, threshold: float, by: str = "id") -> DataFrame:
    """(a, b, similarity): ids of the saved ``pairs`` (a, b) of ids, or nodes, that reach the threshold."""
    if by == "node":
        sets = left if left is right else left.unionByName(right)
        n, terms = sets.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
        groups = max(GROUPS, -(-terms // GROUP_TERMS))
        if pairs.count() > groups * n:
            pairs = save(_in_tiles(pairs, sets, threshold, groups), "pairs")

    def side(sets: DataFrame, k: str) -> DataFrame:
        rows = sets.join(pairs.select(F.col(k).alias(by)).distinct(), by, "left_semi")  # few pairs move few sets
        return rows.select(F.col(by).alias(k), F.col("id").alias(f"id_{k}"), F.col("size").alias(f"n{k}"), F.col("terms").alias(f"t{k}"))

    both = pairs.join(side(left, "a"), "a").join(side(right, "b"), "b").withColumn("common", F.size(F.array_intersect("ta", "tb")))
    sim = F.col("common") / (F.col("na") + F.col("nb") - F.col("common"))
    return both.select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), sim.alias("similarity")).filter(F.col("similarity") >= threshold)


def jaccard_pairs(reps: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity) for all pairs of distinct token sets with Jaccard >= threshold, a < b.

    Exact: prefixes, sizes and bitmaps lose no pair, and every candidate is verified. Words are known by 64-bit hashes.
    """
    sets = _hashed(reps.select(F.col("rep").alias("id"), "words"))
    counts = sets.sparkSession.sparkContext.broadcast(_sketch(sets))
    parts = _parts(sets.count())
    met = _meeting(_prefixes(sets, counts, threshold, parts=parts), threshold, False, parts)
    # A saved table has a known size: a small one is broadcast, and the sets stay where they are.
    found = _verify(save(met.toDF("a", "b"), "pairs"), sets, sets, threshold, "node").filter("a <> b")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity")


def jaccard_matches(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity) between two collections of (id, words)."""
    lset, rset = _hashed(left), _hashed(right)
    counts = lset.sparkSession.sparkContext.broadcast(_sketch(lset.select("terms").union(rset.select("terms"))))
    # Nodes of the right side are told apart by the last bit.
    lset, rset = (df.withColumn("node", F.col("node") * 2 + k) for k, df in enumerate((lset, rset)))
    parts = _parts(lset.count() + rset.count())
    rows = _prefixes(lset, counts, threshold, 0, parts).unionByName(_prefixes(rset, counts, threshold, 1, parts))
    x, y = F.col("x"), F.col("y")
    met = _meeting(rows, threshold, True, parts).select(F.when(x % 2 == 0, x).otherwise(y).alias("a"), F.when(x % 2 == 0, y).otherwise(x).alias("b"))
    return _verify(save(met, "pairs"), lset, rset, threshold, "node")


def best_match(matches: DataFrame) -> DataFrame:
    """Most similar ``b`` per ``a`` (smallest id on ties): a max aggregate, no window."""
    return matches.groupBy("a").agg(
        F.max_by("b", F.struct("similarity", (-F.col("b")).alias("neg"))).alias("b"), F.max("similarity").alias("similarity")
    )


def _take(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(a, b, similarity): the sequential pass over at most LAST_LINKS matches of one batch stream."""
    parts = list(frames)
    if not parts:
        return
    matches = pd.concat(parts).sort_values(["a", "similarity", "b"], ascending=[True, False, True])
    taken, rows, last = set(), [], None
    for a, b, sim in zip(matches["a"].tolist(), matches["b"].tolist(), matches["similarity"].tolist(), strict=True):
        if a != last and b not in taken:
            taken.add(b)
            rows.append((a, b, sim))
            last = a
    yield pd.DataFrame(rows, columns=["a", "b", "similarity"])


def greedy_one_to_one(matches: DataFrame, last: int = LAST_LINKS) -> DataFrame:
    """Left rows in id order each take their best free right row.

    In a round a left row gets its best open right row for good if no smaller left row has that one open too; all matches
    of either go. The smallest open left row always gets its best, so every round closes matches and the outcome is the
    sequential one. Once at most ``last`` matches are open, one task walks through them. Rows without an id match nothing.
    """
    cols = matches.select("a", "b", "similarity")
    open_ = save(cols.filter("a IS NOT NULL AND b IS NOT NULL"), "matches")
    found = []
    while (n := open_.count()) > last:
        smallest = open_.groupBy("b").agg(F.min("a").alias("a"))
        final = save(best_match(open_).join(smallest, ["a", "b"]).select("a", "b", "similarity"), "found")
        found.append(final)
        rest = save(open_.join(final.select("a"), "a", "left_anti").join(final.select("b"), "b", "left_anti").select("a", "b", "similarity"), "matches")
        discard(open_)
        open_ = rest
    if n or not found:
        found.append(open_.coalesce(1).mapInPandas(_take, cols.schema))
    return reduce(DataFrame.unionByName, found)


def _copies(memories: DataFrame, side: int) -> tuple[DataFrame, DataFrame]:
    """Classes (id, words) of equal token sets, and rows (memory_id, id); left classes have even ids, right ones odd."""
    sets = token_sets(memories, hashed=True).withColumn("id", F.shiftleft(F.shiftright(F.xxhash64("digest"), 1), 1) + side)
    sets = save(sets, "token_sets")
    reps, _ = collapse_copies(sets.select(F.col("id").alias("memory_id"), "words", "digest"))
    return reps.select(F.col("rep").alias("id"), "words"), sets.select("memory_id", "id").filter("memory_id IS NOT NULL").distinct()


def _walk(links: list[tuple], left: list[tuple], right: list[tuple]) -> list[tuple]:
    """(a, b, similarity) of the sequential pass: ``links`` (class, class, similarity), ``left`` and ``right`` (memory_id, class)."""
    pools, options, of = defaultdict(list), defaultdict(list), defaultdict(list)
    for a, b, sim in sorted(links, key=lambda r: -r[2]):
        options[a].append((b, sim))
    for i, c in sorted(right):
        pools[c].append(i)
    for i, c in left:
        of[i].append(c)
    taken: set = set()
    at, begin = dict.fromkeys(pools, 0), dict.fromkeys(options, 0)

    def head(c):
        """The smallest free row of a right class."""
        rows, k = pools[c], at.get(c, 0)
        while k < len(rows) and rows[k] in taken:
            k += 1
        at[c] = k
        return rows[k] if k < len(rows) else None

    found = []
    for i in sorted(of):
        best = None
        for a in of[i]:
            todo, k = options[a], begin.get(a, 0)
            while k < len(todo) and head(todo[k][0]) is None:
                k += 1
            begin[a] = k
            for b, sim in todo[k:]:
                if sim < todo[k][1]:
                    break
                free = head(b)
                if free is not None and (best is None or (-sim, free) < best):
                    best = (-sim, free)
        if best:
            taken.add(best[1])
            found.append((i, best[1], -best[0]))
    return found


def match_rows(matches: DataFrame, left: DataFrame, right: DataFrame, last: int = LAST_LINKS) -> DataFrame:
    """(a, b, similarity): left rows in id order each take their best free right row, copies of a text included.

    ``matches`` (a, b, similarity) are between classes of equal token sets, ``left`` and ``right`` (memory_id, id) their rows;
    class ids differ from side to side. Rows of one class are alike, so their pairs are never formed: a class gives its rows
    out in id order. Classes that no link joins don't meet, so every component is walked through on its own, about ``last``
    links and rows a task; a component of more than that goes in rounds, row by row. A row that repeats an id is the same
    one with more texts.
    """
    links = save(matches.select("a", "b", "similarity"), "matches")
    rows = [
        save(side.join(links.select(F.col(k).alias("id")).distinct(), "id", "left_semi").select("memory_id", "id"), "rows")
        for side, k in ((left, "a"), (right, "b"))
    ]
    edges = links.select("a", "b")
    for side in rows:
        again = side.groupBy("memory_id").agg(F.min("id").alias("a"), F.max("id").alias("last")).filter("a < last")
        edges = edges.unionByName(side.join(again, "memory_id").select("a", F.col("id").alias("b")))
    comp = save(connected_components(edges), "components")
    kind = rows[0].schema["memory_id"].dataType.simpleString()
    null = F.lit(None)
    parts = [links.select(F.lit(0).alias("kind"), "a", "b", "similarity", null.cast(kind).alias("memory_id"))]
    for k, side in enumerate(rows, 1):
        parts.append(side.select(F.lit(k).alias("kind"), F.col("id").alias("a"), null.cast("long").alias("b"), null.cast("double").alias("similarity"), "memory_id"))
    # Components are known by their smallest class; both sides of a link are in one.
    dealt = save(reduce(DataFrame.unionByName, parts).join(comp.withColumnRenamed("node", "a"), "a"), "dealt")
    large = save(dealt.groupBy("component").agg(F.count("*").alias("n")).filter(F.col("n") > last).select("component"), "large")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: list[list[tuple]] = [[], [], []]
        for batch in batches:
            c = batch.to_pydict()
            for k, a, b, sim, i in zip(c["kind"], c["a"], c["b"], c["similarity"], c["memory_id"], strict=True):
                got[k].append((i, a) if k else (a, b, sim))
        found = _walk(*got)
        if found:
            cols = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (ids, ids, pa.float64()), strict=True)], names=["a", "b", "similarity"])

    ids = to_arrow_type(rows[0].schema["memory_id"].dataType)
    tasks = dealt.count() // last + 1 if last else 1
    small = dealt.join(large, "component", "left_anti").repartition(tasks, "component")
    found = small.select("kind", "a", "b", "similarity", "memory_id").mapInArrow(run, f"a {kind}, b {kind}, similarity double")
    if large.isEmpty():
        return found
    ours = links.join(comp.join(large, "component").select(F.col("node").alias("a")), "a")
    each = ours.join(rows[0].select(F.col("memory_id").alias("_a"), F.col("id").alias("a")), "a")
    each = each.join(rows[1].select(F.col("memory_id").alias("_b"), F.col("id").alias("b")), "b")
    return found.unionByName(greedy_one_to_one(each.select(F.col("_a").alias("a"), F.col("_b").alias("b"), "similarity"), last))


def diff_stores(left: DataFrame, right: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(a, b, similarity): greedy one-to-one matching of the rows of two stores. Rows without words or an id match nothing."""
    (a, ours), (b, theirs) = (_copies(memories, k) for k, memories in enumerate((left, right)))
    return match_rows(jaccard_matches(a, b, threshold), ours, theirs)


# MinHash parameters of the container merge: 128 hashes in 16 bands of 8.
BANDS = 16
ROWS_PER_BAND = 8
#: Members of a bucket that one task settles; a larger bucket goes in rounds until it holds no more.
BUCKET = 4096


def _minhash_bands(shingles: pd.Series) -> pd.Series:
    rng = np.random.default_rng(42)
    n = BANDS * ROWS_PER_BAND
    a = rng.integers(1, 2**63, size=n, dtype=np.uint64) | np.uint64(1)
    b = rng.integers(0, 2**63, size=n, dtype=np.uint64)
    out = []
    for row in shingles:
        h = np.asarray(row, dtype=np.int64).view(np.uint64)
        low = np.full(n, np.iinfo(np.uint64).max, dtype=np.uint64)
        # Blocks keep the working set small for very long texts.
        for s in range(0, len(h), 4096):
            low = np.minimum(low, ((h[s : s + 4096, None] * a + b) >> np.uint64(1)).min(axis=0))
        out.append(low.reshape(BANDS, ROWS_PER_BAND).view(np.int64).tolist())
    return pd.Series(out)


def minhash_bands(reps: DataFrame, bigrams: bool = True) -> DataFrame:
    """(rep, band, bucket): banded MinHash over single tokens and, with ``bigrams``, bigrams of the sorted tokens."""
    w = F.col("words")
    grams = F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w)), lambda p, q: F.xxhash64(p, q))
    shingles = F.transform(w, lambda t: F.xxhash64(t))
    if bigrams:
        shingles = F.concat(F.when(F.size(w) > 1, grams).otherwise(F.array().cast("array<bigint>")), shingles)
    bands = F.pandas_udf(_minhash_bands, "array<array<bigint>>")
    hashed = reps.select("rep", F.posexplode(bands(F.array_distinct(shingles))).alias("band", "sig"))
    return hashed.select("rep", "band", F.xxhash64("sig").alias("bucket"))


def lsh_links(reps: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity): verified links that span the groups of similar sets within each bucket.

    In a round every open member of a bucket meets the bucket's head, the first in an order of the band's own. Those that
    are similar are linked to it and leave the bucket; the others go on to the next round under a new head. A member whose
    only partner has left with another head is found in a band with another order, or not at all. A bucket of near copies
    takes one round and one link per member, never all pairs, and no member is given up because its bucket is headed by
    a set that it doesn't resemble. Every link is verified exactly. Each round settles at least the heads, so it ends.
    Buckets don't depend on each other: one of at most BUCKET members takes all its rounds in one task.

    Buckets come from single tokens, whose agreement is the similarity that is verified: a pair at 0.85 shares a bucket
    with probability 0.99. With bigrams, which a changed token breaks twice, it would be far less.
    """
    sets = _hashed(reps.select(F.col("rep").alias("id"), "words"))
    open_ = save(minhash_bands(reps, bigrams=False), "buckets")
    found = []
    while True:
        head = F.min_by("rep", F.xxhash64("rep", "band")).alias("head")
        heads = save(open_.groupBy("band", "bucket").agg(head, F.count("*").alias("k")).filter("k > 1"), "heads")
        few = open_.join(heads.filter(F.col("k") <= BUCKET).select("band", "bucket"), ["band", "bucket"])
        found.append(save(_settled(few, sets, threshold), "links"))
        met = open_.join(heads.filter(F.col("k") > BUCKET).drop("k"), ["band", "bucket"]).filter("rep <> head")
        met = save(met, "met")
        discard(open_, heads)
        if met.isEmpty():
            discard(met)
            break
        pairs = save(met.select(F.least("head", "rep").alias("a"), F.greatest("head", "rep").alias("b")).distinct(), "pairs")
        links = save(_verify(pairs, sets, sets, threshold), "links")
        discard(pairs)
        found.append(links)
        done = links.select(F.col("a").alias("head"), F.col("b").alias("rep")).union(links.select("b", "a"))
        open_ = save(met.join(done, ["head", "rep"], "left_anti").select("rep", "band", "bucket"), "buckets")
        discard(met)
    return reduce(DataFrame.unionByName, found).distinct()


def _settled(members: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity): all rounds of ``lsh_links`` over buckets (rep, band, bucket), each in one task."""
    kind = sets.schema["id"].dataType.simpleString()
    ids = to_arrow_type(sets.schema["id"].dataType)

    def rounds(reps: list, size: np.ndarray, terms: list[np.ndarray]) -> Iterator[tuple]:
        rows = list(range(len(reps)))  # in the band's order
        while rows:
            own = [i for i in rows if reps[i] == reps[rows[0]]]
            rows = [i for i in rows if reps[i] != reps[rows[0]]]
            if not rows:
                return
            length = np.array([len(terms[i]) for i in rows])
            flat = np.concatenate([terms[i] for i in rows])
            linked = set()
            for h in own:
                words = np.sort(terms[h])
                hit = words[np.minimum(np.searchsorted(words, flat), len(words) - 1)] == flat
                common = np.add.reduceat(hit, np.cumsum(length) - length, dtype=np.int64)
                sim = common / (size[rows] + size[h] - common)
                for k in np.flatnonzero(sim >= threshold).tolist():
                    other = reps[rows[k]]
                    linked.add(other)
                    yield min(reps[h], other), max(reps[h], other), float(sim[k])
            rows = [i for i in rows if reps[i] not in linked]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        held: list[tuple] = []

        def links() -> Iterator[pa.RecordBatch]:
            found = list(rounds([r[0] for r in held], np.array([r[1] for r in held]), [r[2] for r in held]))
            held.clear()
            if found:
                cols = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (ids, ids, pa.float64()), strict=True)], names=["a", "b", "similarity"])

        for batch in batches:
            keys = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            rows = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4), strict=True)
            for key, (rep, size, terms) in zip(keys, rows, strict=True):
                if key != last and held:
                    yield from links()
                last = key
                held.append((rep, size, terms.values.to_numpy().copy()))
        if held:
            yield from links()

    words = sets.select(F.col("id").alias("rep"), "size", F.array_distinct("terms").alias("terms"))
    rows = members.join(words, "rep").select("band", "bucket", "rep", "size", "terms", F.xxhash64("rep", "band").alias("place"))
    dealt = rows.repartition("band", "bucket").sortWithinPartitions("band", "bucket", "place").drop("place")
    return dealt.mapInArrow(run, f"a {kind}, b {kind}, similarity double")


def near_copy_groups(memories: DataFrame, threshold: float) -> DataFrame:
    """(memory_id, component) for rows that belong to a group of similar texts."""
    reps, members = collapse_copies(save(token_sets(memories, hashed=True), "token_sets"))
    pairs = jaccard_pairs(reps, threshold)
    comp = connected_components(pairs)
    grouped = members.join(comp.withColumnRenamed("node", "rep"), "rep", "left")
    repeated = reps.filter("n > 1").select("rep", F.lit(True).alias("repeated"))
    return (
        grouped.join(repeated, "rep", "left")
        .filter(F.col("component").isNotNull() | F.col("repeated"))
        .select("memory_id", F.coalesce("component", "rep").alias("component"))
    )


def consolidation_clusters(memories: DataFrame, bridge: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(memory_id, component) under the consolidation gate.

    A similar pair counts when the two share at least two concepts or either
    has fewer than two. Equal texts are one node per concept signature, so the
    gate is decided between (token set, concept set) classes.
    """
    concepts = bridge.groupBy("memory_id").agg(F.sort_array(F.collect_set("concept")).alias("cs"))
    sets = save(token_sets(memories, hashed=True).withColumn("row", F.monotonically_increasing_id()), "token_sets")
    held = sets.select("memory_id", "row", "digest").join(concepts, "memory_id", "left")
    held = held.withColumn("cs", F.coalesce("cs", F.array().cast("array<string>")))
    keyed = held.withColumn("digest", F.sha2(F.concat_ws("|", "digest", F.array_join("cs", ",")), 256))
    first = F.min(F.struct(F.col("memory_id").isNull().alias("bare"), "memory_id", "row"))
    classes = save(
        keyed.groupBy("digest")
        .agg(first.alias("f"), F.count("*").alias("n"), F.first("cs").alias("cs"))
        .select("digest", F.col("f.memory_id").alias("rep"), "f.row", "n", "cs"),
        "classes",
    )
    members = keyed.select("memory_id", "digest").join(classes.select("digest", "rep"), "digest")
    # The words move once, without the concepts.
    words = sets.select("row", "words").join(classes.select("row", "rep"), "row").select("rep", "words")
    pairs = save(jaccard_pairs(words, threshold).select("a", "b"), "pairs")
    ca = classes.select(F.col("rep").alias("a"), F.col("cs").alias("csa"))
    cb = classes.select(F.col("rep").alias("b"), F.col("cs").alias("csb"))
    shared = F.size(F.array_intersect("csa", "csb")) >= 2
    loose = (F.size("csa") < 2) | (F.size("csb") < 2)
    linked = pairs.join(ca, "a").join(cb, "b").filter(shared | loose).select("a", "b")
    comp = connected_components(linked).withColumnRenamed("node", "rep")
    # Copies with the same concepts always pass the gate among themselves.
    repeated = classes.filter("n > 1").select("rep", F.lit(True).alias("repeated"))
    return (
        members.join(comp, "rep", "left")
        .join(repeated, "rep", "left")
        .filter(F.col("component").isNotNull() | F.col("repeated"))
        .select("memory_id", F.coalesce("component", "rep").alias("component"))
    )


def cluster_summary(clusters: DataFrame, memories: DataFrame, bridge: DataFrame, min_size: int = 3) -> DataFrame:
    """One row per cluster: size, boosted strength, concept count and distinct sentences.

    The merged text itself is a relation (see ``cluster_sentences``), because a
    cluster may hold a large share of all rows.
    """
    sizes = clusters.groupBy("component").agg(F.count("*").alias("source_count")).filter(F.col("source_count") >= min_size)
    rows = clusters.join(sizes, "component").join(memories.select("memory_id", "strength"), "memory_id")
    strength = rows.groupBy("component", "source_count").agg(F.max("strength").alias("top"))
    concepts = (
        clusters.join(bridge, "memory_id").groupBy("component").agg(F.countDistinct("concept").alias("n_concepts"))
    )
    return strength.join(concepts, "component", "left").select(
        "component",
        "source_count",
        F.round(F.least(F.col("top") * 1.2, F.lit(2.0)), 6).alias("strength"),
        F.coalesce("n_concepts", F.lit(0)).alias("n_concepts"),
    )


def cluster_sentences(clusters: DataFrame, memories: DataFrame) -> DataFrame:
    """(component, memory_id, pos, sentence): each distinct sentence at its first place in the cluster.

    Ordered by (memory_id, pos) the sentences read as the merged summary.
    """
    text = memories.select("memory_id", F.trim("content").alias("content"))
    parts = F.filter(F.split("content", r"(?<=[.!?])\s+"), lambda s: F.trim(s) != "")
    sents = clusters.join(text, "memory_id").select("component", "memory_id", F.posexplode_outer(parts).alias("pos", "sentence"))
    keyed = sents.filter(F.col("sentence").isNotNull()).withColumn("norm", F.lower(F.trim("sentence")))
    first = keyed.groupBy("component", "norm").agg(
        F.min_by(F.struct("memory_id", "pos", F.trim("sentence").alias("sentence")), F.struct("memory_id", "pos")).alias("s")
    )
    return first.select("component", "s.*")


def merge_plan(existing: DataFrame, incoming: DataFrame, threshold: float = 0.85, keep_both: bool = False) -> DataFrame:
    """(memory_id, action, target_id, similarity) for each incoming row.

    ``update``: newer than its best match; ``skip``: older; ``insert``: no match
    (or always, with provenance, under keep-both). Copies are matched once per
    distinct token set on either side.
    """
    ereps, _ = collapse_copies(token_sets(existing, hashed=True))
    isets = save(token_sets(incoming, hashed=True), "token_sets")
    ireps, imembers = collapse_copies(isets)
    matches = jaccard_matches(
        ireps.select(F.col("rep").alias("id"), "words"), ereps.select(F.col("rep").alias("id"), "words"), threshold
    )
    best = best_match(matches).select(F.col("a").alias("rep"), F.col("b").alias("target_id"), "similarity")
    rows = (
        incoming.select("memory_id", "created_at")
        .join(imembers, "memory_id", "left")
        .join(best, "rep", "left")
        .join(existing.select(F.col("memory_id").alias("target_id"), F.col("created_at").alias("old_at")), "target_id", "left")
    )
    if keep_both:
        action = F.lit("insert")
    else:
        action = (
            F.when(F.col("target_id").isNull(), "insert")
            .when(F.col("created_at") > F.col("old_at"), "update")
            .otherwise("skip")
        )
    return rows.select("memory_id", action.alias("action"), "target_id", F.round("similarity", 6).alias("similarity"))


def contained_words(passages: DataFrame, docs: DataFrame, share: float) -> DataFrame:
    """(item_id, doc_id, size, common) where a document holds at least ``share`` of a passage's distinct words.

    ``passages`` (item_id, words), ``docs`` (doc_id, words). Such a document holds one of the passage's rarest
    ``size - ceil(share * size) + 1`` words, so only pairs that share one of these are looked at. The words of rows that
    repeat an id count together, with all documents.
    """
    q = passages.withColumn("size", F.size("words")).filter("size > 0")
    docs = save(docs, "words")

    def repeated(rows: DataFrame, key: str) -> DataFrame:
        return rows.groupBy(key).agg(F.count("*").alias("_n")).filter((F.col("_n") > 1) | F.col(key).isNull()).select(F.col(key).alias("_again"))

    def once_or_not(rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
        again = save(repeated(rows, key), "again")
        same = F.col(key).eqNullSafe(F.col("_again"))
        return rows.join(again, same, "left_anti"), rows.join(again, same, "left_semi")

    def counted(q: DataFrame, d: DataFrame) -> DataFrame:
        terms = d.select("doc_id", F.explode("words").alias("w"))
        both = q.select("item_id", "size", F.explode("words").alias("w")).join(terms, "w").groupBy("item_id", "doc_id", "size")
        return both.agg(F.count("*").alias("common"))

    q_once, q_again = once_or_not(q, "item_id")
    d_once, d_again = once_or_not(docs, "doc_id")
    words = q_once.select("item_id", "size", F.explode("words").alias("w"))
    terms = d_once.select("doc_id", F.explode("words").alias("w"))
    df = terms.join(words.select("w").distinct(), "w", "left_semi").groupBy("w").agg(F.count("*").alias("df"))
    # A passage's own words: bounded by its text.
    ranked = F.sort_array(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "w")))
    by_rarity = words.join(df, "w", "left").groupBy("item_id", "size").agg(ranked.alias("ranked"))
    length = (F.col("size") - F.ceil(F.col("size") * share - 1e-9) + 1).cast("int")
    rare = save(by_rarity.select("item_id", F.explode(F.slice("ranked", F.lit(1), length)["w"]).alias("w")), "rare")
    met = save(terms.join(rare, "w").select("item_id", "doc_id").distinct(), "met")
    held = met.join(q_once, "item_id").join(d_once.withColumnRenamed("words", "held"), "doc_id")
    common = F.size(F.array_intersect("words", "held")).cast("long").alias("common")
    found = held.select("item_id", "doc_id", "size", common).unionByName(counted(q_again, docs)).unionByName(counted(q_once, d_again))
    return found.filter(F.col("common") / F.col("size") >= share)


def blended_similarity(words_a: Column, words_b: Column, concepts_a: Column, concepts_b: Column) -> Column:
    """Write-time duplicate test: 0.7 word Jaccard + 0.3 concept Jaccard."""
    from ..functions.scoring import jaccard

    return 0.7 * jaccard(words_a, words_b) + 0.3 * jaccard(concepts_a, concepts_b)
