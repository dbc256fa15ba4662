"""Spelling variants: words one edit apart, found by a relational trie frontier.

The vocabulary is a distributed trie, held as a table of edges (node, label, child). Nodes are known by a hash of their
path, and only nodes that branch or end a word are kept, so an edge's label may be several code points long. A frontier
of states (word, position, node, edits) is joined with that table level by level: a state without an edit follows its
own word and branches off at every node by one replaced or one deleted code point; a state with its edit behind it only
follows. States that reach the end of their word at the end of another word are neighbours. A state keeps the tail of its
word from its position on, and an edge knows how many code points the words behind it have left, at least and at most:
a state whose tail fits none of them ends at once.

Near the root every word would meet every letter. So words are entered twice, forwards and from the back, and edits are
made in the second half of the path only: an edit in a word's first half lies in the second half of its reversal. States
start at the first node beyond the half, where few words share a path. Inserted code points need no states: the longer
word finds the shorter one by a deletion. Of a run of equal code points only the last is deleted, which gives the same
words, and therefore an edit survives at nodes with another way out alone.

Hashes only steer the search: neighbours are compared as texts at the end, and a colliding node merely adds states.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import discard, save
from .common import HOT_SHARE, attach, whole_text

MIN_LENGTH = 5
MIN_COUNT = 3
#: Every occurrence whose checksum this divides loses a code point.
NOISE = 97
#: Distinct words that a task counts before it passes them on.
HELD = 400_000
#: Prefix rows of a batch that leaves a task.
PREFIXES = 200_000
#: A node is dealt by broadcast from this number of states on, if it also holds one HOT_SHARE-th of all.
HOT_STATES = 50_000

#: Letters of the contract are Latin-1 code points, so a word is a string of single bytes: A-Z are lower-cased, what is
#: no letter becomes a space.
_LETTER = {*range(65, 91), *range(97, 123), *range(0xC0, 0x100)}
_FOLD = bytes((c + 32 if 65 <= c <= 90 else c) if c in _LETTER else 32 for c in range(256))


def _noisy_words(text: str, key: bytes, counts: Counter, utf8: dict[bytes, bytes]) -> None:
    """Count the words of one text, with one code point deleted where the checksum says so."""
    words = text.encode("latin-1", "replace").translate(_FOLD).split()
    counts.update(words)
    seed = zlib.crc32(key)
    own = None
    for w in set(words):
        if w.isascii():
            h = zlib.crc32(w, seed)
        else:
            spelt = utf8.get(w)
            if spelt is None:
                if len(utf8) > HELD:
                    utf8.clear()
                spelt = utf8[w] = w.decode("latin-1").encode()
            h = zlib.crc32(spelt, seed)
        if h % NOISE == 0:
            own = own or Counter(words)
            at = h % len(w)
            counts[w] -= own[w]
            counts[w[:at] + w[at + 1 :]] += own[w]


def vocabulary(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): words of at least MIN_LENGTH code points with at least MIN_COUNT occurrences in the whole table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        utf8: dict[bytes, bytes] = {}

        def out() -> Iterator[pa.RecordBatch]:
            kept = [(w.decode("latin-1"), n) for w, n in counts.items() if n and len(w) >= MIN_LENGTH]
            counts.clear()
            for i in range(0, len(kept), PREFIXES):
                words, ns = zip(*kept[i : i + PREFIXES], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(ns, pa.int64())], names=["word", "n"])

        for batch in batches:
            for key, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                _noisy_words(t.as_py(), key.encode() + b":", counts, utf8)
                if len(counts) > HELD:
                    yield from out()
        yield from out()

    rows = docs.select(F.coalesce(F.col(id).cast("string"), F.lit("")).alias("id"), whole_text(text).alias("text"))
    found = rows.mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= MIN_COUNT)


def _entered(vocab: DataFrame) -> DataFrame:
    """(path, back, n): every word forwards and from the back."""
    return vocab.select(
        F.explode(
            F.array(
                F.struct(F.col("word").alias("path"), F.lit(False).alias("back")),
                F.struct(F.reverse("word").alias("path"), F.lit(True).alias("back")),
            )
        ).alias("w"),
        "n",
    ).select("w.path", "w.back", "n")


def _half(length: int, back: bool) -> int:
    """Edits are made from this position on: each position of a word is covered by one of its two entries."""
    return (length + 1) // 2 if back else length // 2


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, entry, depth, left, next): the nodes of each entry's path from its half on; next is null at its end."""
    names = ["node", "entry", "depth", "left", "next"]
    node, entry, depth, left, step = [], [], [], [], []

    def out() -> pa.RecordBatch:
        cols = [np.array(node, dtype=np.uint64).view(np.int64), np.array(entry, dtype=np.int64)]
        cols += [np.array(depth, dtype=np.int32), np.array(left, dtype=np.int32)]
        batch = pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array(step, pa.int32())], names=names)
        for x in (node, entry, depth, left, step):
            x.clear()
        return batch

    for batch in batches:
        for k, path, back in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            first = _half(len(path), back)
            h = xxhash.xxh64(path[:first].encode(), seed=int(back))
            for d in range(first, len(path) + 1):
                node.append(h.intdigest())
                entry.append(k)
                depth.append(d)
                left.append(len(path) - d)
                if d < len(path):
                    step.append(ord(path[d]))
                    h.update(path[d].encode())
                else:
                    step.append(None)
            if len(node) >= PREFIXES:
                yield out()
    if node:
        yield out()


def trie(vocab: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The trie's edges and the states to start from.

    Edges: (node, first, rest, size, child, shortest, longest, end, end_n): the label is ``first`` and ``rest``, of
    ``size`` code points; paths behind the child have ``shortest`` to ``longest`` more; ``end`` is the word that ends at
    the child and end_n its count. States: (word, back, n, tail, own, node, edits), where the position is what ``tail``
    leaves of the word and ``own`` its next code point.
    """
    entries = save(_entered(vocab).withColumn("entry", F.monotonically_increasing_id()), "entries")
    steps = save(
        entries.select("entry", "path", "back").mapInArrow(
            _prefixes, "node long, entry long, depth int, left int, next int"
        ),
        "prefixes",
    )
    nodes = (
        steps.groupBy("node")
        .agg(
            F.count("*").alias("members"),
            F.min("next").alias("low"),
            F.max("next").alias("high"),
            F.min("left").alias("shortest"),
            F.max("left").alias("longest"),
        )
        .filter("shortest = 0 OR low <> high")
        .select("node", "members", "shortest", "longest")
    )
    nodes = save(nodes, "nodes")
    marked = attach(steps.select("node", "entry", "depth"), nodes, "node", "members")
    stop = F.struct("depth", "node", "shortest", "longest")
    stops = marked.groupBy("entry").agg(F.array_sort(F.collect_list(stop)).alias("stops"))
    walked = save(entries.join(stops, "entry").filter(F.size("stops") > 1), "stops")  # at most one stop per code point
    discard(steps, nodes, entries)
    legs = F.transform(
        F.slice("stops", 1, F.size("stops") - 1),
        lambda s, i: F.struct(
            s["node"].alias("node"),
            F.substring(F.col("path"), s["depth"] + 1, F.lit(1)).alias("first"),
            F.substring(F.col("path"), s["depth"] + 2, F.get("stops", i + 1)["depth"] - s["depth"] - 1).alias("rest"),
            (F.get("stops", i + 1)["depth"] - s["depth"]).alias("size"),
            F.get("stops", i + 1).alias("to"),
            (i + 2 == F.size("stops")).alias("last"),
        ),
    )
    edges = (
        walked.select("path", "n", F.explode(legs).alias("e"))
        .groupBy(
            "e.node", "e.first", "e.rest", "e.size", F.col("e.to.node").alias("child"), "e.to.shortest", "e.to.longest"
        )
        .agg(
            F.max(F.when(F.col("e.last"), F.col("path"))).alias("end"),
            F.max(F.when(F.col("e.last"), F.col("n"))).alias("end_n"),
        )
    )
    start = F.col("stops")[0]
    states = walked.select(
        F.col("path").alias("word"),
        "back",
        "n",
        _from(F.col("path"), start["depth"]).alias("tail"),
        F.substring(F.col("path"), start["depth"] + 1, F.lit(1)).alias("own"),
        start["node"].alias("node"),
        F.lit(0).alias("edits"),
    )
    return save(edges, "edges"), save(states, "frontier")


def _from(text: Column, position: Column) -> Column:
    """What follows the first ``position`` code points."""
    return F.substring(text, position + 1, F.char_length(text))


def _met(frontier: DataFrame, edges: DataFrame) -> DataFrame:
    """Every state with the edges of its node, one with its edit behind it with the edge that its word takes only.

    A node has one edge per code point, so hot nodes' edges are few.
    """
    on = (F.col("s.node") == F.col("e.node")) & ((F.col("s.edits") == 0) | (F.col("s.own") == F.col("e.first")))

    def meet(states: DataFrame, ways: DataFrame) -> DataFrame:
        return states.alias("s").join(ways.alias("e"), on).drop(F.col("e.node"))

    sizes = frontier.groupBy("node").agg(F.count("*").alias("states"))
    total, most = sizes.agg(F.sum("states"), F.max("states")).first()
    if (most or 0) < HOT_STATES:
        return meet(frontier, edges)
    # At most HOT_SHARE nodes, each with at most one edge per letter.
    hot = sizes.filter(F.col("states") > F.greatest(F.lit(HOT_STATES), F.lit(total / HOT_SHARE))).select("node")
    rest = meet(frontier.join(F.broadcast(hot), "node", "left_anti"), edges)
    return meet(frontier, F.broadcast(edges.join(F.broadcast(hot), "node", "left_semi"))).unionByName(rest)


def _advance(met: DataFrame) -> DataFrame:
    """The states that follow from states met with edges, those at an end included: with end and end_n."""
    tail, rest, size = F.col("tail"), F.col("rest"), F.col("size")
    after = F.substring(tail, F.lit(2), F.char_length(tail))
    fresh, same = F.col("edits") == 0, F.col("first") == F.col("own")
    follows = same & F.startswith(after, rest)
    # Of a pair that differs in a code point, the word with the larger one makes the step.
    replaces = fresh & (F.col("first") < F.col("own")) & F.startswith(after, rest)
    deletes = fresh & ~same & F.startswith(after, F.concat("first", "rest"))

    def state(when: Column, used: Column, edits: Column) -> Column:
        left = F.char_length(tail) - used
        fits = left.between(F.col("shortest"), F.col("longest")) | (edits == 0)
        return F.when(when & fits, F.struct(used.alias("used"), edits.alias("edits")))

    # Following and replacing exclude each other; only a deletion may come beside a replacement.
    one = state(follows | replaces, size, F.when(same, F.col("edits")).otherwise(1))
    moves = F.array_compact(F.array(one, state(deletes, size + 1, F.lit(1))))
    moved = met.select("word", "back", "n", "tail", F.explode(moves).alias("m"), "child", "end", "end_n")
    left = _from(tail, F.col("m.used"))
    return moved.select(
        "word", "back", "n", left.alias("tail"), F.substring(left, 1, 1).alias("own"), F.col("child").alias("node"),
        "m.edits", "end", "end_n",
    ).filter("tail <> '' OR edits = 1")


def near_words(vocab: DataFrame) -> DataFrame:
    """(word, n, near, near_n): all pairs of words exactly one edit apart, both ways."""
    edges, frontier = trie(vocab)
    found = []
    # A word whose last code point is deleted ends at a node of its own path, which no edge leads to.
    short = vocab.select(F.col("word").alias("w"), F.col("n").alias("w_n"), F.col("word").alias("near"))
    for back in (False, True):
        cut = F.substring("word", F.lit(2), F.char_length("word")) if back else F.substring("word", F.lit(1), F.char_length("word") - 1)
        found.append(
            vocab.select("word", "n", cut.alias("near"))
            .join(short.select("near", F.col("w_n").alias("near_n")), "near")
            .select("word", "n", "near", "near_n")
        )
    while frontier.head(1):
        after = save(_advance(_met(frontier, edges)), "states")
        text = F.when(F.col("back"), F.reverse("word")).otherwise(F.col("word"))
        other = F.when(F.col("back"), F.reverse("end")).otherwise(F.col("end"))
        done = after.filter("tail = '' AND end IS NOT NULL")
        found.append(done.select(text.alias("word"), "n", other.alias("near"), F.col("end_n").alias("near_n")))
        frontier = after.filter("tail <> ''").drop("end", "end_n")
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    pairs = pairs.filter(F.levenshtein("word", "near") == 1)
    back = pairs.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    return pairs.unionByName(back).distinct()


def roots(links: DataFrame) -> DataFrame:
    """(word, root): the last word reached by following (word, form), for every word of ``links``, by pointer doubling.

    A form's count is at least twice its word's, so paths end and their number of steps is at most log2 of the largest
    count; each round halves what is left.
    """
    state = save(links.select("word", F.col("form").alias("to"), F.lit(True).alias("open")), "roots")
    while state.filter("open").head(1):
        far = state.select(F.col("word").alias("to"), F.col("to").alias("further"))
        now = state.filter("open").join(far, "to", "left")
        step = now.select("word", F.coalesce("further", "to").alias("to"), F.col("further").isNotNull().alias("open"))
        state = save(step.unionByName(state.filter("NOT open")), "roots")
    return state.select("word", F.col("to").alias("root"))


def spelling_variants(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """op11: one row per word: word, form, root, n, n_near, form_n.

    A null text has no words, a null id counts as the empty string, rows that repeat an id count each. An empty table,
    or one without frequent words, gives an empty result. Other columns are not read. Ties between near words of equal
    count go to the smallest one in code-point order.
    """
    vocab = save(vocabulary(docs, id, text), "vocabulary")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form")))
    near = near_words(vocab).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("b"))
    joined = vocab.join(near, "word", "left")
    takes = -F.col("b.less") >= 2 * F.col("n")
    formed = save(
        joined.select(
            "word",
            F.when(takes, F.col("b.form")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(takes, -F.col("b.less")).alias("form_n"),
        ),
        "forms",
    )
    last = roots(formed.filter("form IS NOT NULL").select("word", "form"))
    return formed.join(last, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


SPELLING_SQL = r"""
WITH RECURSIVE runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS r FROM documents)
  GROUP BY ALL),
-- CRC-32, bit by bit.
summed AS (
  SELECT run, n, xor(4294967295, list_reduce(
    list_prepend(4294967295, [('0x' || s[2 * i - 1 : 2 * i])::BIGINT FOR i IN range(1, len(s) // 2 + 1)]),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
                             lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))) AS h
  FROM (SELECT run, n, hex(encode(id || ':' || run)) AS s FROM runs)),
words AS (
  SELECT w AS word, sum(n)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS w, n
    FROM summed)
  WHERE length(w) >= 5 GROUP BY w HAVING sum(n) >= 3),
-- Words that share a pattern with one code point blanked or left out differ by one edit at most.
spots AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
blanked AS (SELECT word, n, left(word, i - 1) || '*' || substr(word, i + 1) AS p FROM spots),
shorter AS (SELECT word, n, left(word, i - 1) || substr(word, i + 1) AS p FROM spots),
near AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM blanked a JOIN blanked b ON a.p = b.p AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM shorter a JOIN words b ON a.p = b.word
  UNION SELECT b.word, a.word, a.n FROM shorter a JOIN words b ON a.p = b.word),
best AS (SELECT word, count(*) AS n_near, max(near_n) AS near_n FROM near GROUP BY word),
forms AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near,
    CASE WHEN b.near_n >= 2 * w.n THEN b.near_n END AS form_n,
    CASE WHEN b.near_n >= 2 * w.n THEN (SELECT min(x.near) FROM near x WHERE x.word = w.word AND x.near_n = b.near_n) END AS form
  FROM words w LEFT JOIN best b USING (word)),
paths AS (
  SELECT word, word AS root FROM forms WHERE form IS NULL
  UNION ALL SELECT f.word, p.root FROM forms f JOIN paths p ON f.form = p.word)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN paths USING (word)
"""
