"""What the similarity joins move: a set's bitmap once per part, and results equal to brute force."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from mnemolake.operators import similarity


def _rows(n: int, seed: int) -> list[tuple[int, list[str]]]:
    rng = random.Random(seed)
    out: list[tuple[int, list[str]]] = []
    for i in range(n):
        if i % 3 and out:
            words = set(rng.choice(out)[1])
            for _ in range(rng.randint(0, 30)):
                words.discard(rng.choice(sorted(words)))
                words.add(f"w{rng.randint(0, 400)}")
        else:
            words = {f"w{rng.randint(0, 400)}" for _ in range(rng.randint(1, 120))}
        out.append((i, sorted(words)))
    return out


def _alike(x: list[str], y: list[str]) -> float:
    return len(set(x) & set(y)) / len(set(x) | set(y))


@pytest.mark.parametrize("threshold", [0.5, 0.7, 0.85])
def test_joins_equal_brute_force(spark, threshold):
    rows = _rows(120, 7)
    df = spark.createDataFrame(rows, "rep long, words array<string>")
    want = {(i, j): _alike(x, y) for i, x in rows for j, y in rows if i < j and _alike(x, y) >= threshold}
    got = {(r.a, r.b): r.similarity for r in similarity.jaccard_pairs(df, threshold).collect()}
    assert got == want
    hashed = df.withColumn("words", similarity.hashes(F.col("words")))
    assert {(r.a, r.b): r.similarity for r in similarity.jaccard_pairs(hashed, threshold).collect()} == want
    sides = [df.withColumnRenamed("rep", "id").filter(F.col("rep") % 2 == k) for k in (0, 1)]
    both = {(r.a, r.b) for r in similarity.jaccard_matches(*sides, threshold).collect()}
    assert both == {(i, j) for i, x in rows for j, y in rows if i % 2 == 0 and j % 2 and _alike(x, y) >= threshold}


def test_a_set_takes_its_bitmap_to_each_part_once(spark):
    rows = [(i, sorted({f"w{k}" for k in range(i, i + 900)})) for i in range(6)]
    sets = similarity._hashed(spark.createDataFrame(rows, "id long, words array<string>"))
    counts = spark.sparkContext.broadcast(similarity._sketch(sets))
    found = similarity._prefixes(sets, counts, 0.7, parts=16).collect()
    assert len({(r.node, r.part) for r in found}) == len(found) <= 6 * 16
    assert sum(len(r.marks) for r in found) > 6 * 200  # the prefix itself is whole


def _sequential(matches):
    taken, out = set(), {}
    for a in sorted({m[0] for m in matches}):
        options = sorted((-s, b) for x, b, s in matches if x == a and b not in taken)
        if options:
            out[a] = options[0][1]
            taken.add(options[0][1])
    return out


@pytest.mark.parametrize("last", [0, 20, 100_000])
def test_matching_in_rounds_and_in_one_walk_is_the_sequential_one(spark, last):
    rng = random.Random(5)
    matches = [(a, b, rng.choice([0.85, 0.9, 1.0])) for a in range(12) for b in range(100, 112) if rng.random() < 0.3]
    df = spark.createDataFrame(matches, "a long, b long, similarity double")
    assert {r.a: r.b for r in similarity.greedy_one_to_one(df, last).collect()} == _sequential(matches)
    assert similarity.greedy_one_to_one(df.limit(0), last).collect() == []


def test_a_family_of_rivals_is_matched_in_one_walk(spark, monkeypatch):
    # Every left row wants the same right rows in the same order: refused one at a time, a round each.
    rounds = []
    kept = similarity.best_match
    monkeypatch.setattr(similarity, "best_match", lambda m: rounds.append(1) or kept(m))
    matches = [(a, 100 + b, 1.0 - b / 1000) for a in range(30) for b in range(30)]
    df = spark.createDataFrame(matches, "a long, b long, similarity double")
    got = {r.a: r.b for r in similarity.greedy_one_to_one(df).collect()}
    assert got == {a: 100 + a for a in range(30)} and len(rounds) < 5


def test_rows_without_an_id_match_nothing(spark):
    df = spark.createDataFrame([(None, 1, 0.9), (1, None, 0.9), (2, 3, 0.9)], "a long, b long, similarity double")
    assert [(r.a, r.b) for r in similarity.greedy_one_to_one(df, 0).collect()] == [(2, 3)]


def test_contained_words_looks_at_pairs_with_a_rare_word(spark):
    """Against brute force, with repeated and missing ids; common words alone bring no pair together."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(40)]
    items = [(i % 9, sorted(rng.sample(words, rng.randint(1, 6)))) for i in range(12)] + [(None, ["w1"])]
    docs = [(i if i % 10 else 5, sorted(rng.sample(words, rng.randint(0, 30)))) for i in range(60)] + [(None, words), (None, ["w2"])]
    q = spark.createDataFrame(items, "item_id long, words array<string>")
    d = spark.createDataFrame(docs, "doc_id long, words array<string>")
    want: dict = {}
    for i, x in items:
        for j, y in docs:
            want[i, j, len(x)] = want.get((i, j, len(x)), 0) + len(set(x) & set(y))
    got = {(r.item_id, r.doc_id, r.size): r.common for r in similarity.contained_words(q, d, 0.8).collect()}
    assert got == {k: n for k, n in want.items() if n and n / k[2] >= 0.8}
