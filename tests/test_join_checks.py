"""How the Jaccard join checks the pairs that meet: bitmaps at a low threshold, and tiles where pairs are many."""

from __future__ import annotations

import random

from mnemolake.catalog import concept_queries
from mnemolake.operators import similarity


def _alike(x, y):
    return len({*x} & {*y}) / len({*x} | {*y})


def test_unrelated_sets_close_to_a_low_threshold_do_not_leave_the_task(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(340)]
    rows = [(i, sorted(rng.sample(words, 200))) for i in range(60)]
    rows += [(100 + i, sorted({*rows[i][1][10:]} | {f"v{i}"})) for i in range(10)]
    want = {(i, j) for i, x in rows for j, y in rows if i < j and _alike(x, y) >= 0.5}
    reps = spark.createDataFrame(rows, "rep long, words array<string>")
    sets = similarity._hashed(reps.withColumnRenamed("rep", "id"))
    counts = spark.sparkContext.broadcast(similarity._sketch(sets))
    met = similarity._meeting(similarity._prefixes(sets, counts, 0.5), 0.5, False).count()
    assert len(want) <= met < len(want) + 300  # of 2415 pairs, which narrow bitmaps let through nearly all
    assert {(r.a, r.b) for r in similarity.jaccard_pairs(reps, 0.5).collect()} == want


def test_pairs_checked_in_tiles_equal_brute_force(spark, monkeypatch):
    """A family whose sets are in very many pairs, with ids that are not numbers; sizes from one word to hundreds."""
    rng = random.Random(6)
    base = [f"w{i}" for i in range(40)]
    rows = [(f"n{i}", sorted({*rng.sample(base, rng.randint(24, 40)), f"x{i}"})) for i in range(70)]
    rows += [("one", ["w1"]), ("long", [f"z{i}" for i in range(500)]), ("longer", [f"z{i}" for i in range(520)])]
    want = {(min(i, j), max(i, j)): _alike(x, y) for i, x in rows for j, y in rows if i < j and _alike(x, y) >= 0.5}
    assert len(want) > 3 * len(rows)
    terms = sum(len(x) for _, x in rows)
    calls = []
    kept = similarity._in_tiles
    monkeypatch.setattr(similarity, "_in_tiles", lambda *a: calls.append(a[3]) or kept(*a))
    monkeypatch.setattr(similarity, "GROUPS", 1)
    monkeypatch.setattr(similarity, "GROUP_TERMS", terms // 3 + 1)
    reps = spark.createDataFrame(rows, "rep string, words array<string>")
    assert {(r.a, r.b): r.similarity for r in similarity.jaccard_pairs(reps, 0.5).collect()} == want
    sides = [reps.withColumnRenamed("rep", "id").filter(f"crc32(rep) % 2 = {k}") for k in (0, 1)]
    left = {r.id for r in sides[0].collect()}
    both = {(i, j) for pair in want for i, j in (pair, pair[::-1]) if i in left and j not in left}
    assert {(r.a, r.b) for r in similarity.jaccard_matches(*sides, 0.5).collect()} == both
    assert calls == [3, 3]


def test_communities_finds_its_pairs_once(spark, tmp_path, monkeypatch):
    rows = [(i, " ".join(f"w{i // 10}x{k}" for k in range(i % 10, 30))) for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = spark.sparkContext.accumulator(0)
    kept = concept_queries.document_pairs

    def counted(*args):
        pairs = kept(*args)

        def run(batches):
            for batch in batches:
                found.add(batch.num_rows)
                yield batch

        return pairs.mapInArrow(run, pairs.schema)

    monkeypatch.setattr(concept_queries, "document_pairs", counted)
    assert {(r.component, r.size) for r in concept_queries.communities(spark, str(tmp_path)).collect()} == {(0, 10), (10, 10), (20, 10), (30, 10)}
    assert found.value == 4 * 45


def test_small_buckets_take_all_rounds_in_one_task(spark, monkeypatch):
    """The links are those of rounds over whole tables, ids that come with two sets included."""
    rng = random.Random(9)
    rows = []
    for f in range(3):
        base = [f"f{f}w{i}" for i in range(30)]
        for _ in range(14):
            rows.append((f"n{len(rows)}", sorted({*rng.sample(base, 28), *(f"x{rng.randrange(99)}" for _ in range(rng.randrange(3)))})))
    rows += [("n1", rows[3][1]), ("n5", rows[20][1]), ("one", ["w"])]
    reps = spark.createDataFrame(rows, "rep string, words array<string>").coalesce(1)

    def links(most):
        monkeypatch.setattr(similarity, "BUCKET", most)
        return sorted((r.a, r.b, r.similarity) for r in similarity.lsh_links(reps, 0.85).collect())

    want = links(8)
    kept = similarity._verify
    monkeypatch.setattr(similarity, "_verify", lambda *a: 1 / 0)
    assert links(4096) == want and len(want) > 20
    monkeypatch.setattr(similarity, "_verify", kept)
    assert links(1) == want
