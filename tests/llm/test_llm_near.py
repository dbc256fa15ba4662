"""Near copies by shingle similarity: shared passages, tiles, odd rows."""

from __future__ import annotations

import numpy as np
import pytest

from mnemolake.llm import jaccard_dedup as jd
from mnemolake.llm import simhash

from test_llm_documents import lowest_of_similar


def kept(spark, table):
    docs = spark.createDataFrame(list(table.items()), "doc_id long, text string").repartition(4)
    return {r.doc_id for r in jd.near_dedup(docs).select("doc_id").collect()}


def passages(rng, n, common=120, own=80):
    """Documents that share a long passage and differ in the rest."""
    words = np.array([f"w{i}" for i in range(50_000)])
    head = rng.choice(words, common)
    return {i: " ".join(np.r_[head, rng.choice(words, own)]) for i in range(n)}


@pytest.mark.parametrize("tile", [4096, 7])
def test_combined_passages_against_all_pairs(spark, monkeypatch, tile):
    """Documents put together from few passages: no shingle is rare, and some are similar only to some."""
    monkeypatch.setattr(jd, "TILE", tile)
    rng = np.random.default_rng(3)
    words = np.array([f"w{i}" for i in range(3000)])
    pieces = [rng.choice(words, n) for n in (30, 30, 30, 12, 12, 9, 60, 60)]
    table = {}
    for i in range(300):
        some = rng.choice(len(pieces), rng.integers(2, 6), replace=False)
        table[i] = " ".join(np.concatenate([*(pieces[k] for k in sorted(some)), rng.choice(words, rng.integers(0, 12))]))
    want = lowest_of_similar(table)
    assert 10 < len(want) < 290
    assert kept(spark, table) == want


def test_shared_passage_makes_few_candidates(spark):
    """Twice the documents with one passage in common make no more than about twice the checked pairs."""
    rng = np.random.default_rng(4)
    for n in (300, 600):
        table = passages(rng, n)
        table[n] = table[0] + " more"
        docs = spark.createDataFrame(list(table.items()), "doc_id long, text string").repartition(4)
        prints = jd.filed(docs, jd.sketch(docs)).cache()
        rows = jd.shared_rows(prints.selectExpr("explode(sigs) AS sig", "node", "size"))
        assert rows.count() < 8 * n
        assert kept(spark, table) == set(range(n))


def test_profile_bounds_the_difference():
    rng = np.random.default_rng(6)
    for n in (1, 5, 80, 3000):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(3))
        b = np.unique(np.r_[a[: n // 2], rng.integers(0, 1 << 63, n // 3, dtype=np.uint64) * np.uint64(3)])
        pa, pb = (np.frombuffer(jd.profile(x), np.uint8).astype(int) for x in (a, b))
        assert np.abs(pa - pb).sum() <= len(np.setxor1d(a, b))


def test_odd_rows(spark):
    """Null ids and texts, repeated rows, blank, short and very long texts, clashing names, an empty table."""
    long = " ".join(f"x{i % 9973}" for i in range(30_000))
    rows = [
        (1, "a b c d e f", "p"), (1, "a b c d e f", "p"), (2, "A b C d e f", "q"), (3, None, "r"), (4, "", "s"), (5, " \t\n", "t"),
        (None, "one two three", "u"), (None, "one two three", "u"), (6, "one two three", "v"), (7, long, "w"), (8, long + " end", "x"),
        (9, "éa b", "y"), (9, "other text", "z"),
    ]
    schema = "doc_id long, text string, component_id string"
    out = jd.near_dedup(spark.createDataFrame(rows, schema))
    assert out.columns == ["doc_id", "text", "component_id"]
    got = sorted((r.doc_id or 0, r.component_id) for r in out.collect())
    assert got == [(0, "u"), (0, "u"), (1, "p"), (1, "p"), (3, "r"), (6, "v"), (7, "w"), (9, "y"), (9, "z")]
    groups = {(r.doc_id, r.component_id) for r in jd.near_groups(spark.createDataFrame(rows, schema)).collect()}
    assert {(2, 1), (4, 3), (5, 3), (None, 6), (8, 7)} <= groups
    nothing = spark.createDataFrame([], schema)
    assert jd.near_dedup(nothing).count() == 0 and jd.near_groups(nothing).count() == 0


def test_fingerprints_link_before_shingles(spark):
    """The links by SimHash span what all pairs of fingerprints within four bits join; blank texts take no part."""
    rng = np.random.default_rng(11)
    words = np.array([f"w{i}" for i in range(3000)])
    texts = [""] * 2
    for _ in range(8):
        base = rng.choice(words, 900)
        for step in range(5):
            copy = base.copy()
            copy[rng.integers(0, 900, step)] = rng.choice(words, step)
            texts.append(" ".join(copy))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = jd.filed(docs, jd.sketch(docs)).collect()
    nodes = spark.createDataFrame([(r.node, r.text_hash, r.size) for r in {r.node: r for r in rows}.values()], "node long, text_hash long, size int")
    fps = {r.node: simhash.fingerprint(texts[r.doc_id]) for r in rows if r.size}
    got = [(r.a, r.b) for r in jd.linked_prints(docs, nodes).collect()]
    want = [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 4]

    def parts(pairs):
        root = {n: n for n in fps}
        for a, b in pairs:
            x, y = root[a], root[b]
            root = {n: min(x, y) if r in (x, y) else r for n, r in root.items()}
        return root

    assert want and parts(got) == parts(want)
    assert all(a < b for a, b in got) and len(got) < 2 * len(fps)
