"""Matching of two stores whose texts come more than once."""

from __future__ import annotations

import random
import re

import pytest

from mnemolake.operators import similarity


def _sequential(left, right, threshold=0.85):
    """What a pass over the left ids takes, each its best free right id; a row that repeats an id has all its texts."""

    def sets(rows):
        out: dict = {}
        for i, text in rows:
            if i is not None and (words := frozenset(re.findall("[a-z0-9]+", (text or "").lower()))):
                out.setdefault(i, set()).add(words)
        return out

    a, b, taken, out = sets(left), sets(right), set(), []
    for i in sorted(a):
        alike = ((-max(len(x & y) / len(x | y) for x in a[i] for y in b[j]), j) for j in sorted(b) if j not in taken)
        best = min(alike, default=(0, None))
        if -best[0] >= threshold:
            taken.add(best[1])
            out.append((i, best[1], -best[0]))
    return out


def _matched(spark, left, right, **more):
    schema = "memory_id long, content string"
    found = similarity.diff_stores(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), 0.85)
    return sorted((r.a, r.b, r.similarity) for r in found.collect())


def test_every_copy_is_matched(spark):
    text = " ".join(f"w{i}" for i in range(20))
    left = [(1, text), (2, text), (3, text + " more"), (4, text), (9, "alone")]
    right = [(10, text), (11, text.upper()), (12, text + " more"), (13, text + " other"), (14, None), (None, text)]
    got = _matched(spark, left, right)
    assert [(a, b) for a, b, _ in got] == [(1, 10), (2, 11), (3, 12), (4, 13)]
    assert got == _sequential(left, right)


@pytest.mark.parametrize("last", [60, 100_000])
def test_copies_against_the_sequential_pass(spark, monkeypatch, last):
    """Families of copies and near copies, ids that come twice with one text or with two, null ids and texts."""
    monkeypatch.setattr(similarity.match_rows, "__defaults__", (last,))
    rng = random.Random(8)
    texts = []
    for f in range(6):
        base = [f"f{f}w{i}" for i in range(30)]
        texts += [" ".join(base)] + [" ".join(rng.sample(base, rng.randint(26, 30)) + [f"x{f}{k}"] * (k % 2)) for k in range(5)]
    rows = [(rng.randrange(400), rng.choice(texts)) for _ in range(160)] + [(401, None), (402, ""), (None, texts[0])]
    rows += rows[:10]
    cut = [rng.random() < 0.5 for _ in rows]
    left = [r for r, c in zip(rows, cut, strict=True) if c]
    right = [r for r, c in zip(rows, cut, strict=True) if not c]
    want = _sequential(left, right)
    assert len(want) > 40
    assert _matched(spark, left, right) == want
