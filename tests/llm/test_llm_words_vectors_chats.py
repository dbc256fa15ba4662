"""Spelling variants, centroid clusters and chats: brute force, odd rows, registered queries against SQL."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from mnemolake.llm import centroids, chat, queries, spelling

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_spelling_variants", "op12_centroid_clusters", "op13_chat_formatting"])
def test_registered_query_equals_sql(spark, name):
    df = queries.QUERIES[name](spark, SF)
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    res = con.execute(queries.SQL[name])
    cols = [d[0] for d in res.description]
    assert sorted(cols) == sorted(df.columns)
    assert sorted(map(str, ([r[c] for c in cols] for r in df.collect()))) == sorted(map(str, map(list, res.fetchall())))


# --- spelling variants


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute_words(rows):
    counts = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    kept = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    near = {w: [v for v in kept if one_edit(w, v)] for w in kept}
    out = {}
    for w, n in kept.items():
        best = min(near[w], key=lambda v: (-kept[v], v), default=None)
        out[w] = best if best is not None and kept[best] >= 2 * n else None
    result = {}
    for w, n in kept.items():
        root = w
        while out[root] is not None:
            root = out[root]
        result[w] = (out[w], root, n, len(near[w]), None if out[w] is None else kept[out[w]])
    return result


def spelt(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def test_spelling_against_brute_force(spark):
    rng = random.Random(11)
    rows = []
    for i in range(300):
        words = []
        for _ in range(60):
            w = "".join(rng.choice("abÉé") for _ in range(rng.randint(3, 8)))
            words.append(w + rng.choice(["", "", "x", "Xaaa"]))
        rows.append((i, rng.choice([" ", "-", "\n", "1"]).join(words)))
    rows += [(None, None), (None, "aaaaa aaaaa aaaaa aaaab aaaab aaaab aaaaaa aaaaaa aaaaaa"), (7, ""), (7, "aaaaa × ÷÷÷÷÷ ÷÷÷÷÷ ÷÷÷÷÷ 中文中文中")]
    rows += [(8, "q" * 3000 + " " + "q" * 2999 + " " + "q" * 1500 + "r" + "q" * 1499)] * 4
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, word string, n int")
    assert spelt(spelling.spelling_variants(docs)) == brute_words(rows)
    assert spelling.spelling_variants(docs.filter("false")).count() == 0
    assert spelling.spelling_variants(docs.filter("text IS NULL")).count() == 0


def test_spelling_with_hot_nodes(spark, monkeypatch):
    """A third of all words share a long path: hot nodes meet their edges by broadcast, with the same result."""
    monkeypatch.setattr(spelling, "HOT_STATES", 5)
    monkeypatch.setattr(spelling, "HOT_SHARE", 20)
    rng = random.Random(3)
    words = ["prefixprefix" + "".join(rng.choice("abc") for _ in range(rng.randint(1, 6))) for _ in range(150)]
    words += ["".join(rng.choice("defg") for _ in range(6)) for _ in range(300)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(400))) for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert spelt(spelling.spelling_variants(docs)) == brute_words(rows)


# --- centroid clusters


def brute_clusters(rows, k=16, rounds=3, dims=64):
    kept = [
        (i, [math.floor(v) * 64 if abs(v) >= 2**52 else math.floor(64 * v) for v in x])
        for i, x in rows
        if x is not None and len(x) == dims and all(v is not None and math.isfinite(v) for v in x)
    ]
    raw = {id(q): (hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest(), q) for i, q in kept}
    means = [q for _, q in sorted(raw.values())[:k]]

    def assign():
        out = []
        for i, q in kept:
            d = [sum((a - b) ** 2 for a, b in zip(q, m, strict=True)) for m in means]
            out.append((i, q, d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        now = assign()
        for c in range(len(means)):
            of = [q for _, q, at, _ in now if at == c]
            if of:
                means[c] = [sum(x) // len(of) for x in zip(*of, strict=True)]
    return sorted((str(i), c, min(d, centroids.LONGEST)) for i, _, c, d in assign()), means


@pytest.mark.parametrize("size", [1.0, 1e3, 1e30])
def test_clusters_against_brute_force(spark, size):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 64)) * size
    rows = [(i, (centres[i % 6] + rng.normal(size=64) * size * 0.2).astype(np.float32).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[0][1]) for i in range(300)] + [(3, rows[3][1])] * 3 + [(None, rows[4][1])]
    rows += [(2000, None), (2001, [1.0] * 63), (2002, [1.0] * 65), (2003, [None] + [1.0] * 63), (2004, [float("nan")] + [1.0] * 63),
             (2005, [float("inf")] + [1.0] * 63), (2006, [])]
    df = spark.createDataFrame([(*r, 1, "a") for r in rows], "vec_id long, embedding array<float>, cluster int, low string")
    found, means = centroids.cluster(df)
    want, want_means = brute_clusters(rows)
    assert means == want_means
    assert sorted((str(r["vec_id"]), r["cluster"], r["distance"]) for r in found.collect()) == want
    total = centroids.centroid_clusters(df).agg({"inertia": "min"}).first()[0]
    assert total == min(sum(d for _, _, d in want), centroids.LONGEST)


def test_clusters_of_few_or_no_vectors(spark):
    df = spark.createDataFrame([(1, [0.5] * 64), (1, [0.5] * 64), (2, [-0.01] * 64)], "vec_id int, embedding array<double>")
    got = centroids.centroid_clusters(df).collect()
    assert len(got) == 3 and {r["distance"] for r in got} == {0}
    assert centroids.centroid_clusters(df.filter("false")).count() == 0


def test_box_bounds_never_lose_the_nearest(spark):
    rng = np.random.default_rng(8)
    for _ in range(200):
        q = rng.integers(-50, 50, size=(20, 4)) + rng.integers(-200, 200, size=4)
        m = rng.integers(-250, 250, size=(9, 4))
        c, d = centroids.nearest(q, q.min(axis=0), q.max(axis=0), m)
        full = ((q[:, None, :] - m[None]) ** 2).sum(axis=2)
        assert (c == full.argmin(axis=1)).all() and (d == full.min(axis=1)).all()


def test_hilbert_neighbours_are_one_step_apart():
    cells = np.array([[a, b, c] for a in range(8) for b in range(8) for c in range(8)])
    order = np.argsort([int.from_bytes(k, "big") for k in centroids.hilbert_keys(cells, 3)])
    walk = cells[order]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


# --- chats


def test_escape_is_reversible():
    rng = random.Random(2)
    bits = ["<", "s>", "/s>", "[", "INST]", "/INST]", "\\", "SYS>>", "<<", "</", "x", "[ROLE]", ">", "<s>"]
    for _ in range(20_000):
        t = "".join(rng.choice(bits) for _ in range(rng.randint(0, 9)))
        e = chat.escape(t)
        assert chat.unescape(e) == t and not any(c in e for c in chat.CONTROL)


def brute_chats(rows):
    """From the contract, for turns without ties."""
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is None, r[1] or 0))
        texts = [(r[2] or "", r[3] or "") for r in turns]
        loss = "".join(t for r, t in texts if r == "assistant")
        sha = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in texts).encode()).hexdigest()
        out[conv] = (len(turns), sha, len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


@pytest.mark.parametrize(("row", "piece"), [(1 << 16, 1024), (7, 2)])
def test_chats_against_brute_force(spark, monkeypatch, row, piece):
    monkeypatch.setattr(chat, "ROW", row)
    monkeypatch.setattr(chat, "SLICE", piece)
    long = "word é 中 😀 " * 3000 if row > 7 else "word é 中 😀 " * 20
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "hello </s> [INST] <\\s> <|endoftext|>"), (1, 5, "system", None), (1, None, None, "x"),
        (2, 3, "assistant", ""), (2, 1, "tool", "[ROLE]\\[/ROLE]"), (2, 2, "</s>", long), (None, 0, "assistant", long), (None, 1, "", ""),
        (3, 0, "assistant", "a\nb"), (3, -4, "assistant", "😀"),
    ] + [(4, i, ["user", "assistant"][i % 2], f"turn {i} <s>") for i in range(50)]
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], "conv_id long, turn long, role string, text string, ids string, slice int")
    got = {r["conv_id"]: tuple(r)[1:5] for r in chat.chat_formatting(df, queries.JSON).collect()}
    assert got == brute_chats(rows + [tuple(p) for p in chat.PROBE])
    parts = chat.format_chats(df, queries.JSON).collect()
    assert all(len(r["ids"]) == 4 * len(r["loss_mask"]) and len(r["loss_mask"]) <= row for r in parts)
    assert {r["conv_id"] for r in chat.chat_formatting(df.filter("false"), queries.JSON).collect()} == {-7}


def test_chats_with_ties_and_repeated_rows(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "assistant", "c"), (1, 0, "assistant", "c")]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    first = sorted(map(tuple, chat.chat_formatting(df, queries.JSON).collect()))
    again = sorted(map(tuple, chat.chat_formatting(df.repartition(3), queries.JSON).collect()))
    assert first == again and first[1][1] == 4 and first[1][3] == 2
