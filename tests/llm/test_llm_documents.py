"""The registered queries over the smallest documents table, against brute force or their SQL."""

import base64
import hashlib
import re
import zlib
from collections import Counter
from math import isclose, log10

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from tokenizers import Tokenizer

from mnemolake.llm import queries

SF = "/root/testdata/sf0.001"
BLANK = "[\x20\x09-\x0d]+"


@pytest.fixture(scope="module")
def texts():
    rows = duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{SF}/documents.parquet' ORDER BY 1").fetchall()
    return dict(rows)


@pytest.fixture(scope="module")
def ids(texts):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    return {i: np.array([*tok.encode(t, add_special_tokens=False).ids, 0], dtype="<u4") for i, t in texts.items()}


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql_twin(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    want = con.execute(queries.SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted(want.fetchall()) == sorted(tuple(r) for r in got.select(*columns).collect())


def test_bpe_round_trip(spark, texts):
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in queries.op2_byte_bpe(spark, SF).collect()}
    assert set(got) == set(texts)
    for i, t in texts.items():
        want = np.array(enc.encode_ordinary(t), dtype="<u4")
        assert got[i].n_tokens == len(want)
        assert got[i].ids_sha256 == hashlib.sha256(want.tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_suffix_dedup(spark, texts):
    got = {r.doc_id: tuple(r) for r in queries.op3_suffix_dedup(spark, SF).collect()}
    seen = set()
    for i, t in sorted(texts.items()):
        raw = t.encode()
        covered = bytearray(len(raw))
        for p in range(len(raw) - 99):
            if raw[p : p + 100] in seen:
                covered[p : p + 100] = b"\1" * 100
            seen.add(raw[p : p + 100])
        kept = bytes(b for b, c in zip(raw, covered, strict=True) if not c)
        spans = len(re.findall(b"\1+", bytes(covered)))
        assert got[i] == (i, len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest())


def test_token_files(spark, ids):
    got = {r.doc_id: tuple(r) for r in queries.op6_rans_files(spark, SF).collect()}
    start = 0
    for i in sorted(ids):
        assert got[i] == (i, start, len(ids[i]), zlib.crc32(ids[i].tobytes()))
        start += len(ids[i])
    assert len(got) == len(ids)


def test_hmm_scores(spark, texts):
    rows = queries.op8_hmm_scores(spark, SF).collect()
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    words = {i: [*(w for w in re.split(BLANK, t.translate(low)) if w), None] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    count = Counter(w for i in texts if not held[i] for w in words[i])
    total = sum(count.values())
    assert {r.doc_id for r in rows} == set(texts)
    for r in rows:
        ws = words[r.doc_id]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held[r.doc_id], len(ws), total)
        assert r.n_known == sum(count[w] > 0 for w in ws)
        assert isclose(r.base_score, sum(log10((count[w] + 1) / (total + len(count) + 1)) for w in ws), rel_tol=1e-9)
    out = [r for r in rows if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_simhash_components(spark, texts):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op9_simhash_near_dedup(spark, SF).collect()}
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})

    def print_of(text):
        w = [x for x in re.split(BLANK, text.translate(low)) if x]
        grams = [" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))] if w else []
        hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if w else 0

    prints = {i: print_of(t) for i, t in texts.items()}
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    order = sorted(prints)
    for k, i in enumerate(order):
        for j in order[k + 1 :]:
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert got == {i: (f"{prints[i]:016x}", find(i)) for i in prints}


def check_pieces(rows, ids):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(ids)
    for i, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids[i]))
            assert r.ids_crc32 == zlib.crc32(ids[i][at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids[i])
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
        padding += 0 if at.bit_count() == 1 else 1024 - at
    return padding / (1024 * len(by_sequence))


def test_packing(spark, ids):
    assert check_pieces(queries.op10_cost_packing(spark, SF).collect(), ids) < 0.02


def test_weak_quality_on_labels(spark):
    rows = queries.op7_weak_quality(spark, "/root/testdata/sf0.01").collect()
    got = {r.doc_id: r for r in rows}
    labels = duckdb.sql("SELECT doc_id, quality, toxic FROM '/root/testdata/sf0.01/labels.parquet'").fetchall()
    size = dict(duckdb.sql("SELECT doc_id, len(string_split(text, ' ')) FROM '/root/testdata/sf0.01/documents.parquet'").fetchall())
    bad = [got[i].quality_score < 0.5 for i, q, _ in labels if q == 0]
    good = [got[i].quality_score >= 0.5 for i, q, _ in labels if q == 1 and size[i] >= 20]
    assert np.mean(bad) > 0.9 and np.mean(good) > 0.95
    assert np.mean([got[i].toxic_score < 0.5 for i, _, t in labels if t == 0]) > 0.95


def test_toxic_recall(spark):
    """Labelled toxic rows, listed insults in four languages and insults that no list holds."""
    from mnemolake.llm import weak_quality

    sf = "/root/testdata/sf0.01"
    labels = duckdb.sql(f"SELECT doc_id, toxic FROM '{sf}/labels.parquet'").fetchall()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    weights = weak_quality.fit(docs)
    got = {r.doc_id: r.toxic_score for r in weak_quality.score(docs, weights).collect()}
    # Rows are mislabelled on both sides, so a recall of one is out of reach.
    assert np.mean([got[i] >= 0.5 for i, t in labels if t == 1]) > 0.6
    listed = ["The man is a dimwit and all of that is vile.", "Der Mann ist ein Trottel und das ist widerlich.", "Cet homme est un abruti et un salaud.", "Este hombre es un imbécil y una escoria.", "What an 1diot, a m0ron, and stuuuupid."]
    other = ["You are such a nincompoop, nobody likes you.", "Du bist wirklich ein Dösbaddel, halt die Klappe.", "Espèce de cornichon, ferme-la.", "Pedazo de alcornoque, cállate ya.", "I will kill you when you come home."]
    calm = ["The committee met in the spring and agreed on the new plan for the school.", "Der Zug fährt um neun in die Stadt und kommt am Abend zurück.", "Le train part à neuf heures et revient le soir.", "El tren sale a las nueve y vuelve por la tarde.", "You can find your ticket in the app."]
    rows = [*listed, *other, *calm]
    assert not {w.strip(".,").lower() for t in other for w in t.split()} & set(weak_quality._WORDS)
    own = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    scores = [r.toxic_score for r in weak_quality.score(own, weights).orderBy("doc_id").collect()]
    assert [x >= 0.5 for x in scores] == [True] * 10 + [False] * 5


def test_pipeline(spark, ids, texts):
    import corpus_pipeline as p

    from mnemolake.session import save

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before, columns = docs, docs.columns
    sets = []
    for name, stage in p.STAGES[:-1]:
        after = save(stage(spark, before, SF), name)
        assert after.columns == columns
        sets.append({r.doc_id for r in after.select("doc_id").collect()})
        before = after
    verdict = {r.doc_id for r in queries.op4_quality_rules(spark, SF).filter("kept").collect()}
    assert sets[0] == verdict
    norm = {i: re.sub(BLANK, " ", texts[i]) for i in verdict}
    first = {}
    for i in sorted(verdict):
        first.setdefault(norm[i], i)
    assert sets[1] == set(first.values())
    assert sets[2] <= sets[1] and sets[3] == sets[2]
    final = {r.doc_id: r.text for r in before.collect()}
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: np.array([*tok.encode(t, add_special_tokens=False).ids, 0], dtype="<u4") for i, t in final.items()}
    check_pieces(p.STAGES[-1][1](spark, before, SF).collect(), want)


def lowest_of_similar(texts):
    """Ids that stay if of each component of five-word Jaccard 0.8 the smallest stays, by comparing all pairs."""
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets, holders = {}, {}
    for i in sorted(texts):
        w = [x for x in re.split(BLANK, texts[i].translate(low)) if x]
        sets[i] = {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in sets.items():
        shared = Counter(j for g in s for j in holders.get(g, ()))
        close = [j for j, n in shared.items() if 5 * n >= 4 * (len(s) + len(sets[j]) - n)] + [j for j in sets if j < i and not s and not sets[j]]
        for j in close:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
        for g in s:
            holders.setdefault(g, []).append(i)
    return {i for i in sets if find(i) == i}


def test_near_stage_finds_every_similar_pair(spark):
    """The stage against brute force, on a table and on families of chained copies, supersets and short texts."""
    import corpus_pipeline as p

    rng = np.random.default_rng(5)
    words = np.array([f"w{i}" for i in range(5000)])
    made = []
    for n in (5, 8, 9, 12, 20, 33, 60, 150, 700):
        for _ in range(12):
            base = rng.choice(words, n)
            made.append(base)
            for step in range(6):
                base = base.copy()
                base[rng.integers(0, n, max(1, n // 60))] = rng.choice(words, max(1, n // 60))
                made.append(base)
            made += [np.r_[made[-1], rng.choice(words, max(1, n // 5))], made[-1][: max(1, n * 7 // 8)]]
    order = rng.permutation(len(made))
    own = {k: " ".join(made[i]) for k, i in enumerate(order.tolist())}
    real = dict(duckdb.sql("SELECT doc_id, coalesce(text, '') FROM '/root/testdata/sf0.01/documents.parquet'").fetchall())
    for table in (own, real):
        docs = spark.createDataFrame(list(table.items()), "doc_id long, text string")
        want = lowest_of_similar(table)
        assert len(want) < len(table)
        assert {r.doc_id for r in p.near(spark, docs, SF).select("doc_id").collect()} == want
