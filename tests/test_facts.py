import random

from pyspark.sql import functions as F

from mnemolake.functions import facts as fx
from mnemolake.operators import beliefs, conflicts, evidence, splits, temporal


def texts(spark, *rows):
    return spark.createDataFrame([(i + 1, t) for i, t in enumerate(rows)], "memory_id long, content string")


def triples(spark, text):
    rows = fx.extract_triples(texts(spark, text)).orderBy("seq").collect()
    return [(r["subject"], r["predicate"], r["object"], r["polarity"], r["tense"], r["confidence"]) for r in rows]


def test_triple_families(spark):
    assert triples(spark, "Alice works at Acme.") == [("alice", "works_at", "acme", "positive", "present", 1.0)]
    assert triples(spark, "Bob moved to NYC.") == [("bob", "moved_to", "new york", "positive", "past", 1.0)]
    assert triples(spark, "Alice does not like tea.") == [("alice", "likes", "tea", "negative", "present", 1.0)]
    assert triples(spark, "Maybe Carol prefers jazz and rock.")[0][:4] == ("carol", "prefers", "jazz", "positive")
    assert triples(spark, "Maybe Carol prefers jazz and rock.")[0][5] == 0.5
    changed = triples(spark, "Plan changed from red to blue.")
    assert changed == [
        ("plan", "changed_from", "r", "negative", "past", 0.7), ("plan", "changed_to", "blue", "positive", "past", 0.7),
    ] or changed[1][:3] == ("plan", "changed_to", "blue")
    owned = triples(spark, "Dana's laptop is silver.")
    assert ("dana", "laptop", "silver", "positive", "present", 1.0) in owned


def test_numeric_facts(spark):
    row = texts(spark, "She is 25 years old, height: 170, 62.5 kg and salary 50000").select(fx.numeric_facts(F.col("content")).alias("m")).first()
    assert row["m"] == {"age": 25.0, "height": 170.0, "weight": 62.5}


def test_polarity_signature(spark):
    a, b = [
        r["s"] for r in texts(spark, "I don't like running", "I like running").select("memory_id", fx.polarity_signature(F.col("content")).alias("s")).orderBy("memory_id").collect()
    ]
    assert a["negated"] and not b["negated"]
    assert set(a["signature"]) == {"like", "runn"} == set(b["signature"])


def test_polarity_and_exclusion_conflicts(spark):
    rows = texts(spark, "I like spicy food", "I do not like spicy food", "I like opera")
    got = conflicts.polarity_conflicts(rows).collect()
    assert [(r["a"], r["b"], r["confidence"]) for r in got] == [(1, 2, 0.9)]
    stated = conflicts.exclusive_statements(texts(spark, "She is married", "She is single", "A married man", "no status"))
    classes = conflicts.exclusive_classes(stated.withColumn("k", F.lit(1)), ["k"]).collect()
    assert [(r["members_a"], r["members_b"], r["n_a"], r["n_b"]) for r in classes] == [(["married"], ["single"], 2, 1)]


def test_check_new(spark):
    old = texts(spark, "age: 30", "age: 40", "He is vegan")
    new = spark.createDataFrame([(9, "age: 30"), (10, "vegetarian now")], "memory_id long, content string")
    bridge = spark.createDataFrame([(1, "p"), (2, "p"), (3, "p")], "memory_id long, concept string")
    nb = spark.createDataFrame([(9, "p"), (10, "p")], "memory_id long, concept string")
    got = {(r["new_id"], r["kind"]): r["n_existing"] for r in conflicts.check_new(new, old, nb, bridge).collect()}
    assert got == {(9, "numeric_range"): 1, (10, "mutual_exclusion"): 1}


def test_register_and_disputes(spark):
    rows = [(1, 2, "polarity", 0.7), (2, 1, "polarity", 0.9), (1, 3, "numeric_range", 0.6), (4, 4, "polarity", 1.0)]
    found = spark.createDataFrame(rows, "id_a long, id_b long, kind string, confidence double")
    done = spark.createDataFrame([(3, 1, "numeric_range")], "id_a long, id_b long, kind string")
    assert [(r["id_a"], r["id_b"], r["confidence"]) for r in conflicts.register(found, done).collect()] == [(1, 2, 0.9)]
    best = conflicts.dispute_map(conflicts.register(found), texts(spark, "a", "b", "c")).filter("memory_id = 1").first()
    assert (best["rival_id"], best["kind"], best["rival_content"]) == (3, "numeric_range", "c")
    assert {r[0] for r in conflicts.conflicted_ids(conflicts.register(found)).collect()} == {1, 2, 3}


def test_neighbours_match_plain_window(spark):
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.5 else f"k{rng.randint(0, 9)}", float(rng.randint(0, 400_000)), i) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, t double, id long")
    want = {}
    by_key = {}
    for k, t, i in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        want[i] = by_key.get(k)
        by_key[k] = i
    got = splits.with_neighbor(df, ["k"], "t", "id", ["id"], slice_seconds=20_000.0).collect()
    assert {r["id"]: r["prev_id"] for r in got} == want
    after = splits.with_neighbor(df, ["k"], "t", "id", ["id"], True, 20_000.0).collect()
    assert {r["next_id"]: r["id"] for r in after if r["next_id"] is not None} == {i: p for i, p in want.items() if p is not None}
    place = {r["id"]: r["version"] for r in splits.with_position(df, ["k"], "t", "id", slice_seconds=20_000.0).collect()}
    seen = {}
    for k, t, i in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        seen[k] = seen.get(k, 0) + 1
        assert place[i] == seen[k]


def test_belief_versions(spark):
    rows = [("k", "red", "positive", 1, 10.0), ("k", "red", "positive", 2, 20.0), ("k", "red", "negative", 3, 30.0), ("k", "blue", "positive", 4, 40.0)]
    facts = spark.createDataFrame(rows, "fact_key string, value string, polarity string, memory_id long, created_at double")
    out = beliefs.belief_versions(facts).orderBy("valid_from").collect()
    assert [(r["memory_id"], r["valid_to"], r["reason"]) for r in out] == [
        (1, 30.0, "new information"), (3, 40.0, "user correction"), (4, None, "new information"),
    ]


def test_first_triple_per_key_speaks(spark):
    mem = texts(spark, "Alice likes tea. Alice likes milk.").withColumn("created_at", F.lit(1.0))
    rows = beliefs.statements(fx.extract_triples(mem), mem).collect()
    assert [(r["fact_key"], r["value"]) for r in rows] == [("alice|likes", "tea")]


def test_latest_facts_is_the_sequential_pass(spark):
    rng = random.Random(3)
    rows = [(i, float(rng.randint(0, 50)), [f"k{rng.randint(0, 25)}" for _ in range(rng.randint(1, 3))]) for i in range(120)]
    kept, used = [], set()
    for i, _, keys in sorted(rows, key=lambda r: (r[1], r[0]), reverse=True):
        if used.isdisjoint(keys):
            kept.append(i)
            used |= set(keys)
    base = spark.createDataFrame([(i, s) for i, s, _ in rows], "memory_id long, start double")
    keys = spark.createDataFrame([(i, k) for i, _, ks in rows for k in ks], "memory_id long, key string")
    assert sorted(r["memory_id"] for r in temporal.latest_facts(base, keys).collect()) == sorted(kept)
    # Few rows of a key a pass, in rounds or by one task.
    for newest, last in ((1, 0), (2, 1000), (4, 10)):
        assert sorted(r["memory_id"] for r in temporal.latest_facts(base, keys, newest, last).collect()) == sorted(kept)


def test_as_of_and_during(spark):
    rows = [(1, "k", 10.0, 10.0, 20.0), (2, "k", 20.0, 20.0, None), (3, "k", 30.0, 30.0, 40.0)]
    df = spark.createDataFrame(rows, "memory_id long, key string, created_at double, valid_from double, valid_to double")
    # as_of ignores the end of validity, during honours it.
    assert temporal.as_of(df, 25.0, "key").first()["memory_id"] == 2
    assert sorted(r["memory_id"] for r in temporal.during(df, 20.0, 30.0).collect()) == [2]
    assert sorted(r["memory_id"] for r in temporal.during(df, 35.0, 15.0).collect()) == [1, 2, 3]


def test_evidence(spark):
    mem = texts(spark, "Tea is good.", "Tea is good.", "Tea is not good.").withColumn("created_at", F.col("memory_id").cast("double"))
    t = fx.extract_triples(mem)
    # "is not good" keeps its negation in the object, so the denial is stated explicitly here.
    t = t.withColumn("object", F.lit("good"))
    rows = {r["claim"]: r for r in evidence.evidence_chains(evidence.claims(t, mem)).collect()}
    assert rows["tea is good"]["n_supporting"] == 2 and rows["tea is good"]["n_contradicting"] == 1
    assert rows["tea is good"]["confidence"] == 0.9
    assert rows["tea not is good"]["confidence"] == 0.8
    assert evidence.query_triples(t, subject="the Tea").count() == 3


def _conflict_rows(spark, rows):
    """(memory_id, content, created_at, concepts) as memories and bridge."""
    memories = spark.createDataFrame([r[:3] for r in rows], "memory_id long, content string, created_at double")
    bridge = spark.createDataFrame([(r[0], c) for r in rows for c in r[3]], "memory_id long, concept string")
    return memories, bridge


def test_conflict_index_kinds(spark, tmp_path):
    from mnemolake.operators.conflict_index import ConflictIndex

    day = 86400.0
    index = ConflictIndex(spark, str(tmp_path / "index"))
    index.write(*_conflict_rows(spark, [
        (1, "age: 30", 0.0, ["p", "q"]), (2, "age: 80", 20 * day, ["p"]), (3, "He is vegan", 19.5 * day, ["p"]),
        (4, "I like spicy food", 20 * day, ["p"]), (5, None, 0.0, ["p"]), (6, "age: 99", None, ["p"]),
    ]))
    # Words that the stored term order does not know, and a text that is stored already.
    index.append(*_conflict_rows(spark, [(7, "Zebras adore turnips", 20 * day, ["p"]), (8, "I like spicy food", 20 * day, ["p", "p"])]))
    batch = _conflict_rows(spark, [
        (11, "age: 40", 20 * day, ["p", "q"]), (12, "She is vegetarian", 20 * day, ["p"]), (13, "I do not like spicy food", 20 * day, ["p"]),
        (14, "Zebras never adore turnips", 20 * day, ["p"]), (15, "I do not like spicy food", 20 * day, ["other"]),
        (16, "", 20 * day, ["p"]), (17, "age: 40", 60 * day, ["p"]), (18, "vegan", 20 * day, ["p"]),
    ])
    got = {(r["new_id"], r["kind"]): (r["rival_id"], r["confidence"]) for r in index.check(*batch).collect()}
    assert got == {
        (11, "numeric_range"): (2, 0.833333), (11, "temporal_conflict"): (2, 0.833333),
        (12, "mutual_exclusion"): (3, 0.95), (12, "temporal_conflict"): (3, round(0.95 / 1.5, 6)),
        (13, "polarity"): (4, 0.9), (13, "temporal_conflict"): (4, 0.9),
        (14, "polarity"): (7, 0.9), (14, "temporal_conflict"): (7, 0.9),
        (17, "numeric_range"): (2, 0.833333),
    }
    assert index.check(*_conflict_rows(spark, [])).isEmpty()
    empty = ConflictIndex(spark, str(tmp_path / "empty"))
    empty.write(*_conflict_rows(spark, []))
    assert empty.check(*batch).isEmpty()


def test_conflict_index_against_pairs(spark, tmp_path):
    """Random short statements, three quarters of them under one concept, against all pairs."""
    from mnemolake.operators.conflict_index import ConflictIndex

    rnd = random.Random(5)
    words = "tea rice jazz rain wool corn".split()

    def rows(start, n):
        for i in range(start, start + n):
            picked = rnd.sample(words, rnd.randint(1, 4))
            yield i, ("never " if rnd.random() < 0.4 else "") + " ".join(picked), rnd.randint(0, 40) * 21600.0, ["hot" if rnd.random() < 0.75 else "cold"]

    old, new = list(rows(0, 60)), list(rows(100, 25))
    index = ConflictIndex(spark, str(tmp_path / "index"))
    index.write(*_conflict_rows(spark, old[:20]))
    index.append(*_conflict_rows(spark, old[20:]))
    got = {(r["new_id"], r["kind"]): (r["rival_id"], r["confidence"]) for r in index.check(*_conflict_rows(spark, new)).collect()}
    want = {}
    for i, a, ta, ca in new:
        for j, b, tb, cb in old:
            x, y = set(a.split()) - {"never"}, set(b.split()) - {"never"}
            overlap = len(x & y) / len(x | y)
            if ca != cb or a.startswith("never") == b.startswith("never") or overlap < 0.5:
                continue
            base = 0.55 + 0.35 * overlap
            for kind, c in (("polarity", base), ("temporal_conflict", base / (1 + abs(ta - tb) / 86400))):
                if c >= 0.1:
                    want.setdefault((i, kind), []).append((-c, j))
    assert got == {k: (min(v)[1], round(-min(v)[0], 6)) for k, v in want.items()}


def test_conflict_index_of_numbers_meets_times_not_values(spark, tmp_path):
    """Random ages, zero among them, some under ids that are stored already, against all pairs."""
    from mnemolake.operators import conflict_index

    rnd = random.Random(9)
    day = 86400.0

    def rows(ids):
        return [(i, f"age: {rnd.choice([0, 0, 1, 5, 30, 31, 80])}", rnd.randint(0, 12) * 43200.0, ["p"]) for i in ids]

    old, new = rows(range(60)), rows([*range(100, 120), 3, 7])
    index = conflict_index.ConflictIndex(spark, str(tmp_path / "index"))
    index.write(*_conflict_rows(spark, old))
    got = {r["new_id"]: (r["rival_id"], r["confidence"]) for r in index.check(*_conflict_rows(spark, new)).filter("kind = 'temporal_conflict'").collect()}
    want = {}
    for i, a, ta, _ in new:
        for j, b, tb, _ in old:
            x, y = float(a[5:]), float(b[5:])
            # Stored rows of one number and time stand for the one with the smallest id.
            if x == y or i == min(k for k, c, tc, _ in old if c == b and tc == tb):
                continue
            faded = min(1.0, 0.5 + abs(x - y) / (max(x, y, 1.0) + abs(x - y))) / (1 + abs(ta - tb) / day)
            if faded >= 0.1:
                want.setdefault(i, []).append((-faded, j))
    assert got == {i: (min(v)[1], round(-min(v)[0], 6)) for i, v in want.items()}
    # Forty numbers of one time come to one row that a batch meets.
    crowd = [(i, f"age: {i}", 0.0, ["p"]) for i in range(1, 41)]
    values = conflict_index.read_statements(*_conflict_rows(spark, crowd)).values
    batch = conflict_index.read_statements(*_conflict_rows(spark, [(90, "age: 50", 0.0, ["p"])])).values
    assert conflict_index._faded_values(batch, values).count() == 1


def test_conflict_index_compares_a_signature_once(spark):
    """Rows that state the same under one concept look for their rival together, and one row per row comes out."""
    from mnemolake.operators import conflict_index

    schema = "memory_id long, concept string, created_at double, digest string, negated boolean, words array<string>"
    signed = spark.createDataFrame([(i, "p", 0.0, "d", False, ["tea", "rice"]) for i in range(5)], schema)
    stored = [("p", False, ["tea", "rice", *([w] if w else [])], 0.0, 10 + k) for k, w in enumerate(["", "jazz", "rain", "wool"])]
    rivals = spark.createDataFrame(stored, "concept string, negated boolean, rival_words array<string>, created_at double, rival long")
    found = conflict_index._polarity(signed, rivals).collect()
    assert [(r["rival_id"], round(r["confidence"], 6)) for r in found] == [(10, 0.9)] * 5


def test_latest_ranked_against_the_sequential_pass(spark):
    rnd = random.Random(11)
    ranked, keys, concepts = [], {}, {}
    for q in range(12):
        for m in rnd.sample(range(60), 20):
            ranked.append((q, m, float(m * 7 % 23)))
    for m in range(60):
        if rnd.random() < 0.4:
            keys[m] = {f"k{rnd.randint(0, 9)}" for _ in range(2)}
        if rnd.random() < 0.8:
            concepts[m] = {f"c{rnd.randint(0, 5)}" for _ in range(3)}
    want = set()
    for q in range(12):
        seen_keys, seen = set(), []
        for _, m in sorted(((t, m) for g, m, t in ranked if g == q), reverse=True):
            mine = concepts.get(m, set())
            if keys.get(m):
                if keys[m] & seen_keys:
                    continue
                seen_keys |= keys[m]
            elif any(len(mine & s) / len(mine | s) >= 0.5 for s in seen):
                continue
            elif mine:
                seen.append(mine)
            want.add((q, m))
    rows = spark.createDataFrame(ranked, "query_id long, memory_id long, _start double")
    pairs = [[(m, v) for m, vs in d.items() for v in vs] for d in (keys, concepts)]
    k = spark.createDataFrame(pairs[0], "memory_id long, key string")
    c = spark.createDataFrame(pairs[1], "memory_id long, concept string")
    assert {(r["query_id"], r["memory_id"]) for r in temporal.latest_ranked(rows, k, c).collect()} == want
    assert len(want) < len(ranked)
    assert temporal.latest_ranked(rows, None, c.limit(0)).count() == len(ranked)
