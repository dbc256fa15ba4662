import random
import re

import pytest
from pyspark.sql import functions as F

from mnemolake.operators import access, concepts, graph, index, patterns, retrieval, similarity


def test_spread_golden_values(spark):
    edges = spark.createDataFrame([("alpha", "beta", 1.0), ("beta", "gamma", 1.0), ("gamma", "delta", 1.0), ("delta", "eps", 1.0)], "a string, b string, weight double")
    both = graph.both_ways(edges)
    seeds = spark.createDataFrame([(1, "alpha")], "query_id long, concept string")
    got = {r["concept"]: r["score"] for r in graph.multi_hop_spread(seeds, both).collect()}
    assert got == {"alpha": 1.0, "beta": 0.5, "gamma": 0.25, "delta": 0.125}


def test_components_and_communities(spark):
    rng = random.Random(1)
    edges = {(a, b) for a, b in ((rng.randint(0, 120), rng.randint(0, 120)) for _ in range(90)) if a != b}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    df = spark.createDataFrame(list(edges), "a long, b long")
    got = {r["node"]: r["component"] for r in graph.connected_components(df).collect()}
    assert got == {x: find(x) for x in parent}
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    assert {r["component"] for r in graph.connected_components(chain).collect()} == {0}
    tri = spark.createDataFrame([("x_y", "b", 1.0), ("b", "c", 2.0), ("x_y", "c", 3.0)], "a string, b string, weight double")
    row = graph.communities(tri).first()
    assert (row["size"], row["density"], row["hub_concepts"], row["label"]) == (3, 1.0, ["c", "x_y", "b"], "C & X Y")


def test_chain_and_bfs(spark):
    edges = spark.createDataFrame([(i + 1, i, "supersedes", 1.0) for i in range(1, 10)], "source_id long, target_id long, edge_type string, weight double")
    rows = {r["memory_id"]: r for r in graph.chain_versions(edges).collect()}
    assert [rows[i]["version"] for i in range(1, 11)] == list(range(1, 11))
    assert {r["chain_id"] for r in rows.values()} == {1}
    assert [i for i in rows if rows[i]["current"]] == [10]
    nodes, crossed = graph.bfs_slice(edges, spark.createDataFrame([(1, 5)], "query_id long, memory_id long"), 2)
    assert {r["memory_id"]: r["level"] for r in nodes.collect()} == {5: 0, 4: 1, 6: 1, 3: 2, 7: 2}
    assert crossed.count() == 4
    cycle = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "source_id long, target_id long").withColumn("edge_type", F.lit("supersedes"))
    with pytest.raises(ValueError, match="cycle"):
        graph.chain_versions(cycle)


def _docs(spark, seed, n, vocab=60):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        if out and rng.random() < 0.5:
            words = list(rng.choice(out)[1])
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = f"w{rng.randint(0, vocab)}"
        else:
            words = [f"w{rng.randint(0, vocab)}" for _ in range(rng.randint(1, 25))]
        out.append((i, words))
    return out, spark.createDataFrame([(i, " ".join(w)) for i, w in out], "memory_id long, content string")


def _jac(a, b):
    return len(a & b) / len(a | b)


def test_jaccard_pairs_are_exact(spark):
    for threshold in (0.5, 0.7, 0.85):
        rows, df = _docs(spark, 7, 150)
        reps, members = similarity.collapse_copies(similarity.token_sets(df))
        first = {}
        for i, w in rows:
            first.setdefault(frozenset(w), i)
        want = {
            (min(a, b), max(a, b))
            for x, a in first.items() for y, b in first.items() if a < b and _jac(x, y) >= threshold
        }
        got = {(r["a"], r["b"]) for r in similarity.jaccard_pairs(reps, threshold).collect()}
        assert got == want
        assert {r["memory_id"]: r["rep"] for r in members.collect()} == {i: first[frozenset(w)] for i, w in rows}


def test_greedy_matching_is_the_sequential_one(spark):
    rng = random.Random(11)
    matches = [(a, b, rng.choice([0.85, 0.9, 0.95, 1.0])) for a in range(30) for b in range(100, 120) if rng.random() < 0.25]
    taken, want = set(), {}
    for a in range(30):
        options = sorted(((-s, b) for x, b, s in matches if x == a and b not in taken))
        if options:
            want[a] = options[0][1]
            taken.add(options[0][1])
    df = spark.createDataFrame(matches, "a long, b long, similarity double")
    assert {r["a"]: r["b"] for r in similarity.greedy_one_to_one(df).collect()} == want


def test_sets_that_share_a_rare_word_only_do_not_meet(spark):
    """Bitmaps rule pairs out before they leave the task; copies with a word or two changed still meet."""
    rows = [(i, ["rare"] + [f"w{i}_{k}" for k in range(200)]) for i in range(60)]
    rows += [(100 + i, rows[i][1][2:] + [f"v{i}"]) for i in range(10)]
    reps = spark.createDataFrame(rows, "rep long, words array<string>")
    sets = similarity._hashed(reps.withColumnRenamed("rep", "id"))
    counts = spark.sparkContext.broadcast(similarity._sketch(sets))
    met = similarity._meeting(similarity._prefixes(sets, counts, 0.5), 0.5, False)
    assert met.count() == 10
    assert {(r["a"], r["b"]) for r in similarity.jaccard_pairs(reps, 0.5).collect()} == {(i, 100 + i) for i in range(10)}


def test_jaccard_joins_of_all_sizes_equal_brute_force(spark):
    import random

    rng = random.Random(5)
    base = [[f"w{int(rng.paretovariate(0.6)) % 3000}" for _ in range(rng.choice([1, 2, 5, 9, 20, 60, 200, 500]))] for _ in range(40)]
    sets = []
    for words in base:
        for _ in range(3):
            kept = [w for w in words if rng.random() > 0.12] + [f"w{rng.randrange(400)}" for _ in range(int(len(words) * rng.random() * 0.3))]
            sets.append(sorted(set(kept)))
    reps = spark.createDataFrame(list(enumerate(sets)), "rep long, words array<string>")
    both = reps.withColumnRenamed("rep", "id")
    for t in (0.5, 0.85):
        want = {
            (i, j) for j in range(len(sets)) for i in range(j)
            if sets[i] and sets[j] and len({*sets[i]} & {*sets[j]}) / len({*sets[i]} | {*sets[j]}) >= t
        }
        assert sorted((r["a"], r["b"]) for r in similarity.jaccard_pairs(reps, t).collect()) == sorted(want)
        matches = similarity.jaccard_matches(both.filter("id % 3 = 0"), both.filter("id % 3 > 0"), t)
        across = {(a, b) if a % 3 == 0 else (b, a) for a, b in want if (a % 3 == 0) != (b % 3 == 0)}
        assert sorted((r["a"], r["b"]) for r in matches.collect()) == sorted(across)


def test_lsh_links_against_the_exact_join(spark):
    """Families whose buckets are headed by sets that many members don't resemble."""
    import random

    rng = random.Random(17)
    rows = []
    for f in range(12):
        base = [f"f{f}w{i}" for i in range(40)]
        for _ in range(40):
            t = list(base)
            for _ in range(rng.randint(0, 7)):
                t[rng.randrange(40)] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), sorted(set(t))))
    reps = spark.createDataFrame(rows, "rep long, words array<string>")
    exact = similarity.jaccard_pairs(reps, 0.85).select("a", "b").cache()
    links = similarity.lsh_links(reps, 0.85).select("a", "b").cache()
    assert links.join(exact, ["a", "b"], "left_anti").count() == 0
    members = {x for r in exact.collect() for x in r}
    found = {x for r in links.collect() for x in r}
    assert len(found) >= 0.95 * len(members) and links.count() < exact.count()
    whole = {r["node"]: r["component"] for r in graph.connected_components(exact).collect()}
    own = {r["node"]: r["component"] for r in graph.connected_components(links).collect()}
    apart = sum(own.get(n) != own.get(c) for n, c in whole.items())
    assert apart <= 0.15 * len(whole)
    nothing = spark.createDataFrame([(1, ["a"]), (2, ["b"])], "rep long, words array<string>")
    assert similarity.lsh_links(nothing, 0.85).count() == 0


def test_lsh_links_find_near_copies(spark):
    base = " ".join(f"word{i}" for i in range(80))
    near = base.replace("word7 ", "other ")
    df = spark.createDataFrame([(1, base), (2, near), (3, "nothing alike here")], "memory_id long, content string")
    reps, _ = similarity.collapse_copies(similarity.token_sets(df))
    assert [(r["a"], r["b"]) for r in similarity.lsh_links(reps, 0.85).collect()] == [(1, 2)]


def test_consolidation_gate(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(1, text), (2, text + " more"), (3, text + " extra"), (4, "apart entirely")]
    df = spark.createDataFrame(rows, "memory_id long, content string").withColumn("strength", F.lit(1.8))
    two = spark.createDataFrame([(i, c) for i in (1, 2, 3) for c in ("x", "y")], "memory_id long, concept string")
    clusters = similarity.consolidation_clusters(df, two, 0.7)
    row = similarity.cluster_summary(clusters, df, two).first()
    assert (row["component"], row["source_count"], row["strength"], row["n_concepts"]) == (1, 3, 2.0, 2)
    apart = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (2, "d"), (3, "e"), (3, "f")], "memory_id long, concept string")
    assert similarity.consolidation_clusters(df, apart, 0.7).count() == 0


def test_cluster_sentences(spark):
    df = spark.createDataFrame([(1, "A b. C d."), (2, "a b. New one!")], "memory_id long, content string")
    clusters = spark.createDataFrame([(1, 1), (2, 1)], "memory_id long, component long")
    got = [r["sentence"] for r in similarity.cluster_sentences(clusters, df).orderBy("memory_id", "pos").collect()]
    assert got == ["A b.", "C d.", "New one!"]


def test_concept_extraction(spark):
    lex = spark.createDataFrame(
        [("memory", "hardware", "hw"), ("machine learning", "ai", "ai"), ("machine", "hardware", "hw"), ("go", "go", "lang"), ("c++", "cpp", "lang"), ("kubernetes", "kubernetes", "tools")],
        "alias string, concept string, category string",
    )
    rows = [(1, "Machine learning on Kubernetes"), (2, "a memory database"), (3, "memory database with more memory"), (4, "go home"), (5, "C++ in /usr/bin v1.2.3")]
    df = spark.createDataFrame(rows, "memory_id long, content string")
    got = {}
    for r in concepts.extract_concepts(df, lex, punctuated=["c++"]).collect():
        got.setdefault(r["memory_id"], set()).add(r["concept"])
    assert got == {1: {"ai", "kubernet"}, 3: {"hardware"}, 5: {"cpp", "path", "versioning"}}


def test_recall_multipliers(spark):
    now = 1_000_000.0
    rows = [(i, f"alpha beta {'gamma' if i == 1 else 'delta'}", 1.0, 0, now, now, "instance", False) for i in (1, 2, 3)]
    mem = spark.createDataFrame(rows, "memory_id long, content string, strength double, access_count long, last_accessed double, created_at double, memory_level string, consolidated boolean")
    q = spark.createDataFrame([(1, "alpha delta")], "query_id long, query string")
    empty = spark.createDataFrame([], "memory_id long, concept string")
    qc = spark.createDataFrame([], "query_id long, concept string")
    plain = {r["memory_id"]: r["score"] for r in retrieval.recall(mem, q, empty, qc, now).collect()}
    edges = spark.createDataFrame([(2, 3, "supersedes", 1.0)], "source_id long, target_id long, edge_type string, weight double")
    tied = {r["memory_id"]: r["score"] for r in retrieval.recall(mem, q, empty, qc, now, edges=edges).collect()}
    assert abs(tied[2] - plain[2] * 1.1) < 1e-5
    assert abs(tied[3] - plain[3] * 1.1 * 0.1) < 1e-5
    marked = spark.createDataFrame([(2,)], "memory_id long")
    assert abs({r["memory_id"]: r["score"] for r in retrieval.recall(mem, q, empty, qc, now, conflicted=marked).collect()}[2] - plain[2] * 0.2) < 1e-5


def test_scope_rules(spark):
    rows = [(1, "public", None, False), (2, "shared", ["a"], False), (3, "shared", None, False), (4, "private", None, False), (5, "public", None, True)]
    df = spark.createDataFrame(rows, "memory_id long, scope string, shared_with array<string>, sensitive boolean")

    def seen(scope, groups=None):
        return [r["memory_id"] for r in df.filter(access.visible(scope, groups)).orderBy("memory_id").collect()]

    assert seen("public") == [1]
    assert seen("shared", ["a"]) == [1, 2, 3]
    assert seen("shared", []) == [1, 3]
    assert seen("shared") == [1, 2, 3]
    assert seen("private") == [1, 2, 3, 4, 5]
    row = access.receipt(df, "public", None, 1.0).first()
    assert (row["considered"], row["returned"], row["blocked"]) == (5, 1, 4)
    assert access.clamp_scope("private", "shared") == "shared"


def test_patterns(spark):
    monday = 1704067200.0  # 2024-01-01
    dated = spark.createDataFrame([(i, "gym", monday + 7 * 86400 * i) for i in range(3)] + [(9, "tea", monday)], "memory_id long, concept string, created_at double")
    assert [tuple(r) for r in patterns.seasonal_patterns(dated).collect()] == [("gym", "Monday", 3, 1.0)]
    eps = spark.createDataFrame([(i, 1000.0 * i) for i in range(1, 7)], "episode_id long, started_at double")
    occ = spark.createDataFrame([("a", e) for e in (1, 2, 3, 6)] + [("b", e) for e in (1, 3, 5)], "concept string, episode_id long")
    assert [tuple(r) for r in patterns.streak_patterns(occ, eps).collect()] == [("a", 3)]


def test_vector_search_both_ways(spark, monkeypatch):
    items = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(-3, 4)] + [(9, [0.0, 0.0])], "memory_id long, embedding array<double>")
    probes = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0])], "query_id long, vector array<double>")

    def top():
        return {(r["query_id"], r["rank"]): (r["memory_id"], r["cosine"]) for r in retrieval.vector_top(items, probes, 2).collect()}

    broadcast = top()
    assert broadcast[(1, 1)] == (3, 0.948683) and broadcast[(2, 1)] == (0, 1.0)
    monkeypatch.setattr(retrieval, "PROBE_BLOCK", 1)
    assert top() == broadcast


def test_index_with_batches_and_removals(spark, tmp_path):
    rows = [(1, "tea and cake"), (2, "tea time tea"), (3, "coffee cake"), (4, "")]
    df = spark.createDataFrame(rows, "memory_id long, content string")
    path = str(tmp_path / "index")
    index.write_index(df.filter("memory_id <> 2"), path)
    index.write_index(df.filter("memory_id = 2"), path, mode="append")
    queries = spark.createDataFrame([(7, "tea cake")], "query_id long, query string")

    def same(memories):
        a = {r["memory_id"]: round(r["score"], 9) for r in retrieval.bm25_from_index(spark, path, queries).collect()}
        return a == {r["memory_id"]: round(r["score"], 9) for r in retrieval.bm25(memories, queries).collect()} and a

    assert same(df)
    index.remove_from_index(df.filter("memory_id = 1"), path)
    assert set(same(df.filter("memory_id <> 1"))) == {2, 3}


def test_bm25_scores_are_summed_where_a_row_lies(spark):
    memories = spark.createDataFrame([(i, f"red fox number{i % 3} red") for i in range(30)], "memory_id long, content string")
    queries = spark.createDataFrame([(1, "red fox"), (2, "number1")], "query_id long, query string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        scored = retrieval.bm25(memories, queries)
        plan = scored._jdf.queryExecution().executedPlan().toString()
        # A term that all rows hold is not one task's, and no (query, row) pair is shuffled.
        assert not re.search(r"hashpartitioning\(query_id#\w+, memory_id#", plan) and re.search(r"hashpartitioning\(memory_id#\w+, \d+\), REPARTITION", plan)
        found = {(r["query_id"], r["memory_id"]) for r in scored.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert found == {(1, i) for i in range(30)} | {(2, i) for i in range(30) if i % 3 == 1}


def test_concept_idf_scores_only_what_may_be_best(spark, monkeypatch):
    rng = random.Random(5)
    rows = {(m if m else None, f"c{rng.randint(0, 30)}") for m in range(2000) for _ in range(rng.randint(1, 6))}
    bridge = spark.createDataFrame(sorted(rows, key=str), "memory_id long, concept string")
    asked = {(q, f"c{rng.randint(0, 30)}") for q in range(6) for _ in range(12)} | {(9, "c1"), (10, "unknown"), (None, "c2")}
    queries = spark.createDataFrame(sorted(asked, key=str), "query_id long, concept string")
    total = spark.range(2000).agg(F.count("*")).scalar()

    def best(limit):
        scored = retrieval.concept_idf(bridge, queries, total, limit).withColumn("score", F.round("score", 6))
        top = retrieval.top_per_group(scored, ["query_id"], [F.desc("score"), F.asc("memory_id")], 10)
        return {(r["query_id"], r["rank"], r["memory_id"], r["score"]) for r in top.collect()}, scored.count()

    (few, n_few), (full, n_full) = best(10), best(None)
    assert few == full and len(full) == 80
    assert n_few <= n_full
    wide = bridge.select("concept").distinct().crossJoin(spark.range(3).toDF("query_id")).select("query_id", "concept")
    assert retrieval.concept_idf(bridge, wide, total, 10).count() * 4 < retrieval.concept_idf(bridge, wide, total).count()
