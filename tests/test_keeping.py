"""Greedy selection, chains, import and merge, replay, versions, incremental components, tails, checkpoints, tenants."""

import os
import random

import pytest
from pyspark.sql import functions as F

from mnemolake.operators import graph, portable, selection, store, temporal
from mnemolake.session import scratch_path
from mnemolake.sources.oplog import LoggedStore
from mnemolake.sources.tail import TailReader
from mnemolake.sources.tenants import TenantTable, tenant_of
from mnemolake.sources.versions import Conflict, VersionedTables
from mnemolake.streaming.checkpoints import CheckpointSink


@pytest.mark.parametrize("last", [0, 100_000])
def test_dropped_by_order_is_the_sequential_pass(spark, last):
    rng = random.Random(4)
    links = {tuple(sorted(rng.sample(range(120), 2))) for _ in range(200)} | {(i, i + 1) for i in range(200, 230)}
    kept = []
    for n in range(300):
        if not any((k, n) in links for k in kept):
            kept.append(n)
    df = spark.createDataFrame(sorted(links), "first long, later long")
    gone = {r["id"] for r in selection.dropped_by_order(df, last).collect()}
    assert gone == set(range(300)) - set(kept)
    assert selection.dropped_by_order(df.filter("false"), last).count() == 0


def test_latest_similar_and_facts(spark):
    rng = random.Random(9)
    rows = [(i, float(rng.randint(0, 40))) for i in range(80)]
    own = {i: {rng.choice("abcdefg") for _ in range(rng.randint(0, 5))} for i, _ in rows}
    kept, want = [], []
    for i, _ in sorted(rows, key=lambda r: (r[1], r[0]), reverse=True):
        c = own[i]
        if c and any(len(c & k) / len(c | k) >= 0.5 for k in kept):
            continue
        want.append(i)
        if c:
            kept.append(c)
    r = spark.createDataFrame(rows, "memory_id long, start double")
    c = spark.createDataFrame([(i, x.upper()) for i, cs in own.items() for x in cs] + [(999, "a")], "memory_id long, concept string")
    assert sorted(x["memory_id"] for x in temporal.latest_similar(r, c).collect()) == sorted(want)
    # In passes over the newest open sets.
    assert sorted(x["memory_id"] for x in temporal.latest_similar(r, c, first=5).collect()) == sorted(want)
    keys = spark.createDataFrame([(0, "u|likes|tea"), (1, "u|likes|tea")], "memory_id long, key string")
    both = temporal.latest_by_facts_or_concepts(r, keys, c.filter("memory_id > 1"))
    newest = max((0, 1), key=lambda i: (rows[i][1], i))
    assert {x["memory_id"] for x in both.filter("memory_id < 2").collect()} == {newest}


def test_as_of_chain_with_a_hot_chain(spark):
    rng = random.Random(6)
    versions = [(i, 0, i, float(rng.randint(0, 10_000_000))) for i in range(1, 400)] + [(1000, 1, 1, 5.0), (1001, 1, 2, 5.0)]
    moments = [(k, rng.choice([0, 0, 0, 1, 2]), float(rng.randint(-10, 10_500_000))) for k in range(500)] + [(900, 1, 5.0), (901, 1, 4.9)]
    v = spark.createDataFrame(versions, "memory_id long, chain_id long, version long, created_at double")
    m = spark.createDataFrame(moments, "k long, chain_id long, at double")
    got = {r["k"]: (r["version"], r["memory_id"]) for r in temporal.as_of_chain(v, m, 86400.0).collect()}
    for k, chain, at in moments:
        best = max(((x[2], x[0]) for x in versions if x[1] == chain and x[3] <= at), default=(None, None))
        assert got[k] == best


def test_fact_history_of_a_row_without_chain(spark):
    rows = spark.createDataFrame([(1, "a", 1.0), (2, "a", 2.0), (3, "b", 1.0)], "memory_id long, k string, created_at double")
    chains = temporal.ordered_chains(rows, "k")
    top = spark.createDataFrame([(10, 1, 1), (10, 3, 2), (11, 3, 1)], "query_id long, memory_id long, rank int")
    got = sorted(map(tuple, temporal.fact_history(top, chains).collect()))
    assert got == [(10, 1, 1, False), (10, 2, 2, True), (11, 3, 1, True)]


# --- import and merge


def tokens(text):
    import re

    return frozenset(re.findall("[a-z0-9]+", (text or "").lower()))


def alike(a, b, t=0.85):
    return 1.0 if not a and not b else (len(a & b) / len(a | b) if a and b else 0.0)


def make_store(spark, texts, first_episode=1):
    """A store of (id, text, created_at) rows; row i is linked to the next one and belongs to an episode."""
    ids = [t[0] for t in texts]
    return {
        "memories": spark.createDataFrame([(*t, 1.0 + t[0] % 3) for t in texts], "memory_id long, content string, created_at double, strength double"),
        "edges": spark.createDataFrame([(a, b, "next", 1.0) for a, b in zip(ids, ids[1:] + [99999])], "source_id long, target_id long, edge_type string, weight double"),
        "concepts": spark.createDataFrame([(i, f"c{i % 2}", "x") for i in ids], "memory_id long, concept string, category string"),
        "episodes": spark.createDataFrame([(first_episode, "one", 0.0, 1.0), (first_episode + 1, "", 0.0, 1.0)], "episode_id long, name string, started_at double, ended_at double"),
        "members": spark.createDataFrame([(first_episode + i % 2, i) for i in ids], "episode_id long, memory_id long"),
    }


def family(rng, n):
    """Texts of 20 words, each a few words away from an earlier one: similar neighbours, dissimilar ends."""
    texts = [[f"w{i}" for i in range(20)]]
    for k in range(1, n):
        t = list(rng.choice(texts[-3:]))
        for _ in range(rng.randint(0, 2)):
            t[rng.randrange(20)] = f"x{k}{rng.randrange(1000)}"
        texts.append(t)
    return [" ".join(t) for t in texts]


@pytest.fixture(scope="module")
def two_stores(spark):
    rng = random.Random(21)
    texts = family(rng, 40)
    old = [(i, texts[i], float(rng.randint(0, 50))) for i in range(0, 8)] + [(8, "", 3.0), (9, "alone here", 3.0)]
    new = [(100 + i, texts[i], float(rng.randint(0, 50))) for i in range(6, 40)] + [(200, None, 9.0), (201, "!!", 1.0), (202, texts[30], 99.0), (203, "fresh text only", 1.0)]
    return old, new, make_store(spark, old), make_store(spark, new)


def sequential(old, new):
    """(target by incoming id, or None): the pass in id order, with this library's choice among several matches."""
    reps = {}
    for i, t, _ in new:
        reps.setdefault(tokens(t), i)
    olds = {}
    for i, t, _ in old:
        olds.setdefault(tokens(t), i)
    taken, out = {}, {}
    for words, i in sorted(reps.items(), key=lambda x: x[1]):
        matches = [(alike(words, o), 1, -j, j) for o, j in olds.items() if alike(words, o) >= 0.85]
        matches += [(alike(words, o), 0, -j, j) for o, j in taken.items() if alike(words, o) >= 0.85]
        out[i] = max(matches)[1::2] if matches else None
        if not matches:
            taken[words] = i
    return {i: out[reps[tokens(t)]] or (None if reps[tokens(t)] == i else (0, reps[tokens(t)])) for i, t, _ in new}


def test_import_resolves_duplicates_and_rewrites_references(spark, two_stores):
    old, new, existing, incoming = two_stores
    want = sequential(old, new)
    result, ids = portable.import_store(existing, incoming)
    got = {r["memory_id"]: (r["new_id"], r["taken_in"]) for r in ids.collect()}
    fresh = [i for i, t in want.items() if t is None]
    number = {i: 9 + k for k, i in enumerate(sorted(fresh), 1)}
    for i, target in want.items():
        assert got[i] == ((number[i], True) if target is None else (target[1] if target[0] else number[target[1]], False))
    assert any(t and not t[0] for t in want.values()) and any(t and t[0] for t in want.values())
    mems = {r["memory_id"]: r["content"] for r in result["memories"].collect()}
    assert len(mems) == len(old) + len(fresh) and all(mems[number[i]] == t for i, t, _ in new if i in number)
    edges = sorted((r["source_id"], r["target_id"]) for r in result["edges"].collect())
    order = [i for i, _, _ in new]
    assert edges == sorted([(a, b) for a, b in zip(range(10), [*range(1, 10), 99999])] + [(got[a][0], got[b][0]) for a, b in zip(order, order[1:])])
    members = {(r["episode_id"], r["memory_id"]) for r in result["members"].collect()}
    assert members == {(1 + i % 2, i) for i in range(10)} | {(3 + i % 2, got[i][0]) for i in order}


@pytest.mark.parametrize("both", [False, True])
def test_merge(spark, two_stores, both):
    old, new, existing, incoming = two_stores
    result, ids = portable.merge_store(existing, incoming, keep_both=both, source="s")
    got = {r["memory_id"]: r["new_id"] for r in ids.collect()}
    rows = {r["memory_id"]: r for r in result["memories"].collect()}
    assert {r["episode_id"] for r in result["episodes"].collect()} == {1, 2, 3}
    if both:
        assert len(rows) == len(old) + len(new) and sorted(got.values()) == list(range(10, 10 + len(new)))
        copied = next(t for i, t, _ in new if i == 202)
        first = min(i for i, t, _ in new if tokens(t) == tokens(copied))
        assert rows[got[202]]["duplicate_of"] == got[first] and rows[got[106]]["duplicate_of"] == 6 and rows[got[203]]["duplicate_of"] is None
        return
    want = sequential(old, new)
    texts = {i: (t, at) for i, t, at in old} | {got[i]: (t, at) for i, t, at in new if want[i] is None}
    for i in {got[k] for k, t in want.items() if t}:
        newer = [(at, -k, t) for k, t, at in new if got[k] == i and want[k] and at > texts[i][1]]
        assert rows[i]["content"] == (max(newer)[2] if newer else texts[i][0])
    assert all(rows[i]["merged_from"] == ("s" if i > 9 else None) for i in rows)


def test_failed_commit_leaves_the_old_version(spark):
    tables = VersionedTables(spark, scratch_path(spark, "versions"))
    assert tables.manifest()["version"] == 0 and tables.versions() == []
    assert tables.commit({"a": spark.range(3), "b": spark.range(2)}) == 1

    broken = spark.range(10).select(F.raise_error(F.lit("stop")).alias("id"))
    with pytest.raises(Exception, match="stop"):
        tables.commit({"b": spark.range(5), "a": broken})
    assert tables.versions() == [1] and tables.table("b").count() == 2
    assert tables.commit({"a": spark.range(4)}, based_on=1) == 2
    with pytest.raises(Conflict):
        tables.commit({"a": spark.range(9)}, based_on=1)
    assert tables.table("a").count() == 4 and tables.table("a", 1).count() == 3 and tables.table("b").count() == 2
    # A writer that died while writing its manifest is passed over.
    with open(f"{tables.root.removeprefix('file:')}/manifests/{3:012d}.json", "w") as f:
        f.write('{"version": 3, "tab')
    assert tables.versions() == [1, 2] and tables.table("a").count() == 4
    assert tables.commit({"a": spark.range(6)}) == 4
    gone = tables.vacuum(keep=1)
    assert len(gone) >= 3 and tables.table("a").count() == 6 and tables.table("b").count() == 2


# --- replay


def test_replay_of_all_operations(spark):
    log = [
        (0, "insert_memory", '{"id":1,"content":"a","strength":1}'), (1, "insert_memory", '{"id":2,"content":"b"}'),
        (2, "insert_edge", '{"id":7,"source_id":1,"target_id":2}'), (3, "insert_edge", '{"id":8,"source_id":2,"target_id":3}'),
        (4, "delete_memory", '{"id":1}'), (5, "update_memory", '{"id":1,"content":"ghost"}'),
        (6, "insert_memory", '{"id":1,"content":"again"}'), (7, "insert_edge", '{"id":9,"source_id":1,"target_id":2}'),
        (8, "update_memory", '{"id":2,"strength":null,"content":"c"}'), (9, "insert_card", '{"card_id":"k","title":"t"}'),
        (10, "update_card", '{"card_id":"k","score":2}'), (11, "update_card", '{"card_id":"none","score":2}'),
        (12, "insert_card", '{"card_id":"l"}'), (13, "delete_card", '{"card_id":"l"}'), (14, "insert_concept", '{"name":"n","category":"x"}'),
        (15, "insert_episode", '{"id":1,"name":"e"}'), (16, "delete_edge", '{"id":8}'), (17, "insert_edge", '{"id":8,"source_id":2,"target_id":3}'),
        (18, "nonsense", '{"id":1}'), (19, "insert_memory", "no json"), (20, "insert_memory", '{"content":"no id"}'),
    ]
    ops = spark.createDataFrame([(s, float(s), o, d) for s, o, d in log], "seq long, timestamp double, operation string, data string")
    want = {
        ("memory", "1"): {"id": "1", "content": "again"}, ("memory", "2"): {"id": "2", "content": "c", "strength": None},
        ("edge", "9"): {"id": "9", "source_id": "1", "target_id": "2"}, ("edge", "8"): {"id": "8", "source_id": "2", "target_id": "3"},
        ("card", "k"): {"card_id": "k", "title": "t", "score": "2"}, ("concept", "n"): {"name": "n", "category": "x"},
        ("episode", "1"): {"id": "1", "name": "e"},
    }

    def read(df):
        return {(r["kind"], r["key"]): dict(r["fields"]) for r in df.collect()}

    assert read(store.replay_all(store.entries(ops.withColumnRenamed("operation", "op")))) == want
    # The same log in segments, with snapshots in between, at every place.
    good = ops.filter("seq <> 19")
    for cut in (3, 6, 16):
        kept = LoggedStore(spark, scratch_path(spark, "log"))
        kept.append(good.filter(F.col("seq") < cut))
        assert kept.compact() == cut - 1 and kept.compact() == cut - 1
        kept.append(good.filter(F.col("seq") >= cut))
        assert read(kept.state()) == want
        kept.compact()
        assert read(kept.state()) == want and len(kept.snapshots.versions()) == 2
        # A segment that was appended twice changes nothing that the snapshot covers.
        kept.append(good.filter(F.col("seq") < cut).withColumn("timestamp", F.lit(0.0)))
        assert read(kept.state()) == want


def test_incremental_components_equal_a_full_run(spark):
    rng = random.Random(12)
    edges = {tuple(sorted(rng.sample(range(60), 2))) for _ in range(45)}
    removed = set(rng.sample(sorted(edges), 12))
    added = {tuple(sorted(rng.sample(range(50, 80), 2))) for _ in range(8)} | {(900, 901)}
    kind = "a long, b long"
    before = spark.createDataFrame(sorted(edges), kind)
    labels = graph.connected_components(before)
    path = scratch_path(spark, "edges")
    graph.labelled_edges(before, labels).write.partitionBy("part").parquet(path)
    stored = spark.read.parquet(path)
    got = graph.update_components(labels, stored, spark.createDataFrame(sorted(added), kind), spark.createDataFrame(sorted(removed), kind))
    full = graph.connected_components(spark.createDataFrame(sorted((edges - removed) | added), kind))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, full.collect()))
    none = spark.createDataFrame([], kind)
    same = graph.update_components(labels, stored, none, none)
    assert sorted(map(tuple, same.collect())) == sorted(map(tuple, labels.collect()))


# --- tails, checkpoints, tenants


def read_tail(reader, start, end):
    return [row for part in reader.partitions(start, end) for row in reader.read(part)]


@pytest.mark.parametrize("step", [5, 1 << 20])
def test_tail_reads_each_line_once(tmp_path, step):
    reader = TailReader(str(tmp_path), step)
    log = tmp_path / "a.log"
    log.write_bytes(b"one\ntwo\r\nthr")
    (tmp_path / "_hidden").write_text("no\n")
    first = reader.latestOffset()
    assert [r[2] for r in read_tail(reader, reader.initialOffset(), first)] == ["one", "two"]
    with open(log, "ab") as f:
        f.write(b"ee\n\n" + "é\n".encode())
    # A new reader, as after a restart.
    reader = TailReader(str(tmp_path), step)
    second = reader.latestOffset()
    assert [r[2] for r in read_tail(reader, first, second)] == ["three", "", "é"]
    assert read_tail(reader, second, second) == []
    # Rotation by renaming: the old file goes on, the new one starts.
    os.rename(log, tmp_path / "a.log.1")
    with open(tmp_path / "a.log.1", "ab") as f:
        f.write(b"late\n")
    log.write_bytes(b"new\n")
    third = reader.latestOffset()
    assert sorted(r[2] for r in read_tail(reader, second, third)) == ["late", "new"]
    # Rotation by truncation: the file starts anew.
    with open(log, "r+b") as f:
        f.truncate(0)
        f.write(b"x\n")
    fourth = reader.latestOffset()
    assert [r[2] for r in read_tail(reader, third, fourth)] == ["x"]


def test_checkpoint_sink_runs_a_batch_once(spark):
    sink = CheckpointSink(spark, scratch_path(spark, "sink"), every=10)
    for batch, n in enumerate([4, 4, 4, 0, 9, 1]):
        sink(spark.range(batch * 100, batch * 100 + n), batch)
        sink(spark.range(n), batch)
    assert [(k, n) for k, _, n in sink.checkpoints()] == [(1, 12), (2, 22)]
    assert sink.load().count() == 22 and sink.load(sink.checkpoints()[0][1]).count() == 12
    assert sink.store.manifest()["note"]["batch"] == 5


def test_tenant_plan_reads_one_partition(spark):
    path = scratch_path(spark, "tenants")
    rows = spark.range(100).select("id", tenant_of(F.when(F.col("id") % 5 > 0, F.col("id") % 5)).alias("tenant"))
    table = TenantTable(spark, path)
    table.append(rows)
    assert {r["tenant"]: r["n"] for r in table.tenants().collect()} == {"default": 20, **{f"user-{i}": 20 for i in range(1, 5)}}
    one = table.rows("user-2")
    assert "PartitionFilters: [isnotnull(tenant" in one._jdf.queryExecution().toString() and one.count() == 20
    read = {f.split("tenant=")[1].split("/")[0] for f in one.inputFiles()}
    table.replace(spark.createDataFrame([(7, "user-2")], "id long, tenant string"))
    assert table.rows("user-2").count() == 1 and table.rows("user-3").count() == 20 and "user-2" in read
