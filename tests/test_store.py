import hashlib
import json
import time

import pytest
from pyspark.sql import functions as F

from mnemolake.functions import hashing as hx
from mnemolake.operators import lifecycle, store, sync
from mnemolake.plans import context_pack, remember
from mnemolake.sources import container, importers, oplog, packs, receipts
from mnemolake.streaming import batches


def test_replay_rules(spark):
    ops = [
        (1, "insert_memory", 1, '{"a":"x","b":"y"}'),
        (2, "update_memory", 1, '{"a":null}'),
        (3, "update_memory", 2, '{"a":"ghost"}'),
        (4, "insert_memory", 3, '{"a":"old","c":"gone"}'),
        (5, "delete_memory", 3, '{"id":3}'),
        (6, "update_memory", 3, '{"a":"late"}'),
        (7, "insert_memory", 3, '{"a":"new"}'),
        (8, "insert_memory", 4, '{"a":"z"}'),
        (9, "delete_memory", 4, '{"id":4}'),
    ]
    df = spark.createDataFrame(ops, "seq long, op string, id long, data string")
    got = {r["id"]: r["fields"] for r in store.replay(df).collect()}
    assert got == {1: {"a": None, "b": "y"}, 3: {"a": "new"}}


def test_oplog_skips_malformed_lines(spark, tmp_path):
    path = str(tmp_path / "log")
    ops = spark.createDataFrame([(1, 1.0, "insert_memory", '{"id":7,"content":"a \\"b\\""}')], "seq long, timestamp double, operation string, data string")
    oplog.append(ops, path)
    (tmp_path / "log" / "part-bad.txt").write_text('{"seq": broken\n')
    row = oplog.scan(spark, path).collect()
    assert [(r["op"], r["id"], json.loads(r["data"])["content"]) for r in row] == [("insert_memory", 7, 'a "b"')]


def test_snapshots_and_checkpoints(spark, tmp_path):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k long, v string")
    b = spark.createDataFrame([(2, "z"), (3, "w")], "k long, v string")
    oplog.write_snapshot(a, str(tmp_path / "snap"), 1)
    oplog.write_snapshot(b, str(tmp_path / "snap"), 2)
    assert sorted(r["k"] for r in oplog.latest_snapshot(spark, str(tmp_path / "snap")).collect()) == [2, 3]
    cp = store.Checkpoints(spark, str(tmp_path / "cp"))
    cp.create("first", a, "k", 10.0)
    cp.create("second", b, "k", 20.0)
    assert [r["name"] for r in cp.manifest().collect()] == ["second", "first"]
    assert {(r["k"], r["change"]) for r in cp.diff("first", "second", "k", ["v"]).collect()} == {(1, "removed"), (2, "changed"), (3, "added")}
    cp.delete("first", 30.0)
    with pytest.raises(ValueError):
        cp.load("first")


def test_assign_ids_are_dense(spark):
    df = spark.range(500).select(F.col("id").alias("x"))
    got = sorted(r["memory_id"] for r in store.assign_ids(df, 1000, ["x"]).collect())
    assert got == list(range(1001, 1501))


def test_content_hash_equals_canonical_json(spark):
    text = 'Zürich "quoted" \\ back\nline 😀 end'
    meta = {"b": "ü", "a": "1"}
    want = hashlib.sha256(
        json.dumps({"content": text, "memory_type": "fact", "metadata": meta}, sort_keys=True, ensure_ascii=True).encode()
    ).hexdigest()
    df = spark.createDataFrame([(text, "fact", meta)], "c string, t string, m map<string,string>")
    assert df.select(hx.content_hash(F.col("c"), F.col("t"), F.col("m"))).first()[0] == want


def test_clocks(spark):
    cases = [({"a": 1}, {"a": 2}, "before"), ({"a": 2}, {"a": 1}, "after"), ({"a": 1}, {"b": 1}, "concurrent"), ({"a": 1, "b": 0}, {"a": 1}, "equal")]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, a map<string,bigint>, b map<string,bigint>")
    rows = df.select("i", hx.clock_order(F.col("a"), F.col("b")).alias("o"), hx.clock_merge(F.col("a"), F.col("b")).alias("m")).orderBy("i").collect()
    assert [r["o"] for r in rows] == [c[2] for c in cases]
    assert rows[2]["m"] == {"a": 1, "b": 1}


def test_merkle_depth_and_delta(spark):
    hashes = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(300)]
    df = spark.createDataFrame([(h,) for h in hashes], "hash string")
    flat = {r["bucket"]: r["digest"] for r in sync.merkle_buckets(df).collect()}
    def digest(parts, sep=""):
        return hashlib.sha256(sep.join(parts).encode()).hexdigest()

    for b in range(256):
        members = sorted(h for h in hashes if int(h[:2], 16) == b)
        leaves = {p: digest([h for h in members if h[:6] == p], "\n") for p in sorted({h[:6] for h in members})}
        inner = {p: digest([d for q, d in leaves.items() if q[:4] == p]) for p in sorted({h[:4] for h in members})}
        assert flat[b] == digest(inner.values())
    root = hashlib.sha256("".join(flat[b] for b in range(256)).encode()).hexdigest()
    assert sync.merkle_root(sync.merkle_buckets(df)).first()["root"] == root
    deep = sync.merkle_levels(df, 2)
    assert sum(r["n"] for r in deep[0].collect()) == 300 == sum(r["n"] for r in deep[1].collect())
    local = df.filter(F.col("hash") != hashes[0])
    assert [r["hash"] for r in sync.missing_rows(local, df).collect()] == [hashes[0]]
    assert [r["hash"] for r in sync.missing_rows(local, df, depth=2).collect()] == [hashes[0]]


def test_container_round_trip(spark, tmp_path):
    path = str(tmp_path / "box")
    mem = spark.createDataFrame([(i, f"text {i} ü", float(i)) for i in range(50)], "memory_id long, content string, created_at double").repartition(3)
    edges = spark.createDataFrame([(1, 2, "related", 0.5), (1, 99, "related", 0.5)], "source_id long, target_id long, edge_type string, weight double")
    container.export(path, mem, edges=edges, now=5.0, source_agent="me")
    back = container.read_section(spark, path, "memories", "id long, content string, created_at double")
    assert sorted(map(tuple, back.collect())) == [(i, f"text {i} ü", float(i)) for i in range(50)]
    assert container.read_section(spark, path, "edges", "source_id long, target_id long").count() == 1
    assert container.read_section(spark, path, "metadata", "source_agent string").first()["source_agent"] == "me"
    assert all(r["ok"] for r in container.verify(spark, path).collect())
    victim = sorted((tmp_path / "box").glob("*.mem"))[0]
    raw = bytearray(victim.read_bytes())
    raw[-10] ^= 0xFF
    victim.write_bytes(bytes(raw))
    assert sum(not r["ok"] for r in container.verify(spark, path).collect()) == 1
    with pytest.raises(ValueError):
        container.read_directory(__file__)


def test_pack_checksum(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "memory_id long, content string")
    path = packs.save_pack(spark, str(tmp_path), "My Topic!", {"memories": df}, 7.0, 30)
    assert path.endswith("my-topic-7")
    assert packs.load_pack(spark, path)["memories"].count() == 2
    df.limit(1).write.mode("append").parquet(f"{path}/memories")
    with pytest.raises(ValueError):
        packs.load_pack(spark, path)


def test_inbox_and_receipts(spark, tmp_path):
    box = receipts.Inbox(spark, str(tmp_path / "inbox"))
    rows = spark.createDataFrame([("alpha beta alpha", "fact", "{}"), ("gamma", "fact", "{}")], "content string, memory_type string, metadata string")
    box.submit(rows, 1.0)
    assert [r["score"] for r in box.search("alpha").collect()] == [2]
    found = box.pending().filter("content = 'gamma'").first()["id"]
    ids = spark.createDataFrame([(found,)], "id string")
    box.pin(ids, 2.0)
    assert [r["content"] for r in box.pending().collect()] == ["gamma", "alpha beta alpha"]
    box.redact(ids, "[gone]", 3.0)
    assert [r["content"] for r in box.approve(ids, 4.0).collect()] == ["[gone]"]
    assert box.pending().count() == 1
    log = spark.createDataFrame([("deny", 1.0), ("allow", 2.0)], "decision string, timestamp double").withColumn("receipt_id", F.lit(None).cast("string"))
    receipts.write_receipts(log, str(tmp_path / "r"))
    last = receipts.last_receipts(spark, str(tmp_path / "r"), 1).first()
    assert (last["decision"], last["app_id"], last["matched_rules"]) == ("allow", "unknown", [])


def test_importers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"text":"hello there friend","tags":["x"],"n":3}\nnot json\n{"text":"ok"}\n')
    row = importers.from_jsonl(spark, str(tmp_path / "a.jsonl")).collect()
    assert [r["content"] for r in row] == ["hello there friend"]
    assert json.loads(row[0]["metadata"]) == {"n": "3", "source_format": "jsonl", "tags": ["jsonl", "source:jsonl", "x"]}
    (tmp_path / "a.csv").write_text('text,who\n"a longer line",ann\n')
    assert json.loads(importers.from_csv(spark, str(tmp_path / "a.csv")).first()["metadata"])["who"] == "ann"
    chat = tmp_path / "chat"
    chat.mkdir()
    (chat / "a.json").write_text(json.dumps({"messages": [{"role": "system", "content": "be nice"}, {"role": "user", "content": "[draft] plan the trip"}]}))
    (chat / "b.json").write_text(json.dumps({"mapping": {"1": {"message": {"author": {"role": "user"}, "content": {"parts": ["first part", "second"]}}}, "2": {"message": None}}}))
    (chat / "c.txt").write_text("12/01/2024, 10:00 - Ann Lee: see you at noon\n12/01/2024, 10:01 - Bob: fine with me\n")
    (chat / "d.txt").write_text("Alice: what a day\n\njust a paragraph")
    got = {(r["content"], json.loads(r["metadata"])["speaker"]) for r in importers.from_chat(spark, str(chat)).collect()}
    assert got == {
        ("[draft] plan the trip", "user"), ("first part second", "user"), ("see you at noon", "Ann Lee"),
        ("fine with me", "Bob"), ("what a day", "Alice"), ("just a paragraph", "unknown"),
    }


def test_markdown_import(spark, tmp_path):
    (tmp_path / "n.md").write_text("---\ntitle: \"My note\"\ntags:\n  - one\n  - two\n---\nintro text here\n# First\nbody one\n\nmore\n## Empty\n### Last part\nend of it\n")
    (tmp_path / "p.md").write_text("para one is here\n\n\npara two is here")
    rows = importers.from_markdown(spark, str(tmp_path)).collect()
    assert {r["content"] for r in rows} == {"intro text here", "First\nbody one\n\nmore", "Last part\nend of it", "para one is here", "para two is here"}
    meta = json.loads(next(r["metadata"] for r in rows if r["content"].startswith("First")))
    assert meta["title"] == "My note" and meta["tags"] == ["markdown", "one", "source:markdown", "two"]


def test_retention_and_erasure(spark):
    now = 100 * 86400.0
    rows = [(1, "a", 0.0, 0, '{"tags":["keep","user:7"]}'), (2, "b", 99 * 86400.0, 5, '{"ttl_days":0.5}'), (3, "c", 0.0, 0, None)]
    df = spark.createDataFrame(rows, "memory_id long, content string, created_at double, access_count long, metadata string").withColumn("memory_type", F.lit("fact"))
    assert sorted(r["memory_id"] for r in lifecycle.ttl_expired(df, now, 30).collect()) == [1, 2, 3]
    assert sorted(r["memory_id"] for r in lifecycle.ttl_expired(df, now, 30, pin_tag="keep").collect()) == [2, 3]
    out = lifecycle.apply_retention(df, [{"tag": "keep", "action": "archive"}, {"min_access": 0}], now)
    assert {r["memory_id"]: r["action"] for r in out.collect()} == {1: "archive", 2: "keep", 3: "delete"}
    assert json.loads(lifecycle.archived(out, now).filter("memory_id = 1").first()["metadata"])["archived"] == "true"
    assert [r["memory_id"] for r in lifecycle.erasure_ids(df, user_id="7").collect()] == [1]
    with pytest.raises(ValueError):
        lifecycle.erasure_ids(df)


def test_budget_fold_equals_loop(spark):
    texts = ["a" * n for n in (50, 30, 90, 20, 10, 40)]
    for budget in (0, 15, 60, 120, 200, 500):
        left, picked = budget, []
        for i, t in enumerate(texts):
            if left <= 0:
                break
            line = f"{i}:{t}"
            if len(line) <= left:
                picked.append(i)
                left -= len(line) + 2
            elif not picked:
                picked.append(i)
                left = 0
                break
        ranked = spark.createDataFrame([(1, i + 1, i, float(-i)) for i in range(6)], "query_id long, rank int, memory_id long, score double")
        mem = spark.createDataFrame([(i, t, 0.0) for i, t in enumerate(texts)], "memory_id long, content string, created_at double")
        q = spark.createDataFrame([(1, "q")], "query_id long, query string")
        row = context_pack.compile_context(ranked, mem, q, budget=budget).first()
        assert (row["memory_ids"], row["room_left"]) == (picked, left)


def test_stream_batches_and_episodes(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.createDataFrame([("a", f"m{i}") for i in range(12)], "key string, text string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, text string").parquet(str(tmp_path / "in"))
    # Processing-time timers keep a query alive, so it is stopped once the rest has timed out.
    q = (
        batches.batched(stream, "key", 5, 2_000)
        .writeStream.format("memory").queryName("blocks").outputMode("append")
        .option("checkpointLocation", str(tmp_path / "c1")).trigger(processingTime="1 second").start()
    )
    deadline = time.time() + 60
    while time.time() < deadline and spark.sql("select * from blocks").count() < 3 and q.isActive:
        q.awaitTermination(1)
    q.stop()
    rows = spark.sql("select * from blocks").collect()
    assert [r["n"] for r in rows] == [5, 5, 2] and rows[0]["block"].splitlines()[0] == "[1] m0"
    ev = [("u", i, float(t)) for i, t in enumerate((0, 1000, 1799, 1800, 3000, 3599, 9000))]
    spark.createDataFrame(ev, "k string, event_id long, ts double").coalesce(1).write.parquet(str(tmp_path / "ev"))
    es = spark.readStream.schema("k string, event_id long, ts double").parquet(str(tmp_path / "ev"))
    q = batches.episodes(es, "k").writeStream.format("memory").queryName("eps").outputMode("append").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    assert q.awaitTermination(90)
    got = {r["event_id"]: r["episode_start"] for r in spark.sql("select * from eps").collect()}
    assert got == {0: 0.0, 1: 0.0, 2: 0.0, 3: 1800.0, 4: 1800.0, 5: 1800.0, 6: 9000.0}


def test_remember_keeps_every_valid_row(spark):
    """One stored text, the same new text twice, one empty, one of unknown type."""
    stored = spark.createDataFrame([(1, "Tea is good")], "memory_id long, content string")
    rows = spark.createDataFrame(
        [("tea is good ", "fact", "public"), ("Tea is good", "fact", "private"), (" ", "fact", "public"), ("x", "odd", "public"), (None, "fact", None)],
        "content string, memory_type string, scope string",
    )
    new = remember.remember(rows, 5.0, last_id=10)
    got = sorted((r["memory_id"], r["scope"]) for r in new.collect())
    assert [i for i, _ in got] == [11, 12] and {s for _, s in got} == {"public", "private"}
    edges = {r["memory_id"]: r["target_id"] for r in remember.equal_text_edges(new, stored).collect()}
    assert edges == {11: 1, 12: 11}
    reasons = sorted(r["reason"] for r in remember.rejected(rows, 5.0).collect())
    assert reasons == ["empty text", "empty text", "unknown type"]


def test_table_digest_tells_repeated_rows_apart(spark):
    once = spark.createDataFrame([(1, "a"), (2, None)], "id long, x string")
    assert store.table_digest(once, "id").first() == store.table_digest(once.orderBy("x"), "id").first()
    assert store.table_digest(once.union(once), "id").first()["digest"] != store.table_digest(once.union(once).union(once), "id").first()["digest"]


def test_streams_read_a_table_of_one_file_or_of_many(spark, tmp_path):
    from mnemolake.streaming import windows

    spark.range(6).coalesce(1).write.parquet(str(tmp_path / "many" / "t.parquet"))
    part = next((tmp_path / "many" / "t.parquet").glob("part-*.parquet"))
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "t.parquet").write_bytes(part.read_bytes())
    for kind in ("many", "one"):
        rows = windows.read_table(spark, str(tmp_path / kind), "t.parquet")
        got = windows.run_available(rows, str(tmp_path / f"out_{kind}"), str(tmp_path / f"ck_{kind}"))
        assert sorted(r["id"] for r in got.collect()) == list(range(6))
