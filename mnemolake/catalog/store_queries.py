"""Log replay, merges, diffs, sync, imports and containers over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing as hx
from ..operators import similarity, store, sync
from ..operators.retrieval import bm25_top
from ..plans import context_pack
from ..sources import importers, packs
from . import query
from .retrieval_queries import BM25_SQL, document_bridge
from .views import MEMORIES_SQL, NOW, access_log, epoch, memories, passage_queries, table

OPS_SQL = """
ops AS (SELECT event_id AS seq, CASE event_type WHEN 'signup' THEN 'insert_memory' WHEN 'error' THEN 'delete_memory' ELSE 'update_memory' END AS op,
  user_id AS id, event_type, props, value FROM events)"""


def event_ops(spark, sf):
    """events as a log: sign-ups insert, errors delete, the rest update one field each."""
    kind = F.col("event_type")
    op = F.when(kind == "signup", "insert_memory").when(kind == "error", "delete_memory").otherwise("update_memory")
    value = F.format_string("%.2f", "value")
    data = (
        F.when(kind == "signup", F.concat(F.lit('{"name":"u","score":'), value, F.lit("}")))
        .when(kind == "purchase", F.concat(F.lit('{"score":'), value, F.lit("}")))
        .when(kind == "click", F.lit('{"name":null}'))
        .otherwise(F.concat(F.lit('{"seen":'), F.get_json_object("props", "$.k"), F.lit("}")))
    )
    return table(spark, sf, "events").select(F.col("event_id").alias("seq"), op.alias("op"), F.col("user_id").alias("id"), data.alias("data"))


@query(
    "log_replay",
    f"""WITH {OPS_SQL}, l AS (SELECT id, max(seq) FILTER (op = 'insert_memory') AS born, max(seq) FILTER (op = 'delete_memory') AS died FROM ops GROUP BY id),
    a AS (SELECT id, born FROM l WHERE born IS NOT NULL AND (died IS NULL OR born > died)),
    o AS (SELECT ops.* FROM ops JOIN a USING (id) WHERE seq >= born)
    SELECT id, CASE WHEN max(seq) FILTER (event_type = 'click') IS NULL THEN 'u' END AS name,
      max_by(printf('%.2f', value), seq) FILTER (event_type IN ('signup', 'purchase')) AS score,
      max_by(props->>'$.k', seq) FILTER (event_type = 'view') AS seen FROM o GROUP BY id""",
)
def log_replay(spark, sf):
    rows = store.replay(event_ops(spark, sf))
    pick = {k: F.try_element_at("fields", F.lit(k)) for k in ("name", "score", "seen")}
    return rows.select(
        "id", pick["name"].alias("name"), F.format_string("%.2f", pick["score"].cast("double")).alias("score"), pick["seen"].alias("seen")
    )


@query(
    "update_merge",
    """WITH c AS (SELECT s_suppkey AS k, s_acctbal * 2 AS bal FROM supplier WHERE s_nationkey < 10 UNION ALL SELECT s_suppkey + 1000000, s_acctbal FROM supplier WHERE s_nationkey = 3)
    SELECT coalesce(s_suppkey, k) AS s_suppkey, s_name, s_nationkey, round(coalesce(bal, s_acctbal), 2) AS s_acctbal FROM supplier FULL JOIN c ON s_suppkey = k""",
)
def update_merge(spark, sf):
    base = table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    doubled = base.filter("s_nationkey < 10").select("s_suppkey", (F.col("s_acctbal") * 2).alias("s_acctbal"))
    added = base.filter("s_nationkey = 3").select((F.col("s_suppkey") + 1000000).alias("s_suppkey"), "s_acctbal")
    return store.upsert(base, doubled.unionByName(added), "s_suppkey").withColumn("s_acctbal", F.round("s_acctbal", 2))


@query(
    "delete_cascade",
    """WITH gone AS (SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'P'),
    e AS (SELECT o_orderkey AS source_id, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS target_id FROM orders)
    SELECT source_id, target_id FROM e WHERE target_id IS NOT NULL AND source_id NOT IN (SELECT id FROM gone) AND target_id NOT IN (SELECT id FROM gone)""",
)
def delete_cascade(spark, sf):
    """Edges that remain when all pending orders are forgotten."""
    from ..operators import lifecycle
    from ..operators.splits import with_neighbor

    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("memory_id"), "o_custkey", "o_orderstatus", epoch("o_orderdate").alias("ts")
    )
    near = with_neighbor(orders, ["o_custkey"], "ts", "memory_id", ["memory_id"], slice_seconds=7 * 86400.0)
    edges = near.filter("prev_memory_id IS NOT NULL").select(F.col("memory_id").alias("source_id"), F.col("prev_memory_id").alias("target_id"))
    _, kept = lifecycle.forget(orders, orders.filter("o_orderstatus = 'P'"), edges=edges)
    return kept.select("source_id", "target_id")


CHECKPOINT_SQL = """
a AS (SELECT o_custkey AS k, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS v FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01' GROUP BY 1),
b AS (SELECT o_custkey AS k, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS v FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1999-01-01' GROUP BY 1)"""


def _beliefs_between(spark, sf, start: str | None, end: str):
    o = table(spark, sf, "orders").filter(F.col("o_orderdate") < F.lit(end).cast("timestamp_ntz"))
    if start:
        o = o.filter(F.col("o_orderdate") >= F.lit(start).cast("timestamp_ntz"))
    return o.groupBy(F.col("o_custkey").alias("k")).agg(F.max_by("o_orderpriority", F.struct("o_orderdate", "o_orderkey")).alias("v"))


@query(
    "checkpoint_diff",
    f"""WITH {CHECKPOINT_SQL} SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' ELSE 'changed' END AS change, a.v AS old_v, b.v AS new_v
    FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.v <> b.v""",
)
def checkpoint_diff(spark, sf):
    """A customer's newest priority in two states of the store."""
    old = _beliefs_between(spark, sf, None, "1997-01-01")
    new = _beliefs_between(spark, sf, "1996-01-01", "1999-01-01")
    return store.snapshot_diff(old, new, "k", ["v"])


@query(
    "pack_signature_diff",
    """WITH d AS (SELECT sha256(lower(trim(text))) AS signature, regexp_extract(source, '([0-9]+)', 1)::INT AS s FROM documents),
    a AS (SELECT signature, count(*) AS n FROM d WHERE s < 12 GROUP BY 1), b AS (SELECT signature, count(*) AS n FROM d WHERE s >= 8 GROUP BY 1)
    SELECT coalesce(a.signature, b.signature) AS signature, CASE WHEN b.n IS NULL THEN 'missing' WHEN a.n IS NULL THEN 'extra' ELSE 'match' END AS side,
      coalesce(a.n, 0) AS n_old, coalesce(b.n, 0) AS n_new FROM a FULL JOIN b ON a.signature = b.signature""",
)
def pack_signature_diff(spark, sf):
    number = F.regexp_extract("source", r"(\d+)", 1).cast("int")
    m = memories(spark, sf)
    return packs.replay(m.filter(number < 12), m.filter(number >= 8))


@query(
    "pack_topic",
    f"WITH m AS ({MEMORIES_SQL}) SELECT memory_id, created_at, sha256(lower(trim(content))) AS signature FROM m WHERE created_at >= {NOW} - 60 * 86400.0 AND contains(lower(content), 'tion the')",
)
def pack_topic(spark, sf):
    rows = packs.topic_memories(memories(spark, sf), "tion the", NOW, 60)
    return rows.select("memory_id", "created_at", F.sha2(F.lower(F.trim("content")), 256).alias("signature"))


HASH_SQL = """
h AS (SELECT c_custkey AS id, c_nationkey AS nation, c_acctbal AS bal, sha256('{"content": "' || c_name || '", "memory_type": "' || lower(c_mktsegment) || '", "metadata": {}}') AS hash FROM customer)"""


def customer_store(spark, sf):
    cust = table(spark, sf, "customer")
    hashed = hx.content_hash(F.col("c_name"), F.lower("c_mktsegment"))
    return cust.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("bal"), hashed.alias("hash"))


@query("content_hash", f"WITH {HASH_SQL} SELECT id, hash FROM h")
def content_hash(spark, sf):
    return customer_store(spark, sf).select("id", "hash")


_BUCKETS = """(SELECT b.bucket::INT AS bucket, coalesce(digest, sha256('')) AS digest, coalesce(n, 0)::BIGINT AS n FROM range(256) b(bucket)
   LEFT JOIN (SELECT ('0x' || left(p, 2))::INT AS bucket, sha256(string_agg(digest, '' ORDER BY p)) AS digest, sum(n) AS n FROM
     (SELECT left(p, 4) AS p, sha256(string_agg(digest, '' ORDER BY p)) AS digest, sum(n) AS n FROM
       (SELECT left(hash, 6) AS p, sha256(string_agg(hash, chr(10) ORDER BY hash)) AS digest, count(*) AS n FROM (SELECT DISTINCT hash FROM {src}) GROUP BY 1)
     GROUP BY 1) GROUP BY 1) USING (bucket))"""


@query("merkle_buckets", f"WITH {HASH_SQL} SELECT * FROM {_BUCKETS.format(src='h')}")
def merkle_buckets(spark, sf):
    return sync.merkle_buckets(customer_store(spark, sf))


@query(
    "merkle_root",
    f"WITH {HASH_SQL}, b AS {_BUCKETS.format(src='h')} SELECT sha256(string_agg(digest, '' ORDER BY bucket)) AS root, sum(n)::BIGINT AS n FROM b",
)
def merkle_root(spark, sf):
    return sync.merkle_root(sync.merkle_buckets(customer_store(spark, sf)))


@query(
    "delta_missing",
    f"WITH {HASH_SQL} SELECT id, hash FROM h WHERE hash NOT IN (SELECT hash FROM h WHERE nation < 20)",
)
def delta_missing(spark, sf):
    """The local store holds the customers of the first twenty nations."""
    remote = customer_store(spark, sf)
    return sync.missing_rows(remote.filter("nation < 20"), remote).select("id", "hash")


@query(
    "federated_merge",
    """WITH c AS (SELECT event_type || '/' || user_id AS hash, 'node' || (props->>'$.k')::INT % 5 AS node, event_id, epoch(ts) AS created_at FROM events),
    t AS (SELECT hash, node, max(event_id) AS n FROM c GROUP BY ALL)
    SELECT hash, list_sort(list(node)) AS namespaces, list(n ORDER BY node) AS ticks, round(any_value(first_at), 3) AS created_at
    FROM t JOIN (SELECT hash, min(created_at) AS first_at FROM c GROUP BY hash) USING (hash) GROUP BY hash""",
)
def federated_merge(spark, sf):
    """Every event is a copy of one entry from one node: namespaces unite, clocks take the maximum."""
    node = F.concat(F.lit("node"), (F.get_json_object("props", "$.k").cast("int") % 5).cast("string"))
    rows = access_log(spark, sf).select(
        F.concat_ws("/", "event_type", F.col("memory_id").cast("string")).alias("hash"),
        F.lit("").alias("content"),
        F.lit("fact").alias("memory_type"),
        node.alias("origin_node"),
        F.col("ts").alias("created_at"),
        F.array(node).alias("namespaces"),
        F.create_map(node, F.col("event_id")).alias("vclock"),
        F.array().cast("array<string>").alias("supersedes"),
    )
    merged = sync.merge_entries(rows)
    return merged.select(
        "hash", "namespaces", F.map_values("vclock").alias("ticks"), F.round("created_at", 3).alias("created_at")
    )


@query(
    "resolve_conflicts",
    """WITH v AS (SELECT user_id AS item_id, event_type IN ('view', 'click') AS local, max(epoch(ts)) AS created_at,
        count(*) FILTER (event_type IN ('view', 'signup')) AS a, count(*) FILTER (event_type NOT IN ('view', 'signup')) AS b FROM events GROUP BY ALL),
    j AS (SELECT l.item_id, l.created_at AS la, r.created_at AS ra, l.a AS xa, l.b AS xb, r.a AS ya, r.b AS yb FROM v l JOIN v r ON l.item_id = r.item_id AND l.local AND NOT r.local)
    SELECT item_id, CASE WHEN xa <= ya AND xb <= yb AND NOT (ya <= xa AND yb <= xb) THEN 'remote' WHEN ya <= xa AND yb <= xb AND NOT (xa <= ya AND xb <= yb) THEN 'local'
      WHEN ra >= la THEN 'remote' ELSE 'local' END AS winner, greatest(xa, ya) AS clock_a, greatest(xb, yb) AS clock_b FROM j""",
)
def resolve_conflicts(spark, sf):
    """Two versions of each user's row with counters of two nodes as clocks."""
    local = F.col("event_type").isin("view", "click")
    on_a = F.col("event_type").isin("view", "signup")
    both = (
        access_log(spark, sf)
        .groupBy(F.col("memory_id").alias("item_id"), local.alias("local"))
        .agg(F.max("ts").alias("created_at"), F.count_if(on_a).alias("a"), F.count_if(~on_a).alias("b"))
        .select(
            "item_id", "local", "created_at",
            F.create_map(F.lit("a"), "a", F.lit("b"), "b").alias("vclock"),
            F.array().cast("array<string>").alias("supersedes"),
            F.col("created_at").cast("string").alias("payload"),
        )
    )
    out = sync.resolve(both.filter("local").drop("local"), both.filter("NOT local").drop("local"))
    return out.select("item_id", "winner", F.col("vclock")["a"].alias("clock_a"), F.col("vclock")["b"].alias("clock_b"))


@query(
    "chat_import",
    """WITH t AS (SELECT conv_id, turn, role, trim(text) AS content FROM conversations WHERE role <> 'system')
    SELECT conv_id, turn, role AS speaker, content FROM t""",
)
def chat_import(spark, sf):
    """Turns as JSON chat exports, one message each, through the message reader."""
    conv = table(spark, sf, "conversations")
    export = F.to_json(F.struct(F.array(F.struct("role", F.col("text").alias("content"))).alias("messages")))
    return importers.json_messages(conv.select("conv_id", "turn", export.alias("value")), keep=["conv_id", "turn"])


@query(
    "paragraph_chunks",
    """WITH p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\\n{2,}'), lambda c: trim(c)), lambda c: c <> '') AS chunks FROM documents WHERE NOT regexp_matches(text, '(?m)^#{1,6}\\s+'))
    SELECT doc_id, len(chunks)::BIGINT AS n_chunks, list_max(list_transform(chunks, lambda c: length(c)))::BIGINT AS longest FROM p""",
)
def paragraph_chunks(spark, sf):
    """Documents without headings through the markdown chunker."""
    docs = table(spark, sf, "documents").filter(~F.col("text").rlike(r"(?m)^#{1,6}\s+"))
    chunks = docs.select("doc_id", importers.markdown_chunks(F.col("text")).alias("c"))
    return chunks.select(
        "doc_id", F.size("c").cast("long").alias("n_chunks"), F.array_max(F.transform("c", lambda x: F.length(x))).cast("long").alias("longest")
    )


@query(
    "import_fillers",
    """SELECT conv_id, turn FROM conversations WHERE NOT (trim(text) = '' OR lower(trim(text)) IN ('ok','okay','yeah','yep','no','nah','hi','hey','hmm','um','thanks','thank you','thx')
       OR (len(regexp_split_to_array(trim(text), '\\s+')) <= 2 AND regexp_matches(regexp_replace(trim(text), '[!?]', '', 'g'), '^[a-zA-Z]{1,4}$')))""",
)
def import_fillers(spark, sf):
    return table(spark, sf, "conversations").filter(~importers.short_filler(F.col("text"))).select("conv_id", "turn")


@query(
    "table_digest",
    """SELECT count(*) AS n, max(o_orderkey) AS max_o_orderkey, sha256(count(*) || '|' || sum(('0x' || left(sha256(concat_ws('|', o_custkey, strftime(o_orderdate, '%Y-%m-%d'), o_orderkey, coalesce(o_orderpriority, '\\N'))), 15))::BIGINT::HUGEINT)) AS digest FROM orders""",
)
def table_digest(spark, sf):
    """Content digest of four columns of the orders."""
    rows = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("o_orderdate"), "o_orderpriority")
    return store.table_digest(rows, "o_orderkey")


@query(
    "budget_pack",
    f"""WITH RECURSIVE {BM25_SQL}, r AS (SELECT query_id, memory_id, round(score, 6) AS score FROM bm WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, memory_id) <= 10),
    i AS (SELECT query_id, memory_id, length(memory_id || ':' || left(text, 90)) AS cost, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 4) DESC, n_chars, memory_id) AS pos FROM r JOIN documents ON doc_id = memory_id),
    f AS (SELECT query_id, 0::BIGINT AS pos, 400::BIGINT AS room, []::BIGINT[] AS ids, false AS done FROM (SELECT DISTINCT query_id FROM i)
      UNION ALL SELECT f.query_id, i.pos, CASE WHEN done OR room <= 0 THEN room WHEN cost <= room THEN room - cost - 2 WHEN len(ids) = 0 THEN 0 ELSE room END,
        CASE WHEN NOT done AND room > 0 AND (cost <= room OR len(ids) = 0) THEN list_append(ids, memory_id) ELSE ids END, done OR (room > 0 AND cost > room AND len(ids) = 0)
      FROM f JOIN i ON i.query_id = f.query_id AND i.pos = f.pos + 1)
    SELECT query_id, ids AS memory_ids, room AS room_left, n AS n_items FROM f JOIN (SELECT query_id, count(*) AS n FROM i GROUP BY query_id) USING (query_id) WHERE pos = n""",
)
def budget_pack(spark, sf):
    """Ten best documents per passage, packed into 400 characters."""
    docs, ranked = _ranked_documents(spark, sf)
    packed = context_pack.compile_context(ranked, docs, passage_queries(spark, sf), budget=400)
    return packed.select("query_id", "memory_ids", F.col("room_left").cast("long").alias("room_left"), "n_items")


def _ranked_documents(spark, sf):
    docs = table(spark, sf, "documents").select(
        F.col("doc_id").alias("memory_id"), F.col("text").alias("content"), (F.lit(NOW) - F.col("n_chars") * 1800.0).alias("created_at")
    )
    return docs, bm25_top(docs, passage_queries(spark, sf), 10)


@query("context_pack")
def context_pack_full(spark, sf):
    """Full packs: concept summaries, memories, supersedes edges among the recalled rows, compact text."""
    docs, ranked = _ranked_documents(spark, sf)
    bridge = document_bridge(spark, sf, docs)
    reps, members = similarity.collapse_copies(similarity.token_sets(docs))
    edges = members.filter("memory_id <> rep").select(
        F.col("memory_id").alias("source_id"), F.col("rep").alias("target_id"), F.lit("supersedes").alias("edge_type")
    )
    return context_pack.compile_context(ranked, docs, passage_queries(spark, sf), bridge, edges, budget=1200)
