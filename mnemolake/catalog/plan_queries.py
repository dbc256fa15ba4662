"""Composite jobs: batch writes and scheduled maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import concepts
from ..plans import maintenance, remember
from . import query
from .retrieval_queries import BM25_SQL, BRIDGE_SQL, ITEM_CONCEPTS_SQL, document_bridge, item_concepts
from .similarity_queries import CLUSTERS_SQL
from .views import NOW, access_log, memories, table


@query(
    "remember_supersedes",
    f"""WITH {BM25_SQL}, {BRIDGE_SQL}, {ITEM_CONCEPTS_SQL},
    r AS (SELECT query_id, memory_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, memory_id) AS rank FROM bm WHERE score > 0 QUALIFY rank <= 10),
    dw AS (SELECT memory_id, list_distinct(words) AS w FROM idx), qw AS (SELECT item_id AS query_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM benchmark),
    dc AS (SELECT memory_id, list(concept) AS c FROM mc GROUP BY memory_id), qcs AS (SELECT query_id, list(concept) AS c FROM qc GROUP BY query_id),
    p AS (SELECT r.*, len(list_intersect(dw.w, qw.w)) AS wi, len(dw.w) + len(qw.w) AS ws, len(list_intersect(coalesce(dc.c, []), coalesce(qcs.c, []))) AS ci, coalesce(len(dc.c), 0) + coalesce(len(qcs.c), 0) AS cs
      FROM r JOIN dw USING (memory_id) JOIN qw USING (query_id) LEFT JOIN dc USING (memory_id) LEFT JOIN qcs USING (query_id)),
    s AS (SELECT *, 0.7 * wi / (ws - wi) + 0.3 * CASE WHEN cs = 0 THEN 0 ELSE ci / (cs - ci) END AS sim FROM p)
    SELECT query_id AS memory_id, min_by(memory_id, rank) AS target_id, round(min_by(sim, rank), 6) AS similarity FROM s WHERE sim >= 0.3 GROUP BY query_id""",
)
def remember_supersedes(spark, sf):
    """Passages written into the document store: which document each one replaces."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("memory_id"), F.col("text").alias("content"))
    new = table(spark, sf, "benchmark").select(F.col("item_id").alias("memory_id"), F.col("text").alias("content"))
    links = item_concepts(spark, sf).withColumnRenamed("query_id", "memory_id")
    return remember.superseded(new, docs, links, document_bridge(spark, sf, docs))


_TURNS_SQL = """t AS (SELECT conv_id, turn, text AS content, CASE WHEN role = 'system' THEN 'unknown' ELSE 'fact' END AS memory_type,
      CASE turn % 3 WHEN 0 THEN 'public' WHEN 1 THEN 'shared' ELSE 'private' END AS scope FROM conversations),
    k AS (SELECT *, CASE WHEN coalesce(trim(content), '') = '' THEN 'empty text' WHEN memory_type <> 'fact' THEN 'unknown type' END AS reason FROM t)"""


def _turns(spark, sf):
    kind = F.when(F.col("role") == "system", "unknown").otherwise("fact")
    scope = F.element_at(F.array(*[F.lit(s) for s in ("public", "shared", "private")]), (F.col("turn") % 3 + 1).cast("int"))
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", F.col("text").alias("content"), kind.alias("memory_type"), scope.alias("scope")
    )


@query(
    "remember_batch",
    f"""WITH {_TURNS_SQL}, v AS (SELECT *, lower(trim(content)) AS s FROM k WHERE reason IS NULL),
    d AS (SELECT lower(trim(text)) AS s, max(doc_id) AS stored FROM documents GROUP BY 1),
    n AS (SELECT v.*, stored, count(*) OVER (PARTITION BY s) AS copies FROM v LEFT JOIN d USING (s))
    SELECT conv_id, turn, scope, sha256(s) AS signature, copies, stored AS stored_copy FROM n""",
)
def remember_batch(spark, sf):
    """Conversation turns as a write batch: every valid row with its scope, the copies of its text and the stored one."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("memory_id"), F.col("text").alias("content"))
    out = remember.remember(_turns(spark, sf), NOW, last_id=1_000_000)
    edges = remember.equal_text_edges(out, docs)
    sig = remember.signature(F.col("content")).alias("signature")
    # The chain of one text: a row per copy, and at most one edge to a stored row.
    chains = out.select("memory_id", sig).join(edges, "memory_id", "left").groupBy("signature").agg(
        F.count("*").alias("copies"), F.max(F.when(F.col("target_id") <= 1_000_000, F.col("target_id"))).alias("stored_copy")
    )
    return out.select("conv_id", "turn", "scope", sig).join(chains, "signature")


@query("remember_rejected", f"WITH {_TURNS_SQL} SELECT conv_id, turn, reason FROM k WHERE reason IS NOT NULL")
def remember_rejected(spark, sf):
    """The turns that are not stored, with the reason."""
    return remember.rejected(_turns(spark, sf), NOW).select("conv_id", "turn", "reason")


@query(
    "sleep_report",
    f"""WITH RECURSIVE {CLUSTERS_SQL}, k AS (SELECT component FROM cl GROUP BY component HAVING count(*) >= 3),
    a AS (SELECT lang, sum(n) AS access FROM documents JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) ON user_id = doc_id GROUP BY lang HAVING sum(n) >= 3),
    d AS (SELECT lang, dayname(make_timestamp((({NOW} - n_chars * 1800) * 1000000)::BIGINT)) AS w, count(*) AS n FROM documents GROUP BY ALL),
    s AS (SELECT lang FROM d GROUP BY lang HAVING max(n) >= 3 AND max(n) / sum(n) >= 0.66)
    SELECT (SELECT count(*) FROM k) AS consolidated, (SELECT count(*) FROM a) AS promoted, (SELECT count(*) FROM s) AS patterns, 0::BIGINT AS pruned, 0::BIGINT AS concepts_merged""",
)
def sleep_report(spark, sf):
    """Documents with their language as concept; recent accesses keep every language warm."""
    rows = memories(spark, sf)
    bridge = rows.select("memory_id", F.col("lang").alias("concept"))
    heat = concepts.activations_from(access_log(spark, sf).select("memory_id", "ts"), bridge)
    return maintenance.sleep_report(rows, bridge, heat, NOW)
