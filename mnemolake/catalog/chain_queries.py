"""Latest facts by similar concepts, chains of superseded rows, and what held at a moment."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import retrieval, temporal
from . import query
from .fact_queries import documents
from .retrieval_queries import BM25_SQL, BRIDGE_SQL, IDX_SQL, document_bridge
from .views import NOW, ORDER_CONCEPTS_SQL, epoch, order_concepts, passage_queries, table


@query(
    "latest_by_concepts",
    f"""WITH RECURSIVE {IDX_SQL}, {BRIDGE_SQL}, s AS (SELECT memory_id, list_sort(list(DISTINCT concept)) AS cs FROM mc GROUP BY memory_id),
    o AS (SELECT doc_id AS memory_id, {NOW} - n_chars * 1800.0::DOUBLE AS start, cs, row_number() OVER (ORDER BY n_chars, doc_id DESC) AS i FROM documents JOIN s ON doc_id = memory_id),
    -- The sequential pass: newest first, against all kept sets.
    p AS (SELECT 0::BIGINT AS i, NULL::BIGINT AS memory_id, []::VARCHAR[][] AS kept, false AS stays
      UNION ALL SELECT i, memory_id, CASE WHEN stays THEN list_append(kept, cs) ELSE kept END, stays FROM (
        SELECT o.i, o.memory_id, o.cs, p.kept,
          len(list_filter(p.kept, lambda k: 2 * len(list_intersect(k, o.cs)) >= len(k) + len(o.cs) - len(list_intersect(k, o.cs)))) = 0 AS stays
        FROM p JOIN o ON o.i = p.i + 1))
    SELECT memory_id, start FROM o WHERE memory_id IN (SELECT memory_id FROM p WHERE stays)
    UNION ALL SELECT doc_id, {NOW} - n_chars * 1800.0::DOUBLE FROM documents WHERE doc_id NOT IN (SELECT memory_id FROM s)""",
)
def latest_by_concepts(spark, sf):
    """Documents whose concepts overlap those of a newer kept document by half or more are out of date."""
    mem = documents(spark, sf)
    rows = mem.select("memory_id", F.col("created_at").alias("start"))
    return temporal.latest_similar(rows, document_bridge(spark, sf, mem), 0.5)


def order_chains(spark, sf):
    """A customer's orders, each superseding the one before."""
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("memory_id"), "o_custkey", epoch("o_orderdate").alias("created_at"))
    return temporal.ordered_chains(orders, "o_custkey")


CHAIN_SQL = """
ch AS (SELECT o_orderkey AS memory_id, o_custkey, epoch(o_orderdate) AS created_at, first_value(o_orderkey) OVER w AS chain_id,
    row_number() OVER w AS version, lag(o_orderkey) OVER w AS supersedes, lead(o_orderkey) OVER w AS superseded_by
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
  QUALIFY count(*) OVER (PARTITION BY o_custkey) > 1)"""


@query(
    "chain_as_of",
    f"""WITH {CHAIN_SQL}, m AS (SELECT row_number() OVER () AS rid, l_orderkey, l_linenumber, c.chain_id, epoch(l_shipdate) - 30 * 86400.0 AS at FROM lineitem JOIN ch c ON c.memory_id = l_orderkey)
    SELECT l_orderkey, l_linenumber, chain_id, "at", version, memory_id FROM (
      SELECT m.*, max(v.version) AS version, arg_max(v.memory_id, v.version) AS memory_id
      FROM m LEFT JOIN ch v ON v.chain_id = m.chain_id AND v.created_at <= m.at GROUP BY ALL)""",
)
def chain_as_of(spark, sf):
    """Which order of a customer was the newest thirty days before each shipment."""
    chains = order_chains(spark, sf)
    items = table(spark, sf, "lineitem").select(
        F.col("l_orderkey"), F.col("l_linenumber"), (epoch("l_shipdate") - 30 * 86400.0).alias("at")
    )
    moments = items.join(chains.select(F.col("memory_id").alias("l_orderkey"), "chain_id"), "l_orderkey")
    return temporal.as_of_chain(chains, moments)


@query(
    "fact_history",
    f"""WITH {BM25_SQL}, r AS (SELECT query_id, memory_id FROM bm WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, memory_id) = 1),
    c AS (SELECT doc_id AS memory_id, source, row_number() OVER w AS version, lead(doc_id) OVER w IS NULL AS current FROM documents
      WINDOW w AS (PARTITION BY source ORDER BY {NOW} - n_chars * 1800.0::DOUBLE, doc_id) QUALIFY count(*) OVER (PARTITION BY source) > 1)
    SELECT query_id, c.memory_id, c.version, c.current FROM r JOIN documents d ON d.doc_id = r.memory_id JOIN c ON c.source = d.source
    UNION ALL SELECT query_id, memory_id, 1, true FROM r WHERE memory_id NOT IN (SELECT memory_id FROM c)""",
)
def fact_history(spark, sf):
    """The best document of each passage, with all versions of its source's chain."""
    mem = documents(spark, sf)
    top = retrieval.bm25_top(mem, passage_queries(spark, sf), 1)
    rows = table(spark, sf, "documents").select(
        F.col("doc_id").alias("memory_id"), "source", (F.lit(NOW) - F.col("n_chars") * 1800.0).alias("created_at")
    )
    return temporal.fact_history(top, temporal.ordered_chains(rows, "source"))


@query(
    "chain_timeline",
    f"""WITH {CHAIN_SQL}, mc AS ({ORDER_CONCEPTS_SQL}) SELECT memory_id, supersedes, superseded_by, 'chain-' || chain_id AS fact_chain_id, created_at AS timestamp
    FROM ch WHERE memory_id IN (SELECT memory_id FROM mc WHERE concept = 'small ring')""",
)
def chain_timeline(spark, sf):
    """Orders with a small ring that supersede another order or were superseded."""
    return temporal.chain_timeline(order_chains(spark, sf), order_concepts(spark, sf), "Small Ring")
