"""Recall under temporal modes: the latest facts, those of a moment, a range or a month."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import facts as fx
from . import query
from .fact_queries import COPULA_TRIPLES_SQL, documents
from .retrieval_queries import RECALL_SQL, blended

#: Key of a fact: subject, predicate and first word of the object.
KEYS_SQL = """
ky AS (SELECT memory_id, list(DISTINCT subject || '|is|' || string_split(object, ' ')[1]) AS ks FROM trip GROUP BY memory_id),
cc AS (SELECT memory_id, list(DISTINCT concept) AS cs FROM mc GROUP BY memory_id)"""


def fact_keys(spark, sf):
    t = fx.extract_triples(documents(spark, sf)).filter(F.col("predicate") == "is")
    key = F.concat_ws("|", "subject", "predicate", F.split("object", " ")[0])
    return t.select("memory_id", key.alias("key")).distinct()


def _top_sql(rows: str) -> str:
    return f"""SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, memory_id) AS rank, memory_id, score,
       round(lexi, 6) AS lexical, round(cn, 6) AS concept, round(temporal, 6) AS temporal FROM {rows} QUALIFY rank <= 10"""


def _latest_sql(condition: str) -> str:
    """The sequential pass, one step per row of a query."""
    return f"""WITH RECURSIVE {RECALL_SQL}, {COPULA_TRIPLES_SQL}, {KEYS_SQL},
    o AS (SELECT z.*, coalesce(ks, []) AS ks, coalesce(cs, []) AS cs, row_number() OVER (PARTITION BY query_id ORDER BY created_at DESC, memory_id DESC) AS step
       FROM z LEFT JOIN ky USING (memory_id) LEFT JOIN cc USING (memory_id) WHERE {condition}),
    g AS (SELECT DISTINCT query_id, 0::BIGINT AS step, NULL::BIGINT AS memory_id, false AS keep, []::VARCHAR[] AS keys, []::VARCHAR[][] AS seen FROM o
      UNION ALL SELECT query_id, step, memory_id, keep, CASE WHEN keep THEN list_concat(keys, ks) ELSE keys END,
        CASE WHEN keep AND len(ks) = 0 AND len(cs) > 0 THEN list_append(seen, cs) ELSE seen END
      FROM (SELECT o.query_id, o.step, o.memory_id, o.ks, o.cs, g.keys, g.seen,
          CASE WHEN len(o.ks) > 0 THEN NOT list_has_any(g.keys, o.ks)
            ELSE len(list_filter(g.seen, lambda s: len(list_intersect(s, o.cs)) / len(list_distinct(list_concat(s, o.cs))) >= 0.5)) = 0 END AS keep
        FROM g JOIN o ON o.query_id = g.query_id AND o.step = g.step + 1)),
    w AS (SELECT z.* FROM z JOIN g USING (query_id, memory_id) WHERE keep)
    {_top_sql('w')}"""


@query("recall_latest", _latest_sql("true"))
def recall_latest(spark, sf):
    """Of rows that state one fact, or are about the same concepts, only the newest may take a place."""
    return blended(spark, sf, temporal="latest", fact_keys=fact_keys(spark, sf))


@query("recall_as_of", _latest_sql("created_at <= epoch(TIMESTAMP '2024-01-20')"))
def recall_as_of(spark, sf):
    """What was known, and newest, on a day."""
    return blended(spark, sf, temporal="as_of:2024-01-20", fact_keys=fact_keys(spark, sf))


@query(
    "recall_during",
    f"WITH {RECALL_SQL}, w AS (SELECT * FROM z WHERE created_at < epoch(TIMESTAMP '2024-01-20')) {_top_sql('w')}",
)
def recall_during(spark, sf):
    """Rows that hold at some time of a range; without an end they hold on."""
    return blended(spark, sf, temporal="during:2024-01-10:2024-01-20")


@query(
    "recall_month",
    f"WITH {RECALL_SQL}, w AS (SELECT * FROM z WHERE created_at >= epoch(TIMESTAMP '2024-01-01') AND created_at < epoch(TIMESTAMP '2024-02-01')) {_top_sql('w')}",
)
def recall_month(spark, sf):
    """Rows written within a month."""
    return blended(spark, sf, temporal="January 2024")
