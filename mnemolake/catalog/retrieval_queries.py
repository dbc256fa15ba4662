"""Ranked retrieval over documents, with benchmark passages as the query batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import access, concepts, graph, index, retrieval
from ..session import cut_lineage, scratch_path, top_per_group
from . import query
from .text_queries import sql_list
from .views import MEMORIES_SQL, NOW, memories, passage_queries, table

IDX_SQL = """
tok AS (SELECT doc_id AS memory_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS words FROM documents),
idx AS (SELECT memory_id, words, len(words) AS dl FROM tok WHERE len(words) > 0),
corp AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM idx),
post AS (SELECT memory_id, dl, w AS term, count(*) AS tf FROM (SELECT memory_id, dl, unnest(words) AS w FROM idx) GROUP BY ALL)"""
QTERMS_SQL = f"""
qtok AS (SELECT item_id AS query_id, list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'),
   lambda w: NOT list_contains({sql_list(tx.QUERY_STOPWORDS)}, w)) AS ws FROM benchmark),
qt AS (SELECT query_id, w AS term, count(*) AS qtf FROM (SELECT query_id, unnest(ws) AS w FROM qtok) GROUP BY ALL)"""
BM25_SQL = f"""{IDX_SQL}, {QTERMS_SQL},
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
bm AS (SELECT query_id, memory_id, sum(qtf * ln(greatest(1.1, (n - df + 0.5) / (df + 0.5))) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM post JOIN qt USING (term) JOIN dfs USING (term), corp GROUP BY query_id, memory_id)"""


@query(
    "bm25_topk",
    f"""WITH {BM25_SQL}, r AS (SELECT query_id, memory_id, round(score, 6) AS score FROM bm WHERE score > 0)
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, memory_id) AS rank FROM r
    QUALIFY rank <= 10""",
)
def bm25_topk(spark, sf):
    mem = table(spark, sf, "documents").select(F.col("doc_id").alias("memory_id"), F.col("text").alias("content"))
    return retrieval.bm25_top(mem, passage_queries(spark, sf), 10)


@query(
    "bm25_from_index",
    f"""WITH {BM25_SQL}, r AS (SELECT query_id, memory_id, round(score, 6) AS score FROM bm WHERE score > 0)
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, memory_id) AS rank FROM r
    QUALIFY rank <= 10""",
)
def bm25_from_index(spark, sf):
    """The same ranking from a stored index: even documents first, odd ones appended, all of them indexed once."""
    mem = table(spark, sf, "documents").select(F.col("doc_id").alias("memory_id"), F.col("text").alias("content"))
    path = scratch_path(spark, "index")
    index.write_index(mem.filter("memory_id % 2 = 0"), path)
    index.write_index(mem.filter("memory_id % 2 = 1"), path, mode="append")
    scored = retrieval.bm25_from_index(spark, path, passage_queries(spark, sf)).withColumn("score", F.round("score", 6))
    return top_per_group(scored, ["query_id"], [F.desc("score"), F.asc("memory_id")], 10)


@query(
    "bm25_all_scores",
    f"""WITH {BM25_SQL} SELECT query_id, count(*) AS n_hits, round(sum(score), 4) AS total, round(max(score), 6) AS best
    FROM bm WHERE score > 0 GROUP BY query_id""",
)
def bm25_all_scores(spark, sf):
    mem = table(spark, sf, "documents").select(F.col("doc_id").alias("memory_id"), F.col("text").alias("content"))
    return (
        retrieval.bm25(mem, passage_queries(spark, sf))
        .groupBy("query_id")
        .agg(
            F.count("*").alias("n_hits"),
            F.round(F.sum("score"), 4).alias("total"),
            F.round(F.max("score"), 6).alias("best"),
        )
    )


# Passage concepts: long words of a benchmark item are the aliases of that item's concept.
LEXICON_SQL = """
lex AS (SELECT DISTINCT w AS alias, 'item ' || item_id AS concept FROM (
   SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM benchmark) WHERE length(w) >= 8)"""
BRIDGE_SQL = f"{LEXICON_SQL}, mc AS (SELECT DISTINCT memory_id, concept FROM post JOIN lex ON post.term = lex.alias)"


def passage_lexicon(spark, sf):
    words = table(spark, sf, "benchmark").select("item_id", F.explode(tx.tokens(F.col("text"))).alias("alias"))
    return words.filter(F.length("alias") >= 8).select(
        "alias",
        F.concat(F.lit("item "), F.col("item_id").cast("string")).alias("concept"),
        F.lit("passage").alias("category"),
    )


def document_bridge(spark, sf, mem):
    """Single-word aliases only, so the distinct terms themselves are joined with the lexicon.

    The bridge is a stored table of the engine; it is written once and read by every step.
    """
    lex = passage_lexicon(spark, sf).select(F.col("alias").alias("term"), "concept").distinct()
    return cut_lineage(index.term_sets(mem).join(lex, "term").select("memory_id", "concept").distinct())


def item_concepts(spark, sf):
    lex = passage_lexicon(spark, sf).select("alias", "concept").distinct()
    words = table(spark, sf, "benchmark").select(
        F.col("item_id").alias("query_id"), F.explode(tx.tokens(F.col("text"))).alias("alias")
    )
    return words.join(lex, "alias").select("query_id", "concept").distinct()


ITEM_CONCEPTS_SQL = """
qc AS (SELECT DISTINCT query_id, concept FROM (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM benchmark)
  JOIN lex ON w = alias)"""


@query(
    "concept_bridge",
    f"""WITH {IDX_SQL}, {BRIDGE_SQL} SELECT concept, count(*) AS n_memories, min(memory_id) AS first_id FROM mc GROUP BY concept""",
)
def concept_bridge(spark, sf):
    mem = table(spark, sf, "documents").select(F.col("doc_id").alias("memory_id"), F.col("text").alias("content"))
    found = concepts.extract_concepts(mem, passage_lexicon(spark, sf), max_words=1)
    return (
        found.filter(F.col("category") == "passage")
        .groupBy("concept")
        .agg(F.count("*").alias("n_memories"), F.min("memory_id").alias("first_id"))
    )


@query("concept_extract_starter")
def concept_extract_starter(spark, sf):
    """Starter lexicon with 1-4 word aliases, paths and version numbers over whole texts."""
    mem = table(spark, sf, "documents").select(F.col("doc_id").alias("memory_id"), F.col("text").alias("content"))
    return concepts.extract_concepts(mem, concepts.starter_lexicon(spark), punctuated=[".py", ".json", "c++", "c#"])


VISIBLE_SQL = "(NOT sensitive AND (scope = 'public' OR (scope = 'shared' AND (shared_with IS NULL OR list_has_any(shared_with, ['fr','en'])))))"
EFF_SQL = f"strength * pow(0.5, ({NOW} - last_accessed) / 604800.0) * (1 + 0.1 * ln(1 + access_count))"


#: The blend up to ``z``, the 20 best rows of each query with their final scores.
RECALL_SQL = f"""
    {BM25_SQL}, {BRIDGE_SQL}, {ITEM_CONCEPTS_SQL},
    m AS ({MEMORIES_SQL}),
    rows_ AS (SELECT * FROM m WHERE {VISIBLE_SQL}),
    tot AS (SELECT count(*) AS t FROM rows_),
    bmk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, memory_id) AS rn FROM bm WHERE score > 0 AND memory_id IN (SELECT memory_id FROM rows_)) WHERE rn <= 100),
    lexical AS (SELECT query_id, b.memory_id, score / max(score) OVER (PARTITION BY query_id) AS bm FROM bmk b JOIN rows_ USING (memory_id)),
    cdf AS (SELECT concept, count(*) AS df FROM mc GROUP BY concept),
    con AS (SELECT query_id, memory_id, sum(ln(t / df)) AS score FROM mc JOIN qc USING (concept) JOIN cdf USING (concept), tot GROUP BY ALL HAVING score > 0),
    conk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, memory_id) AS rn FROM con WHERE memory_id IN (SELECT memory_id FROM rows_)) WHERE rn <= 100),
    j AS (SELECT l.query_id, l.memory_id, bm, coalesce(c.score / max(c.score) OVER (PARTITION BY l.query_id), 0) AS cn
       FROM lexical l LEFT JOIN conk c USING (query_id, memory_id)),
    k AS (SELECT j.*, r.*, len(q.ws) AS nt FROM j JOIN rows_ r USING (memory_id) JOIN qtok q USING (query_id)),
    x AS (SELECT *, bm + cn * (CASE WHEN nt <= 1 THEN 0.5 WHEN nt <= 2 THEN 0.3 WHEN nt <= 4 THEN 0.2 ELSE 0.0 END) * 0.05 AS lexi,
       pow(0.5, greatest({NOW} - last_accessed, 0) / 604800.0) AS temporal FROM k WHERE {EFF_SQL} >= 0.0),
    p AS (SELECT *, round(0.30 * lexi + 0.25 * cn + 0.20 * temporal, 9) AS s FROM x WHERE lexi > 0),
    t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, memory_id) AS place FROM p QUALIFY place <= 20),
    e AS (SELECT *, source AS episode FROM t),
    a AS (SELECT *, first_value(episode) OVER (PARTITION BY query_id ORDER BY place) AS anchor,
        first_value(created_at) OVER (PARTITION BY query_id ORDER BY place) AS anchor_at,
        sum(CASE WHEN place <= 10 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id, episode) - CASE WHEN place <= 10 THEN 1 ELSE 0 END AS mates FROM e),
    z AS (SELECT query_id, memory_id, created_at, lexi, cn, temporal,
       round((s + CASE WHEN episode = anchor THEN 0.10 ELSE 0 END) * pow(1.05, mates) * CASE WHEN abs(created_at - anchor_at) <= 3600 THEN 1.05 ELSE 1 END
         * CASE memory_level WHEN 'pattern' THEN 1.3 ELSE 1.0 END, 6) AS score FROM a)"""


@query(
    "recall_classic",
    f"""WITH {RECALL_SQL}
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, memory_id) AS rank, memory_id, score,
       round(lexi, 6) AS lexical, round(cn, 6) AS concept, round(temporal, 6) AS temporal FROM z QUALIFY rank <= 10""",
)
def recall_classic(spark, sf):
    """Full blend under scope 'shared' for the groups fr and en."""
    return blended(spark, sf)


def blended(spark, sf, **options):
    mem = memories(spark, sf)
    source_number = F.regexp_extract("source", r"(\d+)", 1).cast("long")
    episodes = table(spark, sf, "documents").select(F.col("doc_id").alias("memory_id"), source_number.alias("episode_id"))
    ranked = retrieval.recall(
        mem,
        passage_queries(spark, sf),
        document_bridge(spark, sf, mem),
        item_concepts(spark, sf),
        now=NOW,
        limit=10,
        visible=access.visible("shared", ["fr", "en"]),
        min_strength=0.0,
        episodes=episodes,
        **options,
    )
    return ranked.select(
        "query_id",
        "rank",
        "memory_id",
        "score",
        F.round("lexical", 6).alias("lexical"),
        F.round("cn", 6).alias("concept"),
        F.round("temporal", 6).alias("temporal"),
    )


@query(
    "recall_graph",
    f"""WITH {IDX_SQL}, {BRIDGE_SQL}, {ITEM_CONCEPTS_SQL},
    gt AS (SELECT DISTINCT query_id, w AS term FROM (SELECT item_id AS query_id, unnest(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'),
        lambda w: NOT list_contains({sql_list(tx.GRAPH_STOPWORDS)}, w))) AS w FROM benchmark)),
    ov AS (SELECT query_id, memory_id, count(*) AS overlap FROM post JOIN gt USING (term) GROUP BY ALL),
    seeds AS (SELECT query_id, memory_id FROM ov QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, memory_id) <= 20),
    nb AS (SELECT x.concept, y.concept AS neighbor, count(*)::DOUBLE AS weight FROM mc x JOIN mc y USING (memory_id) WHERE x.concept <> y.concept GROUP BY ALL),
    l0 AS (SELECT DISTINCT 1 AS path, query_id, concept, 1.0::DOUBLE AS score FROM seeds JOIN mc USING (memory_id)
       UNION ALL SELECT 2, query_id, concept, 1.0 FROM qc),
    l1 AS (SELECT path, query_id, neighbor AS concept, max(score * 0.5 * weight) AS score FROM l0 JOIN nb USING (concept) GROUP BY ALL),
    l2 AS (SELECT path, query_id, neighbor AS concept, max(score * 0.5 * weight) AS score FROM l1 JOIN nb USING (concept) GROUP BY ALL),
    l3 AS (SELECT path, query_id, neighbor AS concept, max(score * 0.5 * weight) AS score FROM l2 JOIN nb USING (concept) GROUP BY ALL),
    heat AS (SELECT path, query_id, concept, max(score) AS score FROM (FROM l0 UNION ALL FROM l1 UNION ALL FROM l2 UNION ALL FROM l3) GROUP BY ALL),
    mem AS (SELECT path, query_id, memory_id, sum(score) AS s FROM heat JOIN mc USING (concept) GROUP BY ALL),
    p1 AS (SELECT coalesce(o.query_id, h.query_id) AS query_id, coalesce(o.memory_id, h.memory_id) AS memory_id,
       coalesce(overlap, 0) + coalesce(s, 0) * CASE WHEN overlap > 0 THEN 2 ELSE 1 END AS p1
       FROM ov o FULL JOIN (SELECT * FROM mem WHERE path = 1) h ON o.query_id = h.query_id AND o.memory_id = h.memory_id),
    p2 AS (SELECT query_id, memory_id, s AS p2 FROM mem WHERE path = 2),
    m1 AS (SELECT query_id, max(p1) AS m1 FROM p1 GROUP BY ALL), m2 AS (SELECT query_id, max(p2) AS m2 FROM p2 GROUP BY ALL),
    b AS (SELECT coalesce(p1.query_id, p2.query_id) AS query_id, coalesce(p1.memory_id, p2.memory_id) AS memory_id, p1, p2
       FROM p1 FULL JOIN p2 ON p1.query_id = p2.query_id AND p1.memory_id = p2.memory_id),
    s AS (SELECT query_id, memory_id, round(0.6 * coalesce(p1 / m1, 0) + 0.4 * coalesce(p2 / m2, 0), 6) AS score
       FROM b LEFT JOIN m1 USING (query_id) LEFT JOIN m2 USING (query_id))
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, memory_id) AS rank FROM s QUALIFY rank <= 10""",
)
def recall_graph(spark, sf):
    mem = table(spark, sf, "documents").select(F.col("doc_id").alias("memory_id"), F.col("text").alias("content"))
    bridge = document_bridge(spark, sf, mem)
    edges = cut_lineage(graph.neighbors(bridge))
    return retrieval.dual_path(
        mem,
        passage_queries(spark, sf),
        bridge,
        item_concepts(spark, sf),
        lambda seeds: graph.multi_hop_spread(seeds, edges),
        10,
    )


@query(
    "rank_by_strength",
    f"""WITH m AS ({MEMORIES_SQL}) SELECT memory_id, round({EFF_SQL}, 6) AS effective_strength FROM m
    ORDER BY effective_strength DESC, memory_id LIMIT 25""",
)
def rank_by_strength(spark, sf):
    return retrieval.rank_by_strength(memories(spark, sf), NOW, 25)


@query(
    "cosine_topk",
    """WITH p AS (SELECT label AS query_id, list_transform(range(1, 65), lambda i: 0) AS z FROM embeddings GROUP BY label),
    e AS (SELECT label, pos, avg(v) AS v FROM (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY ALL),
    c AS (SELECT label AS query_id, list(v ORDER BY pos) AS q FROM e GROUP BY label),
    s AS (SELECT query_id, vec_id AS memory_id, round(list_cosine_similarity(embedding::DOUBLE[], q), 6) AS cosine FROM embeddings, c)
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, memory_id) AS rank FROM s WHERE cosine > 0 QUALIFY rank <= 10""",
)
def cosine_topk(spark, sf):
    """Nearest vectors of each label's mean vector."""
    emb = table(spark, sf, "embeddings")
    parts = emb.select("label", F.posexplode("embedding").alias("pos", "v"))
    means = parts.groupBy("label", "pos").agg(F.avg(F.col("v").cast("double")).alias("v"))
    # One array of the vector's fixed length per label.
    probes = means.groupBy(F.col("label").alias("query_id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda s: s["v"]).alias("vector")
    )
    return retrieval.vector_top(emb.select(F.col("vec_id").alias("memory_id"), "embedding"), probes, 10)


@query(
    "mrr_recall_at_k",
    f"""WITH {BM25_SQL}, r AS (SELECT query_id, memory_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, memory_id) AS rank
       FROM bm WHERE score > 0 QUALIFY rank <= 10),
    h AS (SELECT item_id AS query_id, min(CASE WHEN l.quality = 1 THEN rank END) AS first_rank
       FROM benchmark b LEFT JOIN r ON r.query_id = b.item_id LEFT JOIN labels l ON l.doc_id = r.memory_id GROUP BY item_id)
    SELECT count(*) AS n_queries, round(avg(CASE WHEN first_rank <= 1 THEN 1.0 ELSE 0 END), 6) AS recall_at_1,
       round(avg(CASE WHEN first_rank <= 5 THEN 1.0 ELSE 0 END), 6) AS recall_at_5,
       round(avg(CASE WHEN first_rank <= 10 THEN 1.0 ELSE 0 END), 6) AS recall_at_10,
       round(avg(coalesce(1.0 / first_rank, 0)), 6) AS mrr FROM h""",
)
def mrr_recall_at_k(spark, sf):
    """Retrieval quality of the passage queries; documents labelled quality 1 are relevant."""
    from ..operators import metrics

    ranked = bm25_topk(spark, sf)
    relevant = table(spark, sf, "labels").filter("quality = 1").select(F.col("doc_id").alias("memory_id"))
    return metrics.ranking_quality(passage_queries(spark, sf).select("query_id"), ranked, relevant)


@query(
    "list_page",
    f"""WITH m AS ({MEMORIES_SQL}) SELECT memory_id, memory_type, access_count, created_at FROM m
    ORDER BY access_count DESC, memory_id LIMIT 50 OFFSET 20""",
)
def list_page(spark, sf):
    return access.list_memories(memories(spark, sf), sort="access_count", limit=50, offset=20).select(
        "memory_id", "memory_type", "access_count", "created_at"
    )


@query(
    "scope_visible",
    f"""WITH m AS ({MEMORIES_SQL}) SELECT scope, sensitive,
       CASE WHEN sensitive THEN 'sensitive_memory_private_only' WHEN scope = 'private' THEN 'scope_too_restrictive'
            WHEN scope = 'shared' AND shared_with IS NOT NULL AND NOT list_has_any(shared_with, ['fr','en']) THEN 'shared_group_missing' ELSE 'visible' END AS decision,
       count(*) AS n FROM m GROUP BY ALL""",
)
def scope_visible(spark, sf):
    m = memories(spark, sf)
    reason = access.block_reason("shared", ["fr", "en"])
    return m.groupBy("scope", "sensitive", F.coalesce(reason, F.lit("visible")).alias("decision")).agg(
        F.count("*").alias("n")
    )
