"""Concept statistics, graph and patterns: orders are memories, their part names the concepts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import concepts, graph, patterns, similarity
from ..session import save, scratch_path
from . import query
from .similarity_queries import jaccard_sql
from .views import NOW, ORDER_CONCEPTS_SQL, access_log, epoch, order_concepts, order_facts, table

ORDERS_NOW = 996624000.0  # 2001-08-01, the end of the order dates

ACTIVE_SQL = f"""
mc AS ({ORDER_CONCEPTS_SQL}),
acc AS (SELECT o_orderkey AS memory_id, epoch(o_orderdate) AS ts FROM orders WHERE o_orderdate >= TIMESTAMP '2001-06-01'),
act AS (SELECT concept, count(*) AS count, max(ts) AS last FROM mc JOIN acc USING (memory_id) GROUP BY concept),
heat AS (SELECT concept, count, least(greatest((1 - exp(-count / 5.0)) * pow(0.5, greatest({ORDERS_NOW} - last, 0) / 2592000.0), 0), 1) AS a FROM act)"""


def order_accesses(spark, sf):
    """Orders of the last two months count as accesses."""
    return (
        table(spark, sf, "orders")
        .filter(F.col("o_orderdate") >= F.lit("2001-06-01").cast("timestamp_ntz"))
        .select(F.col("o_orderkey").alias("memory_id"), epoch("o_orderdate").alias("ts"))
    )


@query("concept_counts", f"WITH mc AS ({ORDER_CONCEPTS_SQL}) SELECT concept, count(*) AS n_memories, min(category) AS category FROM mc GROUP BY concept")
def concept_counts(spark, sf):
    return concepts.concept_counts(order_concepts(spark, sf))


@query("hot_concepts", f"WITH {ACTIVE_SQL} SELECT concept, count, round(a, 6) AS activation FROM heat WHERE round(a, 6) > 0 ORDER BY activation DESC, concept LIMIT 10")
def hot_concepts(spark, sf):
    act = concepts.activations_from(order_accesses(spark, sf), order_concepts(spark, sf))
    return concepts.hot_concepts(act, ORDERS_NOW, 10)


@query(
    "memory_activation",
    f"""WITH {ACTIVE_SQL} SELECT memory_id, round(avg(coalesce(a, 0)), 6) AS heat, round(max(coalesce(a, 0)), 6) AS hottest FROM mc LEFT JOIN heat USING (concept) GROUP BY memory_id""",
)
def memory_activation(spark, sf):
    from ..functions import scoring as sc

    bridge = order_concepts(spark, sf)
    act = concepts.activations_from(order_accesses(spark, sf), bridge)
    hot = act.select("concept", sc.activation(F.col("count"), F.col("last_activated"), ORDERS_NOW).alias("a"))
    heat = F.coalesce("a", F.lit(0.0))
    return bridge.join(hot, "concept", "left").groupBy("memory_id").agg(
        F.round(F.avg(heat), 6).alias("heat"), F.round(F.max(heat), 6).alias("hottest")
    )


@query(
    "concept_idf_topk",
    f"""WITH mc AS ({ORDER_CONCEPTS_SQL}), q AS (SELECT DISTINCT p_brand AS query_id, p_name AS concept FROM part WHERE p_size >= 45),
    t AS (SELECT count(*) AS total FROM orders), d AS (SELECT concept, count(*) AS df FROM mc GROUP BY concept),
    s AS (SELECT query_id, memory_id, round(sum(ln(total / df)), 6) AS score FROM mc JOIN q USING (concept) JOIN d USING (concept), t GROUP BY ALL HAVING sum(ln(total / df)) > 0)
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, memory_id) AS rank FROM s QUALIFY rank <= 10""",
)
def concept_idf_topk(spark, sf):
    """One query per brand: the names of its larger parts."""
    from ..operators.retrieval import concept_idf
    from ..session import top_per_group

    parts = table(spark, sf, "part").filter("p_size >= 45")
    q = parts.select(F.col("p_brand").alias("query_id"), F.col("p_name").alias("concept")).distinct()
    total = table(spark, sf, "orders").agg(F.count("*").alias("n")).scalar()
    scored = concept_idf(order_concepts(spark, sf), q, total, 10).withColumn("score", F.round("score", 6))
    return top_per_group(scored, ["query_id"], [F.desc("score"), F.asc("memory_id")], 10)


PAIRS_SQL = "SELECT x.concept AS a, y.concept AS b, count(*) AS weight FROM mc x JOIN mc y ON x.memory_id = y.memory_id AND x.concept < y.concept GROUP BY ALL"


@query("cooccurrence_pairs", f"WITH mc AS ({ORDER_CONCEPTS_SQL}) {PAIRS_SQL}")
def cooccurrence_pairs(spark, sf):
    return graph.cooccurrence(order_concepts(spark, sf))


@query(
    "cooccurrence_patterns",
    f"WITH mc AS ({ORDER_CONCEPTS_SQL}), p AS ({PAIRS_SQL}) SELECT 'User typically does ' || a || ' on ' || b || '.' AS content, 'co_occurrence' AS pattern_type, weight AS support FROM p WHERE weight >= 60",
)
def cooccurrence_patterns(spark, sf):
    return patterns.cooccurrence_patterns(order_concepts(spark, sf), min_support=60)


@query(
    "concept_spread_3hop",
    f"""WITH mc AS ({ORDER_CONCEPTS_SQL}), p AS ({PAIRS_SQL}),
    n AS (SELECT a AS concept, b AS neighbor, weight / 1000.0 AS w FROM p UNION ALL SELECT b, a, weight / 1000.0 FROM p),
    s0 AS (SELECT DISTINCT p_brand AS query_id, p_name AS concept, 1.0::DOUBLE AS score FROM part WHERE p_size = 50),
    s1 AS (SELECT query_id, neighbor AS concept, max(score * 0.5 * w) AS score FROM s0 JOIN n USING (concept) GROUP BY ALL),
    s2 AS (SELECT query_id, neighbor AS concept, max(score * 0.5 * w) AS score FROM s1 JOIN n USING (concept) GROUP BY ALL),
    s3 AS (SELECT query_id, neighbor AS concept, max(score * 0.5 * w) AS score FROM s2 JOIN n USING (concept) GROUP BY ALL)
    SELECT query_id, concept, round(max(score), 9) AS score FROM (FROM s0 UNION ALL FROM s1 UNION ALL FROM s2 UNION ALL FROM s3) GROUP BY ALL""",
)
def concept_spread_3hop(spark, sf):
    """Spread from each brand's largest parts; weights scaled below one so that heat fades."""
    edges = graph.neighbors(order_concepts(spark, sf)).withColumn("weight", F.col("weight") / 1000)
    seeds = table(spark, sf, "part").filter("p_size = 50").select(
        F.col("p_brand").alias("query_id"), F.col("p_name").alias("concept")
    )
    return graph.multi_hop_spread(seeds, edges).withColumn("score", F.round("score", 9))


@query(
    "neighbourhood_counts",
    f"""WITH mc AS ({ORDER_CONCEPTS_SQL}), p AS ({PAIRS_SQL}), n AS (SELECT a AS c, b AS d FROM p UNION ALL SELECT b, a FROM p),
    h1 AS (SELECT c, count(*) AS hop1 FROM n GROUP BY c),
    h2 AS (SELECT c, count(DISTINCT d) AS hop2 FROM (SELECT x.c, y.d FROM n x JOIN n y ON x.d = y.c WHERE x.c <> y.d UNION SELECT c, d FROM n) GROUP BY c)
    SELECT c AS concept, hop1, hop2 FROM h1 JOIN h2 USING (c) WHERE c IN (SELECT p_name FROM part WHERE p_size = 50)""",
)
def neighbourhood_counts(spark, sf):
    """Neighbourhoods of the largest parts."""
    seeds = table(spark, sf, "part").filter("p_size = 50").select(F.col("p_name").alias("concept"))
    return graph.neighbourhood_counts(order_concepts(spark, sf), seeds)


@query(
    "browse_concept",
    f"""WITH mc AS ({ORDER_CONCEPTS_SQL}) SELECT o_orderkey AS memory_id, o_orderpriority AS value FROM orders
    WHERE o_orderkey IN (SELECT memory_id FROM mc WHERE concept = 'blue bolt' ORDER BY memory_id DESC LIMIT 50 OFFSET 10)""",
)
def browse_concept(spark, sf):
    facts = order_facts(spark, sf).withColumn("consolidated", F.lit(False))
    page = concepts.browse(facts, order_concepts(spark, sf), "blue bolt", 50, 10)
    return page.select("memory_id", "value")


@query(
    "concept_merge",
    """WITH n AS (SELECT l_orderkey AS memory_id, CASE WHEN p_size % 2 = 0 THEN p_name ELSE replace(p_name, ' ', '-') END AS concept, min(p_type) AS category
      FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
    c AS (SELECT concept, count(*) AS n, regexp_replace(lower(concept), '[^a-z0-9]+', '', 'g') AS canon FROM n GROUP BY concept),
    k AS (SELECT canon, arg_max(concept, (n, length(concept), concept)) AS keep FROM c GROUP BY canon HAVING count(*) > 1),
    m AS (SELECT memory_id, coalesce(keep, n.concept) AS concept FROM n JOIN c USING (concept) LEFT JOIN k USING (canon) GROUP BY ALL)
    SELECT concept, count(*) AS n_memories FROM m GROUP BY concept""",
)
def concept_merge(spark, sf):
    """Names spelled with a blank or a dash are merged; orders are the live memories."""
    items = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("memory_id"), "l_partkey")
    parts = table(spark, sf, "part")
    spelled = F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise(F.replace("p_name", F.lit(" "), F.lit("-")))
    bridge = (
        items.join(parts, items.l_partkey == parts.p_partkey)
        .groupBy("memory_id", spelled.alias("concept"))
        .agg(F.min("p_type").alias("category"))
    )
    alive = table(spark, sf, "orders").select(F.col("o_orderkey").alias("memory_id"))
    return concepts.clean_bridge(bridge, alive).groupBy("concept").agg(F.count("*").alias("n_memories"))


@query(
    "top_concepts_per_category",
    f"""WITH mc AS ({ORDER_CONCEPTS_SQL}), c AS (SELECT concept, count(*) AS n_memories, min(category) AS category FROM mc GROUP BY concept)
    SELECT *, row_number() OVER (PARTITION BY category ORDER BY n_memories DESC, concept) AS rank FROM c QUALIFY rank <= 3""",
)
def top_concepts_per_category(spark, sf):
    return concepts.top_concepts_per_category(order_concepts(spark, sf), 3)


@query(
    "promotions",
    f"""WITH mc AS ({ORDER_CONCEPTS_SQL}), a AS (SELECT user_id AS memory_id, count(*) AS n FROM events GROUP BY user_id)
    SELECT concept, sum(n)::BIGINT AS access, count(*) AS n_memories FROM mc JOIN a USING (memory_id) GROUP BY concept HAVING sum(n) >= 3""",
)
def promotions(spark, sf):
    """Access counts come from events; only accessed orders carry weight."""
    counts = access_log(spark, sf).groupBy("memory_id").agg(F.count("*").alias("access_count"))
    return patterns.promotions(counts.withColumn("memory_type", F.lit("fact")), order_concepts(spark, sf))


@query(
    "seasonal_weekday",
    """WITH c AS (SELECT o_custkey::VARCHAR AS concept, dayname(o_orderdate) AS weekday, count(*) AS n FROM orders GROUP BY ALL),
    b AS (SELECT concept, arg_max(weekday, (n, weekday)) AS weekday, max(n) AS n, sum(n) AS total FROM c GROUP BY concept)
    SELECT concept, weekday, n, round(n / total, 6) AS ratio FROM b WHERE n >= 3 AND n / total >= 0.33""",
)
def seasonal_weekday(spark, sf):
    """Customers that order on one weekday."""
    dated = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("memory_id"),
        F.col("o_custkey").cast("string").alias("concept"),
        epoch("o_orderdate").alias("created_at"),
    )
    return patterns.seasonal_patterns(dated, 3, 0.33)


@query(
    "streaks",
    """WITH e AS (SELECT date_trunc('day', o_orderdate) AS d, row_number() OVER (ORDER BY date_trunc('day', o_orderdate)) AS place FROM orders GROUP BY 1),
    s AS (SELECT DISTINCT o_orderpriority || '/' || o_orderstatus AS concept, place FROM orders JOIN e ON date_trunc('day', o_orderdate) = d),
    g AS (SELECT concept, place - row_number() OVER (PARTITION BY concept ORDER BY place) AS grp FROM s),
    r AS (SELECT concept, grp, count(*) AS n FROM g GROUP BY ALL)
    SELECT concept, max(n) AS max_streak FROM r GROUP BY concept HAVING max(n) >= 3""",
)
def streaks(spark, sf):
    """An order day is an episode; priority and status make the concept."""
    orders = table(spark, sf, "orders")
    day = F.floor(epoch("o_orderdate") / 86400).cast("long")
    rows = orders.select(F.concat_ws("/", "o_orderpriority", "o_orderstatus").alias("concept"), day.alias("episode_id"))
    episodes = rows.select("episode_id").distinct().withColumn("started_at", F.col("episode_id") * 86400.0)
    return patterns.streak_patterns(rows, episodes, 3)


EVENT_SESSIONS_SQL = """
e AS (SELECT event_id, user_id, event_type, epoch(ts) AS ts, lag(epoch(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events),
s AS (SELECT *, sum(CASE WHEN prev IS NULL OR ts - prev >= 21600 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM e)"""


def event_sessions(spark, sf):
    rows = access_log(spark, sf).select("event_id", F.col("memory_id").alias("user_id"), "event_type", "ts")
    return patterns.sessions(rows, "user_id", 21600.0)


@query(
    "episodes_sessions",
    f"WITH {EVENT_SESSIONS_SQL} SELECT user_id, session::BIGINT AS session, count(*) AS n, round(min(ts), 3) AS started_at, round(max(ts), 3) AS ended_at FROM s GROUP BY ALL",
)
def episodes_sessions(spark, sf):
    return event_sessions(spark, sf).groupBy("user_id", "session").agg(
        F.count("*").alias("n"), F.round(F.min("ts"), 3).alias("started_at"), F.round(F.max("ts"), 3).alias("ended_at")
    )


@query(
    "siblings",
    f"WITH {EVENT_SESSIONS_SQL}, n AS (SELECT *, count(*) OVER (PARTITION BY user_id, session) - 1 AS siblings FROM s) SELECT event_type, count(*) AS n, sum(siblings)::BIGINT AS siblings, round(avg(pow(1.05, siblings)), 6) AS mean_boost FROM n GROUP BY event_type",
)
def siblings(spark, sf):
    """Episode-mate boost, from episode sizes instead of mate pairs."""
    rows = event_sessions(spark, sf)
    sizes = rows.groupBy("user_id", "session").agg((F.count("*") - 1).alias("siblings"))
    return (
        rows.join(sizes, ["user_id", "session"])
        .groupBy("event_type")
        .agg(
            F.count("*").alias("n"),
            F.sum("siblings").alias("siblings"),
            F.round(F.avg(F.pow(F.lit(1.05), "siblings")), 6).alias("mean_boost"),
        )
    )


@query(
    "stale_episodes",
    f"WITH e AS (SELECT user_id AS episode, min(epoch(ts)) AS started_at, max(epoch(ts)) AS ended_at, count(*) AS n FROM events GROUP BY user_id) SELECT episode, n, round(ended_at, 3) AS ended_at FROM e WHERE ended_at < {NOW} - 172800 - 1800",
)
def stale_episodes(spark, sf):
    rows = access_log(spark, sf).select(F.col("memory_id").alias("episode"), F.col("ts").alias("created_at"))
    stale = patterns.stale_episodes(patterns.named_episodes(rows), NOW - 172800)
    return stale.select("episode", "n", F.round("ended_at", 3).alias("ended_at"))


@query(
    "proximity_band",
    "WITH p AS (SELECT max_by(epoch(ts), value * 1000000 + event_id) AS t FROM events) SELECT event_id, event_type FROM events, p WHERE epoch(ts) BETWEEN t - 3600 AND t + 3600",
)
def proximity_band(spark, sf):
    """Events within an hour of the highest-valued one."""
    from ..operators.temporal import around

    log = access_log(spark, sf).withColumnRenamed("ts", "created_at")
    anchor = log.agg(F.max_by("created_at", F.col("value") * 1000000 + F.col("event_id"))).scalar()
    return around(log, anchor).select("event_id", "event_type")


def document_pairs(spark, sf):
    """Near-duplicate pairs of distinct document token sets, as a weighted graph."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("memory_id"), F.col("text").alias("content"))
    reps, _ = similarity.collapse_copies(similarity.token_sets(docs, hashed=True))
    return similarity.jaccard_pairs(reps, 0.5).select("a", "b", F.round("similarity", 6).alias("weight"))


@query(
    "communities",
    f"""WITH RECURSIVE {jaccard_sql(0.5)}, e AS (SELECT a, b, round(similarity, 6) AS weight FROM pairs),
    u AS (SELECT a AS x, b AS y FROM e UNION SELECT b, a FROM e),
    r AS (SELECT x, y FROM u UNION SELECT r.x, u.y FROM r JOIN u ON r.y = u.x),
    c AS (SELECT x AS node, least(x, min(y)) AS component FROM r GROUP BY x),
    z AS (SELECT component, count(*) AS size FROM c GROUP BY component HAVING count(*) >= 3),
    w AS (SELECT component, sum(weight) AS total FROM e JOIN c ON e.a = c.node GROUP BY component)
    SELECT component, size, round(total, 4) AS total_weight, round(least(1, total / (size * (size - 1) / 2)), 4) AS density FROM z JOIN w USING (component)""",
)
def communities(spark, sf):
    found = graph.communities(save(document_pairs(spark, sf), "links"))
    return found.select(
        "component", "size", F.round("total_weight", 4).alias("total_weight"), F.round("density", 4).alias("density")
    )


@query(
    "communities_incremental",
    f"""WITH RECURSIVE {jaccard_sql(0.5)}, e AS (SELECT a, b FROM pairs WHERE (a + b) % 5 > 0), u AS (SELECT a AS x, b AS y FROM e UNION SELECT b, a FROM e),
    r AS (SELECT x, y FROM u UNION SELECT r.x, u.y FROM r JOIN u ON r.y = u.x)
    SELECT x AS node, least(x, min(y)) AS component FROM r GROUP BY x""",
)
def communities_incremental(spark, sf):
    """Groups of similar documents when every fifth link goes and every seventh one comes: only touched groups are read."""
    links = save(document_pairs(spark, sf).select("a", "b"), "links")
    total = F.col("a") + F.col("b")
    before = links.filter(total % 7 > 0)
    labels = save(graph.connected_components(before), "labels")
    path = scratch_path(spark, "edges")
    graph.labelled_edges(before, labels).write.partitionBy("part").parquet(path)
    return graph.update_components(
        labels, spark.read.parquet(path), links.filter((total % 7 == 0) & (total % 5 > 0)), before.filter(total % 5 == 0)
    )


@query(
    "hub_degree",
    f"""WITH mc AS ({ORDER_CONCEPTS_SQL}), p AS ({PAIRS_SQL}), n AS (SELECT a AS c, weight FROM p UNION ALL SELECT b, weight FROM p)
    SELECT c AS concept, sum(weight)::BIGINT AS degree FROM n GROUP BY c ORDER BY degree DESC, concept LIMIT 3""",
)
def hub_degree(spark, sf):
    pairs = graph.both_ways(graph.cooccurrence(order_concepts(spark, sf)))
    return pairs.groupBy("concept").agg(F.sum("weight").alias("degree")).orderBy(F.desc("degree"), "concept").limit(3)


@query(
    "modularity",
    f"""WITH mc AS ({ORDER_CONCEPTS_SQL}), p AS ({PAIRS_SQL}), k AS (SELECT concept AS node, min(category) AS c FROM mc GROUP BY concept),
    t AS (SELECT sum(weight) AS m FROM p), i AS (SELECT x.c, sum(weight) AS w FROM p JOIN k x ON a = x.node JOIN k y ON b = y.node WHERE x.c = y.c GROUP BY x.c),
    d AS (SELECT c, sum(weight) AS deg FROM (SELECT a AS n, weight FROM p UNION ALL SELECT b, weight FROM p) JOIN k ON n = node GROUP BY c)
    SELECT round(sum(coalesce(w, 0) / m - pow(deg / (2 * m), 2)), 6) AS modularity FROM d LEFT JOIN i USING (c), t""",
)
def modularity(spark, sf):
    """How far the concept graph falls apart by part type."""
    bridge = order_concepts(spark, sf)
    parts = bridge.groupBy(F.col("concept").alias("node")).agg(F.min("category").alias("component"))
    return graph.modularity(graph.cooccurrence(bridge), parts)
