"""Strength, retention, pruning, erasure and write policies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import redaction as rd
from ..functions import scoring as sc
from ..operators import lifecycle, metrics
from ..plans import forgetting
from . import query
from .concept_queries import ACTIVE_SQL, ORDERS_NOW, order_accesses
from .views import ACCESS_STATS_SQL, MEMORIES_SQL, NOW, access_log, access_stats, epoch, memories, order_concepts, table

EFF = f"strength * pow(0.5, ({NOW} - last_accessed) / 604800.0) * (1 + 0.1 * ln(1 + access_count))"


@query(
    "decay_strength",
    f"""WITH a AS ({ACCESS_STATS_SQL}) SELECT memory_id, access_count, round(last_ts, 3) AS last_accessed,
      round(least(1 + 0.05 * access_count, 2.0) * pow(0.5, ({NOW} - last_ts) / 604800.0) * (1 + 0.1 * ln(1 + access_count)), 6)::DOUBLE AS effective_strength FROM a""",
)
def decay_strength(spark, sf):
    """Strength of each accessed memory now: reinforced per access, decayed since the last."""
    strength = sc.reinforced(F.lit(1.0), F.col("access_count"))
    eff = sc.effective_strength(strength, F.col("access_count"), F.col("last_ts"), NOW)
    return access_stats(spark, sf).select(
        "memory_id", "access_count", F.round("last_ts", 3).alias("last_accessed"), F.round(eff, 6).alias("effective_strength")
    )


@query(
    "reinforce_fold",
    f"""WITH m AS ({MEMORIES_SQL}), d AS (SELECT user_id AS memory_id, count(*) AS hits, max(epoch(ts)) AS last_ts FROM events WHERE event_type = 'view' GROUP BY 1)
    SELECT memory_id, round(CASE WHEN hits > 0 THEN least(strength + 0.05 * hits, 2.0) ELSE strength END, 6)::DOUBLE AS strength, access_count + coalesce(hits, 0) AS access_count,
      round(greatest(last_accessed, coalesce(last_ts, last_accessed)), 3) AS last_accessed FROM m LEFT JOIN d USING (memory_id)""",
)
def reinforce_fold(spark, sf):
    views = access_log(spark, sf).filter("event_type = 'view'").select("memory_id", "ts")
    out = lifecycle.reinforce(memories(spark, sf), views)
    return out.select(
        "memory_id", F.round("strength", 6).alias("strength"), "access_count", F.round("last_accessed", 3).alias("last_accessed")
    )


def tagged(spark, sf):
    """Memories with JSON metadata: tags from source and language, own ttl for German rows."""
    m = memories(spark, sf)
    tags = F.array(F.col("source"), F.concat(F.lit("user:"), F.col("lang")))
    own = F.when(F.col("lang") == "de", 60)
    meta = F.to_json(F.struct(tags.alias("tags"), own.alias("ttl_days")))
    return m.withColumn("metadata", meta)


@query(
    "ttl_expired",
    f"WITH m AS ({MEMORIES_SQL}) SELECT memory_id, lang, created_at FROM m WHERE {NOW} - created_at > CASE WHEN lang = 'de' THEN 60 ELSE 30 END * 86400.0",
)
def ttl_expired(spark, sf):
    return lifecycle.ttl_expired(tagged(spark, sf), NOW, 30).select("memory_id", "lang", "created_at")


RULES = [
    {"tag": "src3", "ttl_days": 7},
    {"min_access": 0, "older_than_days": 90, "action": "archive"},
    {"memory_type": "observation", "concept": "que", "older_than_days": 20},
]


@query(
    "retention_rules",
    f"""WITH m AS ({MEMORIES_SQL}) SELECT memory_type, CASE WHEN source = 'src3' AND {NOW} - created_at > 7 * 86400.0 THEN 'delete'
      WHEN access_count <= 0 AND {NOW} - created_at > 90 * 86400.0 THEN 'archive'
      WHEN memory_type = 'observation' AND contains(lower(content), 'que') AND {NOW} - created_at > 20 * 86400.0 THEN 'delete' ELSE 'keep' END AS action, count(*) AS n FROM m GROUP BY ALL""",
)
def retention_rules(spark, sf):
    return lifecycle.apply_retention(tagged(spark, sf), RULES, NOW).groupBy("memory_type", "action").agg(
        F.count("*").alias("n")
    )


@query(
    "prune_candidates",
    f"""WITH {ACTIVE_SQL}, warm AS (SELECT DISTINCT memory_id FROM mc JOIN heat USING (concept) WHERE a >= 0.5),
    m AS (SELECT o_orderkey AS memory_id, epoch(o_orderdate) AS created_at FROM orders)
    SELECT memory_id, created_at FROM m WHERE {ORDERS_NOW} - created_at >= 90 * 86400.0 AND pow(0.5, ({ORDERS_NOW} - created_at) / 604800.0) < 0.1 AND memory_id NOT IN (SELECT memory_id FROM warm)""",
)
def prune_candidates(spark, sf):
    """Orders older than 90 days none of whose parts is still in demand."""
    from ..operators import concepts

    bridge = order_concepts(spark, sf)
    act = concepts.activations_from(order_accesses(spark, sf), bridge)
    rows = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("memory_id"),
        F.lit(1.0).alias("strength"),
        F.lit(0).cast("long").alias("access_count"),
        epoch("o_orderdate").alias("created_at"),
        epoch("o_orderdate").alias("last_accessed"),
        F.lit(False).alias("consolidated"),
    )
    return lifecycle.prune_candidates(rows, bridge, act, ORDERS_NOW, cold=0.5).select("memory_id", "created_at")


@query(
    "forget_topic",
    f"WITH m AS ({MEMORIES_SQL}) SELECT lang, count(*) AS n_left FROM m WHERE NOT contains(lower(content), 'tion the') GROUP BY lang",
)
def forget_topic(spark, sf):
    m = memories(spark, sf)
    left, _ = lifecycle.forget(m, lifecycle.topic_ids(m, "tion the"))
    return left.groupBy("lang").agg(F.count("*").alias("n_left"))


@query(
    "gdpr_delete",
    f"WITH m AS ({MEMORIES_SQL}) SELECT memory_id FROM m WHERE lang = 'es' OR contains(lower(content), 'keit')",
)
def gdpr_delete(spark, sf):
    return lifecycle.erasure_ids(tagged(spark, sf), user_id="es", concept="keit")


@query(
    "redact_fields",
    f"WITH m AS ({MEMORIES_SQL}) SELECT memory_id, CASE WHEN contains(lower(content), 'heit') THEN '[REDACTED]' ELSE content END AS content, lang FROM m",
)
def redact_fields(spark, sf):
    m = memories(spark, sf)
    return lifecycle.redact_fields(m, lifecycle.topic_ids(m, "heit")).select("memory_id", "content", "lang")


@query(
    "policy_minimal",
    f"""WITH m AS ({MEMORIES_SQL}), t AS (SELECT memory_id, sensitive, scope, list_sort(list_distinct([source, 'user:' || lang]
       || CASE WHEN memory_type = 'preference' THEN ['preference'] ELSE [] END
       || CASE WHEN {' OR '.join(f"contains(lower(content), '{p.replace(chr(39), chr(39) * 2)}')" for p in rd.COMMITMENTS)} THEN ['commitment'] ELSE [] END)) AS tags FROM m)
    SELECT memory_id, tags, scope FROM t""",
)
def policy_minimal(spark, sf):
    """Tags of the minimal preset (texts are not redacted here: see pii_redact)."""
    policy = {**lifecycle.PRESETS["minimal"], "redact_pii": False}
    return lifecycle.apply_write_policy(tagged(spark, sf), policy).select("memory_id", "tags", "scope")


@query(
    "policy_scopes",
    f"""WITH m AS ({MEMORIES_SQL}) SELECT memory_id, CASE WHEN source = 'src5' THEN 'private' WHEN source = 'src7' THEN 'shared' WHEN memory_type = 'event' THEN 'public' ELSE scope END AS scope,
       sensitive OR source = 'src9' AS sensitive FROM m""",
)
def policy_scopes(spark, sf):
    out = lifecycle.apply_write_policy(
        tagged(spark, sf), {"sensitive_tags": ["src9"]}, {"event": "public"}, {"src5": "private", "src7": "shared"}
    )
    return out.select("memory_id", "scope", "sensitive")


@query(
    "policy_expired",
    f"""WITH m AS ({MEMORIES_SQL}) SELECT 'ttl' AS cause, count(*) AS n FROM m WHERE {NOW} - created_at > 7 * 86400.0 AND source <> 'pinned' GROUP BY 1
    UNION ALL SELECT 'prune', count(*) FROM m WHERE {NOW} - created_at <= 7 * 86400.0 AND {NOW} - created_at >= 7 * 86400.0 AND access_count <= 0 AND {EFF} < 0.1 HAVING count(*) > 0""",
)
def policy_expired(spark, sf):
    m = tagged(spark, sf).withColumn("metadata", F.regexp_replace("metadata", r',"ttl_days":60', ""))
    bridge = m.select("memory_id", F.col("lang").alias("concept"))
    act = bridge.groupBy("concept").agg(F.count("*").alias("count"), F.lit(NOW).alias("last_activated"))
    return lifecycle.policy_expired(m, "ephemeral", bridge, act, NOW).groupBy("cause").agg(F.count("*").alias("n"))


@query(
    "natural_forget",
    f"""WITH m AS ({MEMORIES_SQL}) SELECT 'forget everything older than 2 weeks' AS command, count(*) AS n FROM m WHERE created_at < {NOW} - 14 * 86400.0
    UNION ALL SELECT 'delete all facts about tion the', count(*) FROM m WHERE memory_type = 'fact' AND contains(lower(content), 'tion the')
    UNION ALL SELECT 'forget everything about keit', count(*) FROM m WHERE contains(lower(content), 'keit')
    UNION ALL SELECT 'remove anything from before 2024-01-20', count(*) FROM m WHERE created_at < epoch(TIMESTAMP '2024-01-20')
    UNION ALL SELECT 'actually it is different now', 0
    UNION ALL SELECT 'don''t remember heit und', count(*) FROM m WHERE contains(lower(content), 'heit und')""",
)
def natural_forget(spark, sf):
    """How many rows each command would remove."""
    m = memories(spark, sf)
    commands = [
        "forget everything older than 2 weeks",
        "delete all facts about tion the",
        "forget everything about keit",
        "remove anything from before 2024-01-20",
        "actually it is different now",
        "don't remember heit und",
    ]
    parts = [
        m.filter(forgetting.command_filter(c, NOW)).agg(F.lit(c).alias("command"), F.count("*").alias("n")) for c in commands
    ]
    return reduce(DataFrame.unionByName, parts)


@query(
    "store_stats",
    f"""WITH m AS ({MEMORIES_SQL}) SELECT count(*) AS n_rows, count(*) AS n_active, sum(sensitive::INT)::BIGINT AS n_sensitive, count(DISTINCT memory_type) AS n_types,
       round(avg(strength), 6)::DOUBLE AS avg_strength, min(created_at) AS first_created, max(created_at) AS last_created, sum(octet_length(encode(content)))::BIGINT AS n_bytes FROM m""",
)
def store_stats(spark, sf):
    return metrics.store_stats(memories(spark, sf))


@query(
    "drift_indicators",
    f"""WITH m AS ({MEMORIES_SQL}) SELECT count(*) AS active, round(avg(({NOW} - created_at > 90 * 86400.0)::INT), 6) AS older_90d, round(avg((access_count = 0)::INT), 6) AS never_read,
       round(avg((memory_level <> 'instance')::INT), 6) AS abstracted, round(avg(sensitive::INT), 6) AS sensitive FROM m""",
)
def drift_indicators(spark, sf):
    return metrics.drift(memories(spark, sf), NOW)
