"""Decay, reinforcement, retention, pruning, redaction and erasure.

Every operator is a pure DataFrame step: it returns the rows to act on or the
new table. Deleting means writing the remaining rows to a new version, so
erased text does not linger in an old log.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import redaction as rd
from ..functions import scoring as sc
from ..functions import text as tx
from ..schema import DAY, SCOPES

# The retention presets.
PRESETS = {
    "minimal": {"ttl_days": 30, "prune_min_access": 2, "redact_pii": True, "keep_tags": ["preference", "commitment", "important"]},
    "private": {"ttl_days": 90, "prune_min_access": 0, "redact_pii": True,
                "pii_patterns": ["email", "phone", "ssn", "address", "credit_card"]},
    "work": {"ttl_days": 365, "prune_min_access": 0, "redact_pii": False, "auto_tag_project": True},
    "ephemeral": {"ttl_days": 7, "prune_min_access": 0, "redact_pii": False, "pin_tag": "pinned"},
}
# Tags that mark a row as sensitive.
SENSITIVE_TAGS = ["health", "financial", "legal", "children", "immigration"]


def tags_of(metadata: Column) -> Column:
    """Tags of a JSON metadata string: a list, or one comma-separated string."""
    raw = F.get_json_object(metadata, "$.tags")
    listed = F.from_json(raw, "array<string>")
    single = F.filter(F.transform(F.split(raw, ","), F.trim), lambda t: t != "")
    return F.coalesce(listed, single, F.array().cast("array<string>"))


def access_delta(accesses: DataFrame) -> DataFrame:
    """(memory_id, hits, last_ts) of a batch of access events."""
    return accesses.groupBy("memory_id").agg(F.count("*").alias("hits"), F.max("ts").alias("last_ts"))


def reinforce(memories: DataFrame, accesses: DataFrame) -> DataFrame:
    """Fold access events into count, capped strength and last access."""
    delta = access_delta(accesses)
    joined = memories.join(delta, "memory_id", "left")
    hits = F.coalesce("hits", F.lit(0))
    return (
        joined.withColumn("strength", F.when(hits > 0, sc.reinforced(F.col("strength"), hits)).otherwise(F.col("strength")))
        .withColumn("access_count", F.col("access_count") + hits)
        .withColumn("last_accessed", F.greatest("last_accessed", F.coalesce("last_ts", F.col("last_accessed"))))
        .drop("hits", "last_ts")
    )


def ttl_expired(memories: DataFrame, now: float, default_days: float = 365, pin_tag: str | None = None) -> DataFrame:
    """Rows older than their ``ttl_days`` metadata or the default; pinned rows stay."""
    own = F.get_json_object("metadata", "$.ttl_days").try_cast("double")
    days = F.when(own > 0, own).otherwise(F.lit(float(default_days)))
    out = memories.filter(sc.older_than(F.col("created_at"), days, now))
    if pin_tag:
        out = out.filter(~F.array_contains(tags_of(F.col("metadata")), pin_tag))
    return out


def rule_matches(rule: dict, now: float) -> Column:
    """Predicate of one retention rule: tag, min_access, concept text, type, age."""
    parts = [F.lit(True)]
    if rule.get("tag") is not None:
        parts.append(F.array_contains(tags_of(F.col("metadata")), str(rule["tag"])))
    if rule.get("min_access") is not None:
        parts.append(F.col("access_count") <= int(rule["min_access"]))
    if rule.get("concept") is not None:
        parts.append(F.contains(F.lower("content"), F.lit(str(rule["concept"]).lower())))
    if rule.get("memory_type") is not None:
        parts.append(F.col("memory_type") == str(rule["memory_type"]))
    for age in ("ttl_days", "older_than_days"):
        if rule.get(age) is not None:
            parts.append(sc.older_than(F.col("created_at"), float(rule[age]), now))
    return reduce(lambda a, b: a & b, parts)


def apply_retention(memories: DataFrame, rules: list[dict], now: float) -> DataFrame:
    """Add ``action``: what the first matching rule says (delete, archive) or keep.

    A row deleted by one rule is not seen by later ones, so the first match decides.
    """
    action = None
    for rule in rules:
        verb = "archive" if str(rule.get("action", "delete")).lower() == "archive" else "delete"
        hit = rule_matches(rule, now)
        action = F.when(hit, verb) if action is None else action.when(hit, verb)
    return memories.withColumn("action", F.lit("keep") if action is None else action.otherwise("keep"))


def archived(memories: DataFrame, now: float) -> DataFrame:
    """Flag rows with ``action = archive`` in their metadata."""
    meta = F.coalesce(F.from_json("metadata", "map<string,string>"), F.create_map().cast("map<string,string>"))
    extra = F.create_map(F.lit("archived"), F.lit("true"), F.lit("archived_at"), F.lit(str(now)))
    return memories.withColumn(
        "metadata", F.when(F.col("action") == "archive", F.to_json(F.map_concat(meta, extra))).otherwise(F.col("metadata"))
    )


def prune_candidates(
    memories: DataFrame,
    bridge: DataFrame,
    activations: DataFrame,
    now: float,
    min_strength: float = 0.1,
    min_access: int = 0,
    max_age_days: float = 90,
    cold: float = 0.1,
) -> DataFrame:
    """Weak, old, unread rows all of whose concepts are cold.

    The cheap row predicates run before the bridge is joined, so only
    candidates' concepts are looked up.
    """
    eff = sc.effective_strength(F.col("strength"), F.col("access_count"), F.col("last_accessed"), now)
    weak = memories.filter(
        ~F.coalesce(F.col("consolidated"), F.lit(False))
        & ((F.lit(now) - F.col("created_at")) >= max_age_days * DAY)
        & (F.col("access_count") <= min_access)
        & (eff < min_strength)
    )
    hot = activations.select("concept", sc.activation(F.col("count"), F.col("last_activated"), now).alias("a")).filter(
        F.col("a") >= cold
    )
    warm = bridge.join(hot.select("concept"), "concept", "left_semi").select("memory_id").distinct()
    return weak.join(warm, "memory_id", "left_anti")


def forget(memories: DataFrame, ids: DataFrame, *, edges: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Rows and edges that remain once the listed memories are gone.

    Postings, triples, beliefs and the concept bridge derive from the rows.
    """
    gone = ids.select("memory_id").distinct()
    left = memories.join(gone, "memory_id", "left_anti")
    if edges is None:
        return left, None
    kept = edges.join(gone.withColumnRenamed("memory_id", "source_id"), "source_id", "left_anti").join(
        gone.withColumnRenamed("memory_id", "target_id"), "target_id", "left_anti"
    )
    return left, kept


def topic_ids(memories: DataFrame, topic: str, bridge: DataFrame | None = None, concepts: list[str] | None = None) -> DataFrame:
    """Ids of rows about a topic: its concepts or the text itself."""
    hit = memories.filter(F.contains(F.lower("content"), F.lit(topic.strip().lower()))).select("memory_id")
    if bridge is not None and concepts:
        hit = hit.union(bridge.filter(F.col("concept").isin(concepts)).select("memory_id"))
    return hit.distinct()


def erasure_ids(memories: DataFrame, user_id: str | None = None, concept: str | None = None) -> DataFrame:
    """Ids to erase for a user tag and/or a concept text."""
    if user_id is None and concept is None:
        raise ValueError("user_id or concept must be given")
    cond = F.lit(False)
    if user_id is not None:
        cond = cond | F.array_contains(tags_of(F.col("metadata")), f"user:{user_id.strip()}")
    if concept is not None:
        cond = cond | F.contains(F.lower("content"), F.lit(concept.strip().lower()))
    return memories.filter(cond).select("memory_id")


def redact_fields(memories: DataFrame, ids: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """Overwrite text fields of the listed rows by ``[REDACTED]``."""
    marked = memories.join(ids.select("memory_id").distinct().withColumn("_hit", F.lit(True)), "memory_id", "left")
    for field in fields or ["content"]:
        marked = marked.withColumn(
            field, F.when(F.col("_hit") & F.col(field).isNotNull(), F.lit("[REDACTED]")).otherwise(F.col(field))
        )
    return marked.drop("_hit")


def apply_write_policy(
    rows: DataFrame, policy: dict, scope_by_type: dict[str, str] | None = None, scope_by_tag: dict[str, str] | None = None
) -> DataFrame:
    """Write-time hooks of a preset: redaction, tags, scope and the sensitive flag.

    Scope precedence: policy scope, then type, then the most private tag.
    """
    content = F.col("content")
    if policy.get("redact_pii"):
        content = rd.redact_pii(content, policy.get("pii_patterns"))
    out = rows.withColumn("content", content).withColumn("tags", tags_of(F.col("metadata")))
    tags = F.col("tags")
    if policy.get("auto_tag_project"):
        tags = F.array_union(tags, tx.project_tags(F.col("content")))
    if policy.get("keep_tags"):
        none = F.array().cast("array<string>")
        tags = F.array_union(tags, F.when(F.col("memory_type") == "preference", F.array(F.lit("preference"))).otherwise(none))
        tags = F.array_union(tags, F.when(rd.has_commitment(F.col("content")), F.array(F.lit("commitment"))).otherwise(none))
    out = out.withColumn("tags", F.sort_array(tags))
    scope = F.lit(policy["scope"]) if policy.get("scope") else F.col("scope")
    for kind, value in (scope_by_type or {}).items():
        scope = F.when(F.col("memory_type") == kind, value).otherwise(scope)
    for level in SCOPES:
        named = [t for t, s in (scope_by_tag or {}).items() if s == level]
        if named:
            hit = F.arrays_overlap("tags", F.array(*[F.lit(t) for t in named]))
            scope = F.when(hit, level).otherwise(scope)
    marks = F.array(*[F.lit(t) for t in policy.get("sensitive_tags", SENSITIVE_TAGS)])
    flag = F.coalesce(F.col("sensitive"), F.lit(False)) | F.arrays_overlap("tags", marks)
    return out.withColumn("scope", scope).withColumn("sensitive", flag)


def policy_expired(
    memories: DataFrame, preset: str, bridge: DataFrame, activations: DataFrame, now: float
) -> DataFrame:
    """(memory_id, cause) that a preset's scheduled retention removes: ttl, then prune."""
    p = PRESETS[preset]
    ttl = ttl_expired(memories, now, p["ttl_days"], p.get("pin_tag")).select("memory_id", F.lit("ttl").alias("cause"))
    rest = memories.join(ttl, "memory_id", "left_anti")
    strength = 0.2 if preset == "minimal" else 0.1
    weak = prune_candidates(rest, bridge, activations, now, strength, p["prune_min_access"], p["ttl_days"])
    protected = [*p.get("keep_tags", []), *([p["pin_tag"]] if p.get("pin_tag") else [])]
    if protected:
        weak = weak.filter(~F.arrays_overlap(tags_of(F.col("metadata")), F.array(*[F.lit(t) for t in protected])))
    return ttl.unionByName(weak.select("memory_id", F.lit("prune").alias("cause")))
