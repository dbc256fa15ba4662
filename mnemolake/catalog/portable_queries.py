"""Import and merge of a store into another, committed as a version and read back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import portable
from ..session import scratch_path
from ..sources.oplog import LoggedStore
from ..sources.versions import VersionedTables
from . import query
from .views import NOW, epoch, table


def stores(spark, sf) -> tuple[portable.Store, portable.Store]:
    """Two stores made of documents: sources whose number is below 10, and the others.

    An edge leads to the next document, a document's concept is its language, a source is an episode and bears its team's
    name.
    """
    docs = table(spark, sf, "documents").select(
        F.col("doc_id").alias("memory_id"), F.col("text").alias("content"), "lang", "n_chars",
        F.regexp_extract("source", r"(\d+)", 1).cast("long").alias("s"),
    )

    def store(rows: DataFrame) -> portable.Store:
        created = F.lit(NOW) - F.col("n_chars") * 1800.0
        return {
            "memories": rows.select("memory_id", "content", created.alias("created_at"), (1 + F.col("n_chars") % 10 / 10).alias("strength")),
            "edges": rows.select(
                F.col("memory_id").alias("source_id"), (F.col("memory_id") + 1).alias("target_id"), F.lit("next").alias("edge_type"),
                F.col("n_chars").cast("double").alias("weight"),
            ),
            "concepts": rows.select("memory_id", F.col("lang").alias("concept"), F.lit("language").alias("category")),
            "episodes": rows.groupBy(F.col("s").alias("episode_id")).agg(
                F.concat(F.lit("team "), (F.first("s") % 7).cast("string")).alias("name"), F.min(created).alias("started_at"),
                F.max(created).alias("ended_at"),
            ),
            "members": rows.select(F.col("s").alias("episode_id"), "memory_id"),
        }

    return store(docs.filter("s < 10")), store(docs.filter("s >= 10"))


def flat(tables: portable.Store) -> DataFrame:
    """All tables of a store as rows (kind, a, b, s, x)."""
    null = F.lit(None).cast("long")
    mem = tables["memories"]
    source = F.coalesce("merged_from", F.lit("")) if "merged_from" in mem.columns else F.lit("")
    dup = F.col("duplicate_of") if "duplicate_of" in mem.columns else null
    parts = [
        mem.select(
            F.lit("memory").alias("kind"), F.col("memory_id").alias("a"), dup.alias("b"),
            F.concat(F.sha2("content", 256), source).alias("s"), F.round("strength", 3).alias("x"),
        ),
        tables["edges"].select(F.lit("edge"), "source_id", "target_id", "edge_type", "weight"),
        tables["concepts"].select(F.lit("concept"), "memory_id", null, "concept", F.lit(0.0)),
        tables["episodes"].select(F.lit("episode"), "episode_id", null, "name", "started_at"),
        tables["members"].select(F.lit("member"), "episode_id", "memory_id", F.lit(""), F.lit(0.0)),
    ]
    return reduce(DataFrame.union, parts)


def portable_sql(mode: str) -> str:
    """``import``, ``newer`` or ``both``; the greedy pass over incoming rows is sequential here."""
    both = mode == "both"
    rest = "reps WHERE NOT old" if both else "reps WHERE NOT old AND rep NOT IN (SELECT a FROM mt)"
    inner = "SELECT b, a, false, similarity FROM pr" if both else (
        "SELECT b, a, false, similarity FROM pr WHERE b NOT IN (SELECT id FROM kept) AND a NOT IN (SELECT b FROM pr WHERE b NOT IN (SELECT id FROM kept))"
    )
    taken = "true" if both else "m.target IS NULL AND m.memory_id = m.rep"
    target = (
        "CASE WHEN d.doc_id = r.rep OR (b.is_old AND b.similarity = 1) THEN b.target ELSE r.rep END AS target, "
        "CASE WHEN d.doc_id = r.rep OR (b.is_old AND b.similarity = 1) THEN b.is_old ELSE false END AS is_old"
        if both
        else "CASE WHEN d.doc_id = r.rep OR b.target IS NOT NULL THEN b.target ELSE r.rep END AS target, coalesce(b.is_old, false) AS is_old"
    )
    named = mode != "import"
    merged = "'other'" if named else "''"
    eps = (
        "SELECT e.episode_id, (SELECT min(o.episode_id) FROM eo o WHERE o.name = e.name) AS old_id, (SELECT min(o.episode_id) FROM en o WHERE o.name = e.name) AS first_id FROM en e"
        if named
        else "SELECT episode_id, NULL::BIGINT AS old_id, episode_id AS first_id FROM en"
    )
    wins = (
        """SELECT i.new_id AS memory_id, arg_max(d.text, (d.created_at, -d.doc_id)) AS text, max(d.strength) AS strength
        FROM ids i JOIN d USING (doc_id) JOIN base t ON t.memory_id = i.new_id WHERE NOT i.taken AND d.created_at > t.created_at GROUP BY ALL"""
        if mode == "newer"
        else "SELECT NULL::BIGINT AS memory_id, NULL::VARCHAR AS text, NULL::DOUBLE AS strength WHERE false"
    )
    dup = "CASE WHEN m.is_old THEN m.target ELSE (SELECT t.new_id FROM ids t WHERE t.doc_id = m.target) END" if both else "NULL::BIGINT"
    return f"""
    WITH RECURSIVE d AS (SELECT doc_id, text, lang, n_chars, regexp_extract(source, '([0-9]+)', 1)::BIGINT AS s, regexp_extract(source, '([0-9]+)', 1)::INT < 10 AS old,
      {NOW} - n_chars * 1800.0::DOUBLE AS created_at, 1 + n_chars % 10 / 10 AS strength, list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS words FROM documents),
    reps AS (SELECT old, words, min(doc_id) AS rep, len(words) AS size FROM d GROUP BY ALL),
    el AS (SELECT old, rep, size, unnest(words) AS w FROM reps),
    mt AS (SELECT a, b, common / (sa + sb - common) AS similarity FROM (
       SELECT x.rep AS a, y.rep AS b, any_value(x.size) AS sa, any_value(y.size) AS sb, count(*) AS common FROM el x JOIN el y ON x.w = y.w AND NOT x.old AND y.old GROUP BY ALL)
       WHERE common / (sa + sb - common) >= 0.85
      UNION ALL SELECT x.rep, y.rep, 1.0 FROM reps x JOIN reps y ON x.size = 0 AND y.size = 0 AND NOT x.old AND y.old),
    rest AS (SELECT rep, words, size FROM {rest}),
    er AS (SELECT rep, size, unnest(words) AS w FROM rest),
    pr AS (SELECT a, b, common / (sa + sb - common) AS similarity FROM (
       SELECT x.rep AS a, y.rep AS b, any_value(x.size) AS sa, any_value(y.size) AS sb, count(*) AS common FROM er x JOIN er y ON x.w = y.w AND x.rep < y.rep GROUP BY ALL)
       WHERE common / (sa + sb - common) >= 0.85),
    o AS (SELECT id, row_number() OVER (ORDER BY id) AS i, coalesce((SELECT list(a) FROM pr WHERE b = id), []) AS prev FROM (SELECT a AS id FROM pr UNION SELECT b FROM pr)),
    p AS (SELECT 0::BIGINT AS i, NULL::BIGINT AS id, []::BIGINT[] AS got, false AS stays
      UNION ALL SELECT i, id, CASE WHEN stays THEN list_append(got, id) ELSE got END, stays FROM (
        SELECT o.i, o.id, p.got, len(list_intersect(o.prev, p.got)) = 0 AS stays FROM p JOIN o ON o.i = p.i + 1)),
    kept AS (SELECT id FROM p WHERE stays),
    cand AS (SELECT a AS rep, b AS target, true AS is_old, similarity FROM mt UNION ALL {inner}),
    best AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY rep ORDER BY similarity DESC, is_old DESC, target) = 1),
    m AS (SELECT d.doc_id AS memory_id, r.rep, {target} FROM d JOIN reps r ON r.words = d.words AND NOT r.old LEFT JOIN best b ON b.rep = r.rep WHERE NOT d.old),
    own AS (SELECT memory_id AS doc_id, (SELECT max(doc_id) FROM d WHERE old) + row_number() OVER (ORDER BY memory_id) AS new_id FROM m WHERE {taken}),
    ids AS (SELECT doc_id, new_id, true AS taken FROM own
      UNION ALL SELECT m.memory_id, CASE WHEN m.is_old THEN m.target ELSE own.new_id END, false FROM m LEFT JOIN own ON own.doc_id = m.target
        WHERE m.memory_id NOT IN (SELECT doc_id FROM own)),
    base AS (SELECT doc_id AS memory_id, NULL::BIGINT AS dup, text, '' AS src, created_at, strength FROM d WHERE old
      UNION ALL SELECT i.new_id, {dup}, d.text, {merged}, d.created_at, d.strength FROM ids i JOIN d USING (doc_id) JOIN m ON m.memory_id = i.doc_id WHERE i.taken),
    wins AS ({wins}),
    eo AS (SELECT s AS episode_id, 'team ' || s % 7 AS name, min(created_at) AS t FROM d WHERE old GROUP BY s),
    en AS (SELECT s AS episode_id, 'team ' || s % 7 AS name, min(created_at) AS t FROM d WHERE NOT old GROUP BY s),
    pl AS ({eps}),
    fr AS (SELECT episode_id, (SELECT max(episode_id) FROM eo) + row_number() OVER (ORDER BY episode_id) AS new_ep FROM pl WHERE old_id IS NULL AND episode_id = first_id),
    em AS (SELECT pl.episode_id, coalesce(pl.old_id, fr.new_ep) AS new_ep FROM pl LEFT JOIN fr ON fr.episode_id = pl.first_id)
    SELECT 'memory' AS kind, b.memory_id AS a, b.dup AS b, sha256(coalesce(w.text, b.text)) || b.src AS s, round(greatest(b.strength, w.strength), 3)::DOUBLE AS x FROM base b LEFT JOIN wins w USING (memory_id)
    UNION ALL SELECT 'edge', doc_id, doc_id + 1, 'next', n_chars FROM d WHERE old
    UNION ALL SELECT 'edge', i.new_id, j.new_id, 'next', n_chars FROM d JOIN ids i USING (doc_id) JOIN ids j ON j.doc_id = d.doc_id + 1
    UNION ALL SELECT 'concept', a, NULL, lang, 0 FROM (SELECT doc_id AS a, lang FROM d WHERE old UNION SELECT i.new_id, lang FROM d JOIN ids i USING (doc_id))
    UNION ALL SELECT 'episode', episode_id, NULL, name, t FROM eo
    UNION ALL SELECT 'episode', new_ep, NULL, name, t FROM en JOIN fr USING (episode_id)
    UNION ALL SELECT 'member', e, m, '', 0 FROM (SELECT s AS e, doc_id AS m FROM d WHERE old UNION SELECT em.new_ep, i.new_id FROM d JOIN ids i USING (doc_id) JOIN em ON em.episode_id = d.s)"""


def _committed(spark, result: portable.Store, existing: portable.Store) -> DataFrame:
    """The result as the second version of a store whose first one holds the existing tables; read back from it."""
    store = VersionedTables(spark, scratch_path(spark, "store"))
    first = store.commit(existing)
    store.commit(result, based_on=first)
    return flat(store.tables())


@query("import_remapped", portable_sql("import"))
def import_remapped(spark, sf):
    """A store imported into another: duplicates resolved, ids and all references rewritten."""
    existing, incoming = stores(spark, sf)
    return _committed(spark, portable.import_store(existing, incoming)[0], existing)


@query("merge_newer_wins", portable_sql("newer"))
def merge_newer_wins(spark, sf):
    """A store merged into another: newer duplicates replace what they duplicate."""
    existing, incoming = stores(spark, sf)
    return _committed(spark, portable.merge_store(existing, incoming, source="other")[0], existing)


@query("merge_keep_both", portable_sql("both"))
def merge_keep_both(spark, sf):
    """A store merged into another with every row kept and duplicates named."""
    existing, incoming = stores(spark, sf)
    return _committed(spark, portable.merge_store(existing, incoming, keep_both=True, source="other")[0], existing)


# What an event writes to the log, by the last digit of its number.
LOG_SQL = """
l AS (SELECT event_id AS seq, event_id % 10 AS r, user_id AS u, (props->>'$.k')::BIGINT AS k, event_type AS t, printf('%.2f', value) AS v FROM events),
dead AS (SELECT u::VARCHAR AS key, max(seq) AS cut FROM l WHERE r = 3 AND k % 4 = 0 GROUP BY u),
mem AS (SELECT 'memory' AS kind, u::VARCHAR AS key, arg_max(t, seq) FILTER (r < 2) AS c1, arg_max(v, seq) FILTER (r < 3) AS c2, arg_max(k::VARCHAR, seq) FILTER (r = 3) AS c3
  FROM l JOIN (SELECT u, max(seq) FILTER (r < 2) AS born, max(seq) FILTER (r = 3 AND k % 4 = 0) AS died FROM l WHERE r < 4 GROUP BY u) USING (u)
  WHERE r < 4 AND born IS NOT NULL AND (died IS NULL OR born > died) AND seq >= born GROUP BY u),
edge AS (SELECT 'edge' AS kind, seq::VARCHAR AS key, u::VARCHAR AS c1, k::VARCHAR AS c2, t AS c3 FROM l
  WHERE (r = 4 OR (r = 5 AND k % 2 = 1)) AND seq NOT IN (SELECT seq - 11 FROM l WHERE r = 5 AND k % 2 = 0)
  AND NOT EXISTS (SELECT 1 FROM dead WHERE dead.key IN (l.u::VARCHAR, l.k::VARCHAR) AND dead.cut > l.seq)),
epi AS (SELECT 'episode', k::VARCHAR, arg_max(t, seq), NULL, NULL FROM l WHERE r = 6 GROUP BY k),
con AS (SELECT 'concept', t || u % 5, arg_max(v, seq), NULL, NULL FROM l WHERE r = 7 GROUP BY t, u % 5),
card AS (SELECT 'card', 'c' || u, arg_max(t, seq) FILTER (r = 8), arg_max(v, seq) FILTER (r = 9), NULL
  FROM l JOIN (SELECT u, max(seq) FILTER (r = 8 AND k % 3 > 0) AS born, max(seq) FILTER (r = 8 AND k % 3 = 0) AS died FROM l WHERE r > 7 GROUP BY u) USING (u)
  WHERE r > 7 AND born IS NOT NULL AND (died IS NULL OR born > died) AND seq >= born GROUP BY u)"""


def event_log(spark, sf) -> DataFrame:
    """events as a log with all ten operations."""
    r, u = F.col("event_id") % 10, F.col("user_id").cast("string")
    k, t = F.get_json_object("props", "$.k"), F.col("event_type")
    v, kn = F.format_string("%.2f", "value"), F.get_json_object("props", "$.k").cast("long")
    seq = F.col("event_id").cast("string")
    card = F.concat(F.lit("c"), u)

    def entry(op: str, **fields) -> Column:
        return F.struct(F.lit(op).alias("operation"), F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()])).alias("data"))

    edge = entry("insert_edge", id=seq, source_id=u, target_id=k, edge_type=t)
    made = (
        F.when(r < 2, entry("insert_memory", id=u, content=t, strength=v))
        .when(r == 2, entry("update_memory", id=u, strength=v))
        .when((r == 3) & (kn % 4 == 0), entry("delete_memory", id=u))
        .when(r == 3, entry("update_memory", id=u, seen=k))
        .when((r == 4) | ((r == 5) & (kn % 2 == 1)), edge)
        .when(r == 5, entry("delete_edge", id=(F.col("event_id") - 11).cast("string")))
        .when(r == 6, entry("insert_episode", id=k, name=t))
        .when(r == 7, entry("insert_concept", name=F.concat(t, (F.col("user_id") % 5).cast("string")), category=v))
        .when((r == 8) & (kn % 3 > 0), entry("insert_card", card_id=card, title=t))
        .when(r == 8, entry("delete_card", card_id=card))
        .otherwise(entry("update_card", card_id=card, score=v))
    )
    return table(spark, sf, "events").select(F.col("event_id").alias("seq"), epoch("ts").alias("timestamp"), made.alias("e")).select("seq", "timestamp", "e.*")


@query(
    "replay_all_ops",
    f"""WITH {LOG_SQL} SELECT * FROM mem UNION ALL SELECT * FROM edge UNION ALL SELECT * FROM epi UNION ALL SELECT * FROM con UNION ALL SELECT * FROM card""",
)
def replay_all_ops(spark, sf):
    """A log of ten operations in three segments; a snapshot is made after the first and the second one."""
    log = event_log(spark, sf)
    kept = LoggedStore(spark, scratch_path(spark, "log"))
    kept.append(log.filter("seq < 3000"))
    kept.compact()
    kept.append(log.filter("seq >= 3000 AND seq < 7000"))
    kept.compact()
    kept.append(log.filter("seq >= 7000"))
    names = {"memory": ["content", "strength", "seen"], "edge": ["source_id", "target_id", "edge_type"], "episode": ["name"],
             "concept": ["category"], "card": ["title", "score"]}

    def cell(i: int) -> Column:
        out = F.lit(None).cast("string")
        for kind, fields in names.items():
            if i < len(fields):
                out = F.when(F.col("kind") == kind, F.try_element_at("fields", F.lit(fields[i]))).otherwise(out)
        return out.alias(f"c{i + 1}")

    return kept.state().select("kind", "key", *[cell(i) for i in range(3)])
