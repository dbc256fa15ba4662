"""Triples, beliefs, bitemporal lookups, contradictions, evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import facts as fx
from ..functions import text as tx
from ..operators import beliefs, conflicts, evidence, references, splits, temporal
from ..operators.conflict_index import ConflictIndex
from ..session import scratch_path
from . import query
from .text_queries import sql_lemma, sql_re
from .views import NOW, ORDER_FACTS_SQL, epoch, order_facts, table


def documents(spark, sf):
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("memory_id"),
        F.col("text").alias("content"),
        (F.lit(NOW) - F.col("n_chars") * 1800.0).alias("created_at"),
    )


# ---- triples -------------------------------------------------------------


def _canon_sql(expr: str) -> str:
    """Canonical entity of an expression, without the alias map's hits ('us', 'la', ...)."""
    known = ", ".join(f"WHEN '{k}' THEN '{v}'" for k, v in tx.DEFAULT_ALIASES.items()).replace(",", "")
    squeezed = f"trim(regexp_replace({expr}, '\\s+', ' ', 'g'))"
    bare0 = f"regexp_replace({squeezed}, '^[\"''`]+|[\"''`]+$', '', 'g')"
    bare = f"trim(regexp_replace({bare0}, '(?i)^(?:a|an|the)\\s+', ''))"
    strip = "regexp_replace(x, '^[^A-Za-z0-9]+|[^A-Za-z0-9'']+$', '', 'g')"
    words = (
        f"list_filter(list_transform(string_split(CASE WHEN bare LIKE '%''s' THEN left(bare, length(bare) - 2) ELSE bare END, ' '), "
        f"lambda x: lower({strip})), lambda x: x <> '')"
    )
    return bare, f"CASE lower(bare) {known} ELSE trim(array_to_string(list_transform({words}, lambda x: {sql_lemma('x')}), ' ')) END"


def _canon_step(src: str, raw: str, out: str) -> str:
    """A CTE body that adds the canonical form of column ``raw`` as ``out``."""
    bare, canon = _canon_sql(raw)
    return f"SELECT * EXCLUDE (bare), {canon} AS {out} FROM (SELECT *, {bare} AS bare FROM {src})"


_TAIL_SQL = (
    "trim(regexp_replace(regexp_replace(regexp_replace({c}, '^[ \"''`]+|[ \"''`]+$', '', 'g'), '(?s)\\b(?:and|or)\\b.*$', ''), '(?s)[.,;!?].*$', ''))"
)
_LEAD_SQL = (
    "trim(regexp_replace(regexp_replace(trim({c}), '(?i)^(?:i think|i guess)\\s+', ''), '(?i)^(?:maybe|might|possibly|perhaps|probably)\\s+', ''))"
)
COPULA_TRIPLES_SQL = f"""
seg AS (SELECT doc_id AS memory_id, generate_subscripts(s, 1) - 1 AS seg, trim(unnest(s)) AS segment
   FROM (SELECT doc_id, regexp_extract_all(text, {sql_re(fx.SEGMENT)}) AS s FROM documents)),
hit AS (SELECT memory_id, seg, generate_subscripts(m, 1) - 1 AS hit, unnest(m) AS fragment, unnest(a) AS g1, unnest(b) AS g3
   FROM (SELECT memory_id, seg, regexp_extract_all(segment, {sql_re(fx.COPULA)}, 0) AS m, regexp_extract_all(segment, {sql_re(fx.COPULA)}, 1) AS a,
     regexp_extract_all(segment, {sql_re(fx.COPULA)}, 3) AS b FROM seg WHERE regexp_matches(segment, {sql_re(fx.COPULA)}))),
pre AS (SELECT memory_id, seg, hit, fragment, {_LEAD_SQL.format(c='g1')} AS sub_raw, {_TAIL_SQL.format(c='g3')} AS obj_raw FROM hit WHERE g1 NOT LIKE '%''s%'),
sub AS ({_canon_step('pre', 'sub_raw', 'subject')}),
obj AS ({_canon_step('sub', 'obj_raw', 'object')}),
trip AS (SELECT memory_id, seg * 1000000 + 200000 + hit * 10 AS seq, subject, 'is' AS predicate, object,
   CASE WHEN regexp_matches(fragment, {sql_re(fx.NEGATION)}) THEN 'negative' ELSE 'positive' END AS polarity,
   CASE WHEN regexp_matches(lower(fragment), 'will|going to') THEN 'future' WHEN regexp_matches(lower(fragment), 'was|were|^\\s*used to|\\b\\w+ed\\b') THEN 'past' ELSE 'present' END AS tense,
   CASE WHEN regexp_matches(fragment, {sql_re(fx.HEDGE)}) THEN 0.5 ELSE 1.0 END AS confidence
   FROM obj WHERE subject <> '' AND object <> '')"""


@query("triples_copula", f"WITH {COPULA_TRIPLES_SQL} SELECT memory_id, seq, subject, object, polarity, tense, confidence::DOUBLE AS confidence FROM trip")
def triples_copula(spark, sf):
    """Triples of the form X is Y over whole documents."""
    t = fx.extract_triples(documents(spark, sf)).filter(F.col("predicate") == "is")
    return t.select("memory_id", "seq", "subject", "object", "polarity", "tense", "confidence")


@query("triples_extract")
def triples_extract(spark, sf):
    """All six phrase families over conversation turns."""
    turns = table(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("memory_id"), F.col("text").alias("content")
    )
    return fx.extract_triples(turns)


@query(
    "triple_beliefs",
    f"""WITH {COPULA_TRIPLES_SQL},
    d AS (SELECT doc_id AS memory_id, {NOW} - n_chars * 1800.0::DOUBLE AS created_at FROM documents),
    n AS (SELECT memory_id, seq, lower(trim(subject)) || '|is' AS fact_key, lower(trim(object)) AS value, polarity, confidence FROM trip),
    f AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY memory_id, fact_key ORDER BY seq) = 1),
    o AS (SELECT f.*, created_at, lag(value) OVER w AS pv, lag(polarity) OVER w AS pp FROM f JOIN d USING (memory_id) WINDOW w AS (PARTITION BY fact_key ORDER BY created_at, memory_id)),
    k AS (SELECT * FROM o WHERE NOT (value IS NOT DISTINCT FROM pv AND polarity IS NOT DISTINCT FROM pp))
    SELECT fact_key, value, memory_id, created_at AS valid_from, lead(created_at) OVER (PARTITION BY fact_key ORDER BY created_at, memory_id) AS valid_to,
      CASE WHEN value = pv AND polarity <> pp THEN 'user correction' ELSE 'new information' END AS reason, confidence::DOUBLE AS confidence FROM k""",
)
def triple_beliefs(spark, sf):
    docs = documents(spark, sf)
    t = fx.extract_triples(docs).filter(F.col("predicate") == "is")
    versions = beliefs.belief_versions(beliefs.statements(t, docs))
    return versions.select("fact_key", "value", "memory_id", "valid_from", "valid_to", "reason", "confidence")


@query(
    "evidence_chains",
    f"""WITH {COPULA_TRIPLES_SQL},
    d AS (SELECT doc_id AS memory_id, {NOW} - n_chars * 1800.0::DOUBLE AS created_at FROM documents),
    one AS (SELECT memory_id, subject, predicate, object, polarity, min_by(confidence, seq) AS confidence FROM trip GROUP BY ALL),
    b AS (SELECT subject, object, polarity, trim(subject || CASE polarity WHEN 'negative' THEN ' not ' ELSE ' ' END || predicate || ' ' || object) AS claim,
      count(*) AS n, avg(confidence) AS support, min(created_at) AS first_seen, max(created_at) AS last_confirmed FROM one JOIN d USING (memory_id) GROUP BY ALL)
    SELECT b.claim, b.n AS n_supporting, coalesce(o.n, 0) AS n_contradicting,
      round(greatest(0, least(1, b.support - least(0.4, 0.1 * coalesce(o.n, 0)))), 6)::DOUBLE AS confidence, b.first_seen, b.last_confirmed
    FROM b LEFT JOIN b o ON o.subject = b.subject AND o.object = b.object AND o.polarity <> b.polarity""",
)
def evidence_chains(spark, sf):
    docs = documents(spark, sf)
    t = fx.extract_triples(docs).filter(F.col("predicate") == "is")
    return evidence.evidence_chains(evidence.claims(t, docs))


# ---- beliefs over orders -------------------------------------------------

VERSIONS_SQL = f"""
f AS ({ORDER_FACTS_SQL}),
o AS (SELECT *, lag(value) OVER w AS pv, lag(polarity) OVER w AS pp FROM f WINDOW w AS (PARTITION BY fact_key ORDER BY created_at, memory_id)),
k AS (SELECT * FROM o WHERE NOT (value IS NOT DISTINCT FROM pv AND polarity IS NOT DISTINCT FROM pp)),
v AS (SELECT fact_key, value, memory_id, created_at AS valid_from, lead(created_at) OVER (PARTITION BY fact_key ORDER BY created_at, memory_id) AS valid_to,
   CASE WHEN value = pv AND polarity <> pp THEN 'user correction' WHEN abs(left(value, 1)::INT - left(pv, 1)::INT) >= 3 THEN 'contradiction resolved' ELSE 'new information' END AS reason FROM k)"""


def order_versions(spark, sf):
    far_apart = F.abs(F.substring("value", 1, 1).cast("int") - F.substring("prev_value", 1, 1).cast("int")) >= 3
    # Order dates span years: a week per slice keeps slices small for a hot customer.
    return beliefs.belief_versions(order_facts(spark, sf), far_apart, slice_seconds=7 * 86400.0).select(
        "fact_key", "value", "memory_id", "valid_from", "valid_to", "reason"
    )


@query("belief_scd2", f"WITH {VERSIONS_SQL} SELECT * FROM v")
def belief_scd2(spark, sf):
    return order_versions(spark, sf)


@query("belief_current", f"WITH {VERSIONS_SQL} SELECT fact_key, value, memory_id, valid_from, reason FROM v WHERE valid_to IS NULL")
def belief_current(spark, sf):
    return beliefs.current_beliefs(order_versions(spark, sf)).drop("valid_to")


@query("belief_reasons", f"WITH {VERSIONS_SQL} SELECT reason, count(*) AS n, count(DISTINCT fact_key) AS n_keys FROM v GROUP BY reason")
def belief_reasons(spark, sf):
    return order_versions(spark, sf).groupBy("reason").agg(
        F.count("*").alias("n"), F.countDistinct("fact_key").alias("n_keys")
    )


@query(
    "belief_report",
    f"""WITH {VERSIONS_SQL}, c AS (SELECT fact_key, count(*) AS versions FROM v GROUP BY fact_key)
    SELECT fact_key, value, versions, CASE WHEN 996710400.0 - valid_from <= 86400 THEN 'recent' ELSE 'stable' END AS flag
    FROM v JOIN c USING (fact_key) WHERE valid_to IS NULL""",
)
def belief_report(spark, sf):
    versions = order_versions(spark, sf).withColumn("confidence", F.lit(1.0))
    return beliefs.belief_report(versions, 996710400.0).select("fact_key", "value", "versions", "flag")


@query(
    "belief_history_topic",
    f"WITH {VERSIONS_SQL} SELECT fact_key, value, valid_from, valid_to FROM v WHERE contains(fact_key, 'customer 12')",
)
def belief_history_topic(spark, sf):
    return beliefs.belief_history(order_versions(spark, sf), "Customer  12").select(
        "fact_key", "value", "valid_from", "valid_to"
    )


@query(
    "what_changed",
    f"WITH {VERSIONS_SQL} SELECT reason, value, count(*) AS n FROM v WHERE valid_from >= 978307200.0 GROUP BY ALL",
)
def what_changed(spark, sf):
    """Belief versions opened since the start of 2001."""
    return beliefs.beliefs_since(order_versions(spark, sf), 978307200.0).groupBy("reason", "value").agg(
        F.count("*").alias("n")
    )


@query(
    "fact_versions",
    f"""WITH f AS ({ORDER_FACTS_SQL}) SELECT memory_id, fact_key, row_number() OVER w AS version, count(*) OVER (PARTITION BY fact_key) AS n_versions,
      row_number() OVER w = count(*) OVER (PARTITION BY fact_key) AS current FROM f WINDOW w AS (PARTITION BY fact_key ORDER BY created_at, memory_id)""",
)
def fact_versions(spark, sf):
    return beliefs.numbered_versions(order_facts(spark, sf)).select(
        "memory_id", "fact_key", "version", "n_versions", "current"
    )


@query(
    "as_of_latest",
    f"""WITH f AS ({ORDER_FACTS_SQL}) SELECT fact_key, memory_id, value, created_at FROM f WHERE created_at <= 915148800.0
    QUALIFY row_number() OVER (PARTITION BY fact_key ORDER BY created_at DESC, memory_id DESC) = 1""",
)
def as_of_latest(spark, sf):
    return temporal.as_of(order_facts(spark, sf), 915148800.0, "fact_key").select(
        "fact_key", "memory_id", "value", "created_at"
    )


@query(
    "during_overlap",
    f"""WITH {VERSIONS_SQL} SELECT fact_key, value, memory_id, valid_from, valid_to FROM v
    WHERE valid_from <= 891388800.0 AND coalesce(valid_to, 'inf'::DOUBLE) >= 883612800.0 AND coalesce(valid_to, 'inf'::DOUBLE) > 883612800.0 AND valid_from < 891388800.0""",
)
def during_overlap(spark, sf):
    return temporal.during(order_versions(spark, sf), 891388800.0, 883612800.0).select(
        "fact_key", "value", "memory_id", "valid_from", "valid_to"
    )


@query(
    "timeline_month",
    f"""WITH f AS ({ORDER_FACTS_SQL}) SELECT memory_id, fact_key, value, created_at FROM f WHERE created_at >= 888710400.0 AND created_at < 891388800.0""",
)
def timeline_month(spark, sf):
    from ..functions.timeparse import month_range

    start, end = month_range("March 1998")
    return temporal.in_month(order_facts(spark, sf), start, end).select("memory_id", "fact_key", "value", "created_at")


@query(
    "supersedes_chain",
    f"""WITH RECURSIVE f AS ({ORDER_FACTS_SQL}), e AS (SELECT memory_id, lag(memory_id) OVER (PARTITION BY fact_key ORDER BY created_at, memory_id) AS prev FROM f),
    c AS (SELECT memory_id, memory_id AS chain_id, 1 AS version FROM e WHERE prev IS NULL AND memory_id IN (SELECT prev FROM e)
      UNION ALL SELECT e.memory_id, c.chain_id, c.version + 1 FROM e JOIN c ON e.prev = c.memory_id)
    SELECT memory_id, chain_id, version::BIGINT AS version, memory_id NOT IN (SELECT prev FROM e WHERE prev IS NOT NULL) AS current FROM c""",
)
def supersedes_chain(spark, sf):
    """Each order of a customer supersedes the one before; walk the chains."""
    from ..operators import graph

    near = splits.with_neighbor(
        order_facts(spark, sf).select("fact_key", "memory_id", "created_at"),
        ["fact_key"], "created_at", "memory_id", ["memory_id"], slice_seconds=7 * 86400.0,
    )
    edges = near.filter(F.col("prev_memory_id").isNotNull()).select(
        F.col("memory_id").alias("source_id"), F.col("prev_memory_id").alias("target_id"), F.lit("supersedes").alias("edge_type")
    )
    return graph.chain_versions(edges)


@query("latest_facts_greedy")
def latest_facts_greedy(spark, sf):
    """Orders as rows with several keys (customer, priority and status): greedy newest-first selection."""
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("memory_id"),
        epoch("o_orderdate").alias("start"),
        F.col("o_custkey").cast("string").alias("k1"),
        F.concat_ws("/", "o_orderpriority", "o_orderstatus", F.date_format("o_orderdate", "yyyy-MM")).alias("k2"),
    )
    keys = orders.select("memory_id", F.explode(F.array("k1", "k2")).alias("key"))
    return temporal.latest_facts(orders.select("memory_id", "start"), keys)


# ---- contradictions ------------------------------------------------------

# The attribute rule reads at most three digits, so larger scores state nothing.
NUMERIC_SQL = """
n AS (SELECT c_custkey AS memory_id, c_nationkey AS nation, 'score' AS attribute, round(abs(c_acctbal) / 10)::INT::DOUBLE AS value FROM customer
   WHERE round(abs(c_acctbal) / 10)::INT < 1000)"""


@query(
    "contradiction_numeric",
    f"""WITH {NUMERIC_SQL} SELECT nation, attribute, min(value) AS low, max(value) AS high, count(DISTINCT value) AS n_values, count(*) AS n_statements,
      round(greatest(0.4, least(1.0, 0.5 + (max(value) - min(value)) / (greatest(max(value), 1.0) + max(value) - min(value)))), 6) AS confidence
    FROM n GROUP BY ALL HAVING count(DISTINCT value) > 1""",
)
def contradiction_numeric(spark, sf):
    """Customers state a score about their nation; the text goes through the attribute parser."""
    return conflicts.numeric_groups(nation_scores(spark, sf), ["nation"])


def nation_scores(spark, sf):
    cust = table(spark, sf, "customer")
    number = F.round(F.abs("c_acctbal") / 10).cast("int").cast("string")
    text = F.concat(F.lit("The nation has a score: "), number, F.lit(" now."))
    rows = cust.select(F.col("c_custkey").alias("memory_id"), F.col("c_nationkey").alias("nation"), text.alias("content"))
    return conflicts.numeric_statements(rows).join(rows.select("memory_id", "nation"), "memory_id")


@query(
    "numeric_disputes",
    f"""WITH {NUMERIC_SQL}, g AS (SELECT nation, min(value) AS low, max(value) AS high FROM n GROUP BY nation HAVING count(DISTINCT value) > 1),
    p AS (SELECT a.memory_id, a.nation, a.value, b.value AS rival,
       0.5 + abs(a.value - b.value) / (greatest(a.value, b.value, 1.0) + abs(a.value - b.value)) AS conf FROM n a JOIN g USING (nation)
       JOIN (SELECT DISTINCT nation, value FROM n) b ON b.nation = a.nation AND b.value <> a.value)
    SELECT memory_id, nation, value, round(max(greatest(0.4, least(1.0, conf))), 6) AS confidence FROM p GROUP BY ALL""",
)
def numeric_disputes(spark, sf):
    """The strongest conflicting value of every statement, found without pairing statements."""
    return conflicts.numeric_disputes(nation_scores(spark, sf), ["nation"]).select(
        "memory_id", "nation", "value", "confidence"
    )


PETS_SQL = """
s AS (SELECT c_custkey AS memory_id, c_nationkey AS nation, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN ['cat'] WHEN 'BUILDING' THEN ['dog'] WHEN 'FURNITURE' THEN ['bird'] WHEN 'MACHINERY' THEN ['cat','dog'] ELSE ['fish'] END AS members FROM customer)"""


@query(
    "mutual_exclusion",
    f"""WITH {PETS_SQL}, c AS (SELECT nation, members, count(*) AS n, min(memory_id) AS first_id FROM s GROUP BY ALL)
    SELECT a.nation, 3 AS set_id, a.members AS members_a, b.members AS members_b, a.n AS n_a, b.n AS n_b, a.first_id AS first_a, b.first_id AS first_b, 0.95 AS confidence
    FROM c a JOIN c b ON a.nation = b.nation AND a.members < b.members""",
)
def mutual_exclusion(spark, sf):
    """Each customer's segment names a pet; customers of one nation contradict each other."""
    cust = table(spark, sf, "customer")
    seg = F.col("c_mktsegment")
    pet = (
        F.when(seg == "AUTOMOBILE", "My pet is a cat.")
        .when(seg == "BUILDING", "My pet is a dog!")
        .when(seg == "FURNITURE", "My pet is a bird.")
        .when(seg == "MACHINERY", "A cat, or a dog?")
        .otherwise("Only a fish")
    )
    rows = cust.select(F.col("c_custkey").alias("memory_id"), F.col("c_nationkey").alias("nation"), pet.alias("content"))
    stated = conflicts.exclusive_statements(rows).join(rows.select("memory_id", "nation"), "memory_id")
    return conflicts.exclusive_classes(stated, ["nation"])


_SIG_CLEAN = "lower(trim(text))"
for _short, _long in fx.CONTRACTIONS.items():
    _SIG_CLEAN = f"replace({_SIG_CLEAN}, '{_short.replace(chr(39), chr(39) * 2)}', '{_long}')"
_STEM_SQL = """CASE WHEN w LIKE '%ing' AND length(w) > 4 THEN left(w, length(w) - 3) WHEN w LIKE '%ies' AND length(w) > 3 THEN left(w, length(w) - 3) || 'y'
  WHEN w LIKE '%ed' AND length(w) > 3 THEN left(w, length(w) - 2) WHEN w LIKE '%s' AND length(w) > 3 THEN left(w, length(w) - 1) ELSE w END"""


@query(
    "contradiction_polarity",
    f"""WITH {COPULA_TRIPLES_SQL},
    st AS (SELECT memory_id * 1000000000 + seq AS sid, subject || CASE WHEN quality = 0 THEN ' not ' ELSE ' ' END || predicate || ' ' || object AS text FROM trip JOIN labels ON doc_id = memory_id),
    cl AS (SELECT sid, regexp_extract_all(trim(regexp_replace(regexp_replace({_SIG_CLEAN}, '[^a-z0-9\\- ]+', ' ', 'g'), '\\s+', ' ', 'g')), '[a-z0-9\\-]+') AS ws FROM st),
    sg AS (SELECT sid, list_sort(list_distinct(list_transform(list_filter(ws, lambda w: NOT list_contains({[*fx.SIGNATURE_SKIP, *fx.NEGATION_TOKENS]}, w)), lambda w: {_STEM_SQL}))) AS words,
       list_has_any(ws, {fx.NEGATION_TOKENS}) AS negated FROM cl),
    c AS (SELECT words, negated, count(*) AS n, min(sid) AS first_id FROM sg WHERE len(words) > 0 GROUP BY ALL),
    e AS (SELECT first_id, negated, n, len(words) AS size, unnest(words) AS w FROM c),
    p AS (SELECT a.first_id AS a, b.first_id AS b, any_value(a.n) AS n_a, any_value(b.n) AS n_b, count(*) AS common, any_value(a.size) AS sa, any_value(b.size) AS sb
       FROM e a JOIN e b ON a.w = b.w AND NOT a.negated AND b.negated GROUP BY ALL)
    SELECT a, b, n_a, n_b, round(common / (sa + sb - common), 6) AS similarity, round(0.55 + 0.35 * common / (sa + sb - common), 6) AS confidence
    FROM p WHERE common / (sa + sb - common) >= 0.5""",
)
def contradiction_polarity(spark, sf):
    """Claims of labelled documents, denied by the low-quality ones: overlapping plain and negated signatures."""
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("memory_id"), "quality")
    t = fx.extract_triples(documents(spark, sf)).filter(F.col("predicate") == "is").join(labels, "memory_id")
    text = F.concat("subject", F.when(F.col("quality") == 0, " not ").otherwise(" "), "predicate", F.lit(" "), "object")
    claims = t.select((F.col("memory_id") * 1_000_000_000 + F.col("seq")).alias("memory_id"), text.alias("content"))
    return conflicts.polarity_conflicts(claims)


def _offers(spark, sf):
    """Statements of customers (the store) and of suppliers (the batch), with the concepts nation and goods."""
    goods = F.array(*[F.lit(g) for g in GOODS])

    def rows(name: str, key: str, nation: str, balance: str, which):
        people = table(spark, sf, name).select(F.col(key).alias("memory_id"), F.col(nation).alias("nation"), F.col(balance).alias("bal"), which.alias("goods"))
        pet = F.element_at(F.array(*[F.lit(p) for p in PETS]), (F.col("memory_id") % len(PETS) + 1).cast("int"))
        text = F.concat(
            F.lit("Buyers in nation"), F.col("nation").cast("string"), F.when(F.col("bal") < 0, " do not like ").otherwise(" like "),
            F.col("goods"), F.lit(" goods and "), pet, F.lit(". Score: "), F.round(F.abs("bal") / 100).cast("int").cast("string"),
        )
        return people.select(
            "memory_id", text.alias("content"), (NOW - (F.col("memory_id") * 37 % 400) * 7200.0).alias("created_at"), "nation", "goods"
        )

    store = rows("customer", "c_custkey", "c_nationkey", "c_acctbal", F.lower("c_mktsegment"))
    batch = rows("supplier", "s_suppkey", "s_nationkey", "s_acctbal", F.element_at(goods, (F.col("s_suppkey") % len(GOODS) + 1).cast("int")))

    def bridge(df):
        return df.select("memory_id", F.explode(F.array(F.concat(F.lit("nation "), F.col("nation").cast("string")), "goods")).alias("concept"))

    batch = batch.withColumn("memory_id", F.col("memory_id") + BATCH_IDS)
    return store, bridge(store), batch, bridge(batch)


GOODS = ["automobile", "building", "furniture", "household", "machinery"]
PETS = ["a cat", "one dog", "a bird or a fish", "nothing else"]
BATCH_IDS = 10_000_000_000


def _offer_sql(name: str, key: str, nation: str, balance: str, goods: str, shift: int) -> str:
    return f"""SELECT {key} + {shift} AS id, {nation} AS nation, {goods} AS goods, round(abs({balance}) / 100)::INT::DOUBLE AS number,
      CASE {key} % 4 WHEN 0 THEN 'cat' WHEN 1 THEN 'dog' WHEN 2 THEN 'bird fish' END AS members, {NOW} - ({key} * 37 % 400) * 7200.0::DOUBLE AS t,
      'Buyers in nation' || {nation} || CASE WHEN {balance} < 0 THEN ' do not like ' ELSE ' like ' END || {goods} || ' goods and '
        || CASE {key} % 4 WHEN 0 THEN 'a cat' WHEN 1 THEN 'one dog' WHEN 2 THEN 'a bird or a fish' ELSE 'nothing else' END
        || '. Score: ' || round(abs({balance}) / 100)::INT AS text FROM {name}"""


@query(
    "check_new_batch",
    f"""WITH m AS ({_offer_sql('customer', 'c_custkey', 'c_nationkey', 'c_acctbal', 'lower(c_mktsegment)', 0)}
      UNION ALL {_offer_sql('supplier', 's_suppkey', 's_nationkey', 's_acctbal', f"{GOODS}[s_suppkey % {len(GOODS)} + 1]", BATCH_IDS)}),
    cl AS (SELECT id, regexp_extract_all(trim(regexp_replace(regexp_replace({_SIG_CLEAN}, '[^a-z0-9\\- ]+', ' ', 'g'), '\\s+', ' ', 'g')), '[a-z0-9\\-]+') AS ws FROM m),
    sg AS (SELECT id, list_distinct(list_transform(list_filter(ws, lambda w: NOT list_contains({[*fx.SIGNATURE_SKIP, *fx.NEGATION_TOKENS]}, w)), lambda w: {_STEM_SQL})) AS words,
       list_has_any(ws, {fx.NEGATION_TOKENS}) AS negated FROM cl),
    a AS (SELECT * FROM m JOIN sg USING (id)),
    p AS (SELECT x.id AS new_id, y.id AS rival_id, abs(x.t - y.t) AS age, abs(x.number - y.number) AS d, greatest(x.number, y.number, 1.0) AS base,
       x.members <> y.members AS excluded, x.negated <> y.negated AS opposed, len(list_intersect(x.words, y.words)) AS common, len(x.words) + len(y.words) AS total
       FROM a x JOIN a y ON x.id >= {BATCH_IDS} AND y.id < {BATCH_IDS} AND (x.nation = y.nation OR x.goods = y.goods)),
    c AS (SELECT new_id, rival_id, age, 'numeric_range' AS kind, greatest(0.4, least(1.0, 0.5 + d / (base + d))) AS confidence, d FROM p WHERE d > 0
      UNION ALL SELECT new_id, rival_id, age, 'mutual_exclusion', 0.95, 0 FROM p WHERE excluded
      UNION ALL SELECT new_id, rival_id, age, 'polarity', 0.55 + 0.35 * (common / (total - common)), 0 FROM p WHERE opposed AND common / (total - common) >= 0.5),
    f AS (SELECT * FROM c UNION ALL SELECT new_id, rival_id, age, 'temporal_conflict', confidence / (1 + age / 86400), 0 FROM c WHERE confidence / (1 + age / 86400) >= 0.1)
    SELECT new_id, kind, rival_id, round(confidence, 6) AS confidence FROM f
    QUALIFY row_number() OVER (PARTITION BY new_id, kind ORDER BY confidence DESC, d DESC, rival_id) = 1""",
)
def check_new_batch(spark, sf):
    """What suppliers state, checked against a stored index of what customers stated, written in two steps."""
    store, bridge, batch, batch_bridge = _offers(spark, sf)
    index = ConflictIndex(spark, scratch_path(spark, "conflicts"))
    early = F.col("created_at") < NOW - 15 * 86400.0
    index.write(store.filter(early), bridge)
    index.append(store.filter(~early), bridge)
    return index.check(batch, batch_bridge)


# ---- pronouns --------------------------------------------------------------


def _name_label_sql(raw: str) -> tuple[str, str]:
    """Bare form and label of a name, its capitals kept."""
    bare, label = _canon_sql(raw)
    return bare, label.replace("lambda x: lower(regexp_replace(", "lambda x: (regexp_replace(").replace(
        f"lambda x: {sql_lemma('x')}", f"lambda x: CASE WHEN regexp_matches(x, '^[A-Z][a-z]') THEN x ELSE list_transform([lower(x)], lambda y: {sql_lemma('y')})[1] END"
    )


_BARE_NAME_SQL, _NAME_LABEL_SQL = _name_label_sql("raw")
_SPOKEN = [*references.PERSON_PRONOUNS, references.THING_PRONOUN]
REFERENTS_SQL = f"""
tx AS (SELECT conv_id, turn, regexp_replace(text, '[^\\x00-\\x7F\\p{{P}}\\p{{S}}\\p{{Z}}\\p{{C}}\\p{{M}}]', '_', 'g') AS text FROM conversations),
nm AS (SELECT conv_id, turn, generate_subscripts(n, 1) AS i, unnest(n) AS raw FROM (SELECT conv_id, turn, regexp_extract_all(text, {sql_re(references.NAME)}) AS n FROM tx)),
lb AS (SELECT *, {_NAME_LABEL_SQL} AS label FROM (SELECT *, {_BARE_NAME_SQL} AS bare FROM nm WHERE NOT list_contains({references.NEVER_NAMES}, lower(raw)))),
ps AS (SELECT conv_id, turn, i, label, string_split(lower(label), ' ') AS ws,
   CASE WHEN (label = lower(label) AND contains(label, ' ')) OR list_has_any(ws, {references.THING_WORDS}) THEN false
     WHEN list_contains({references.PERSON_WORDS}, lower(label)) THEN true WHEN list_has_any(ws, {references.PERSON_WORDS}) THEN false
     ELSE regexp_matches(raw, '^[A-Z][a-z]') AND ws[1] NOT IN ('the', 'a', 'an') AND length(label) > 1 END AS person FROM lb WHERE label <> ''),
pt AS (SELECT conv_id, turn, max_by(label, i) FILTER (person) AS person, max_by(label, i) FILTER (NOT person) AS thing FROM ps GROUP BY ALL),
cr AS (SELECT conv_id, turn, text, last_value(person IGNORE NULLS) OVER w AS person, last_value(thing IGNORE NULLS) OVER w AS thing
   FROM tx LEFT JOIN pt USING (conv_id, turn) WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
rf AS (SELECT conv_id, turn, pronoun, CASE pronoun WHEN 'it' THEN thing ELSE person END AS referent
   FROM cr, (SELECT unnest({_SPOKEN}) AS pronoun) WHERE regexp_matches(lower(text), '\\b' || pronoun || '\\b') AND referent IS NOT NULL)"""


@query("pronoun_referents", f"WITH {REFERENTS_SQL} SELECT conv_id, turn, pronoun, referent FROM rf")
def pronoun_referents(spark, sf):
    """What the pronouns of every turn refer to, by the names in the turns of its conversation so far."""
    return references.referents(table(spark, sf, "conversations"), "conv_id", "turn")


@query("pronouns_resolved", f"WITH {REFERENTS_SQL} SELECT conv_id, pronoun, max_by(referent, turn) AS referent FROM rf GROUP BY ALL")
def pronouns_resolved(spark, sf):
    """The referent of each pronoun at the end of its conversation."""
    return references.resolved(references.referents(table(spark, sf, "conversations"), "conv_id", "turn"), "conv_id", "turn")
