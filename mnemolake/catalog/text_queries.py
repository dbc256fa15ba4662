"""Tokens, term statistics, redaction, routing, concept extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify as cl
from ..functions import redaction as rd
from ..functions import text as tx
from ..operators import index
from . import query
from .views import table


def sql_list(words: list[str]) -> str:
    return "[" + ",".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def sql_re(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


TOKENS_SQL = "regexp_extract_all(lower(text), '[a-z0-9]+')"
DOC_TOKENS_SQL = f"""
tok AS (SELECT doc_id AS memory_id, {TOKENS_SQL} AS words FROM documents),
idx AS (SELECT memory_id, words, len(words) AS dl FROM tok WHERE len(words) > 0)"""


@query(
    "doc_stats",
    f"""WITH {DOC_TOKENS_SQL}
    SELECT count(*) AS n_docs, sum(dl)::BIGINT AS n_tokens, round(avg(dl), 6) AS avg_len, max(dl) AS max_len FROM idx""",
)
def doc_stats(spark, sf):
    stats = index.corpus_stats(index.lengths(table(spark, sf, "documents"), "doc_id", "text"))
    return stats.withColumn("avg_len", F.round("avg_len", 6))


@query(
    "term_df",
    f"""WITH {DOC_TOKENS_SQL}, t AS (SELECT memory_id, unnest(words) AS term FROM idx)
    SELECT term, count(DISTINCT memory_id) AS df, count(*) AS cf FROM t GROUP BY term""",
)
def term_df(spark, sf):
    return index.document_frequency(index.tokenized(table(spark, sf, "documents"), "doc_id", "text"))


@query(
    "query_token_filter",
    f"""SELECT conv_id, turn, len({TOKENS_SQL}) AS n_index_tokens,
      len(list_filter({TOKENS_SQL}, lambda w: NOT list_contains({sql_list(tx.QUERY_STOPWORDS)}, w))) AS n_query_tokens,
      len(list_filter({TOKENS_SQL}, lambda w: NOT list_contains({sql_list(tx.GRAPH_STOPWORDS)}, w))) AS n_graph_tokens
    FROM conversations""",
)
def query_token_filter(spark, sf):
    text = F.col("text")
    return table(spark, sf, "conversations").select(
        "conv_id",
        "turn",
        F.size(tx.tokens(text)).cast("long").alias("n_index_tokens"),
        F.size(tx.query_tokens(text)).cast("long").alias("n_query_tokens"),
        F.size(tx.graph_tokens(text)).cast("long").alias("n_graph_tokens"),
    )


def sql_lemma(t: str) -> str:
    """The lemma rules as a CASE over ``t`` (already lower case, marks stripped)."""
    n = f"length({t})"

    def cut(k: int) -> str:
        return f"left({t}, {n} - {k})"

    def undouble(k: int) -> str:
        s = cut(k)
        return f"CASE WHEN {n} - {k} > 1 AND right({s}, 1) = substr({s}, {n} - {k} - 1, 1) THEN left({s}, {n} - {k} - 1)"

    return f"""CASE WHEN {t} = 'children' THEN 'child' WHEN {t} = 'liked' THEN 'like' WHEN {t} IN ('goes','went') THEN 'go'
      WHEN {t} LIKE '%ing' AND {n} > 4 THEN {undouble(3)} ELSE {t} END
      WHEN {t} LIKE '%ed' AND {n} > 3 THEN {undouble(2)} ELSE {cut(2)} END
      WHEN {t} LIKE '%ies' AND {n} > 3 THEN {cut(3)} || 'y'
      WHEN {t} LIKE '%es' AND {n} > 2 THEN {cut(2)}
      WHEN {t} LIKE '%s' AND {n} > 3 AND {t} NOT LIKE '%ss' THEN {cut(1)} ELSE {t} END"""


@query(
    "lemma_counts",
    f"""WITH {DOC_TOKENS_SQL}, t AS (SELECT unnest(words) AS w FROM idx),
    g AS (SELECT {sql_lemma('w')} AS lemma, w FROM t)
    SELECT lemma, count(*) AS n, count(DISTINCT w) AS forms FROM g GROUP BY lemma""",
)
def lemma_counts(spark, sf):
    tok = index.tokenized(table(spark, sf, "documents"), "doc_id", "text")
    per_term = index.document_frequency(tok)
    return (
        per_term.groupBy(tx.lemma(F.col("term")).alias("lemma"))
        .agg(F.sum("cf").alias("n"), F.count("*").alias("forms"))
    )


def _egress_sql(level: str) -> str:
    out = "text"
    for pattern, kind in rd.EGRESS_PATTERNS[level]:
        out = f"regexp_replace({out}, {sql_re(pattern)}, '[REDACTED_{kind}]', 'g')"
    return out


def _register_egress(level: str) -> None:
    @query(f"egress_{level}", f"SELECT doc_id, {_egress_sql(level)} AS redacted FROM documents")
    def egress(spark, sf):
        return table(spark, sf, "documents").select("doc_id", rd.redact_egress(F.col("text"), level).alias("redacted"))


for _level in rd.EGRESS_PATTERNS:
    _register_egress(_level)


def _luhn_sql(v: str) -> str:
    d = f"list_transform(range(1, length({v}) + 1), lambda i: CASE WHEN (length({v}) - i) % 2 = 0 THEN substr({v}, i, 1)::INT ELSE substr({v}, i, 1)::INT * 2 - CASE WHEN substr({v}, i, 1)::INT > 4 THEN 9 ELSE 0 END END)"
    return f"list_sum({d}) % 10 = 0"


@query(
    "pii_counts",
    # RE2 has no look-around: the character after a card is doubled so that it can end one match and start the next.
    f"""WITH d AS (SELECT doc_id, text, regexp_replace(text, '((?:[0-9]{{4}}[ -]?){{3}}[0-9]{{4}})([^0-9-])', '\\1\\2\\2', 'g') AS spread FROM documents),
    c AS (SELECT doc_id, text,
        list_transform(regexp_extract_all(spread, '(?:^|[^0-9-])((?:[0-9]{{4}}[ -]?){{3}}[0-9]{{4}})(?:$|[^0-9-])', 1), lambda v: regexp_replace(v, '[^0-9]', '', 'g')) AS cards
      FROM d)
    SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}'))::BIGINT AS emails,
      len(list_filter(cards, lambda v: {_luhn_sql('v')}))::BIGINT AS cards,
      len(regexp_extract_all(text, {sql_re(rd.PII_PATTERNS['address'])}))::BIGINT AS addresses
    FROM c""",
)
def pii_counts(spark, sf):
    """Detected values per document: e-mails, Luhn-valid cards, street addresses."""
    text = F.col("text")

    def n(kind: str):
        return F.size(rd.pii_values(text, kind)).cast("long")

    return table(spark, sf, "documents").select(
        "doc_id",
        n("email").alias("emails"),
        n("credit_card").alias("cards"),
        n("address").alias("addresses"),
    )


@query("pii_redact")
def pii_redact(spark, sf):
    """Write-time redaction of whole texts; the patterns need look-around, so no SQL twin."""
    text = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id", rd.redact_pii(text).alias("redacted"), F.size(rd.pii_found(text)).alias("n_found")
    )


def _share_sql(column: str, preset: str) -> str:
    for pattern, label in rd.SHARE_PRESETS[preset]:
        column = f"regexp_replace({column}, {sql_re(pattern)}, '{label}', 'g')"
    return column


@query(
    "share_redact",
    f"""WITH d AS (SELECT doc_id, text, regexp_replace(text, '[^\\x00-\\x7F]', '_', 'g') AS plain FROM documents)
    SELECT doc_id, {_share_sql('text', 'numbers')} AS no_numbers, {_share_sql('plain', 'pii')} AS no_pii, {_share_sql('plain', 'names')} AS no_names FROM d""",
)
def share_redact(spark, sf):
    """All three presets; word ends are those of ASCII for two of them, so that SQL says the same."""
    plain = F.regexp_replace("text", r"[^\x00-\x7F]", "_")
    return table(spark, sf, "documents").select(
        "doc_id",
        rd.redact_share(F.col("text"), "numbers").alias("no_numbers"),
        rd.redact_share(plain, "pii").alias("no_pii"),
        rd.redact_share(plain, "names").alias("no_names"),
    )


@query(
    "sensitive_topics",
    "SELECT doc_id, CASE "
    + " ".join(
        "WHEN " + " OR ".join(f"regexp_matches(text, {sql_re('(?i)' + p)})" for p in ps) + f" THEN '{t}'"
        for t, ps in rd.SENSITIVE_TOPICS.items()
    )
    + " END AS topic FROM documents",
)
def sensitive_topics(spark, sf):
    return table(spark, sf, "documents").select("doc_id", rd.sensitive_topic(F.col("text")).alias("topic"))


@query(
    "project_tags",
    """WITH r AS (SELECT doc_id, list_transform(regexp_extract_all(text, '(?i)(?:#|project[:\\s-]{0,4})([A-Za-z][A-Za-z0-9_-]{1,})', 1),
        lambda t: regexp_replace(lower(t), '[^a-z0-9-]', '', 'g')) AS raw FROM documents)
    SELECT doc_id, list_sort(list_distinct(list_transform(list_filter(list_transform(raw,
        lambda t: CASE WHEN t LIKE 'project%' AND length(t) > 7 THEN regexp_replace(t, '^project[-_]*', '') ELSE t END), lambda t: t <> ''),
        lambda t: 'project:' || t))) AS tags FROM r""",
)
def project_tags(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.project_tags(F.col("text")).alias("tags"))


def _any_sql(col: str, patterns: list[str], flags: str = "") -> str:
    return "(" + " OR ".join(f"regexp_matches({col}, {sql_re(flags + p)})" for p in patterns) + ")"


def _tier_sql(patterns: list[str], tiers: list[str], scores: list[float]) -> str:
    return (
        f"CASE WHEN NOT {_any_sql('low', patterns)} THEN 0.0 WHEN regexp_matches(low, {sql_re(tiers[0])}) THEN {scores[0]} "
        f"WHEN regexp_matches(low, {sql_re(tiers[1])}) THEN {scores[1]} ELSE {scores[2]} END"
    )


_PREF_SQL = " || ".join(f"regexp_extract_all(low, {sql_re('(?i)' + p)})" for p in cl.PREFERENCE)
ROUTER_SQL = f"""
WITH w AS (SELECT conv_id, turn, regexp_replace(text, '[^\\x00-\\x7F]', '_', 'g') AS words FROM conversations),
l AS (SELECT *, lower(words) AS low FROM w),
s AS (SELECT conv_id, turn, words, low,
  coalesce(list_max(list_transform({_PREF_SQL}, lambda h: CASE WHEN regexp_matches(h, '{cl.PREFERENCE_STRONG}') THEN 0.9
     WHEN regexp_matches(h, '{cl.PREFERENCE_FIRM}') THEN 0.8 ELSE 0.7 END)), 0.0) AS pref,
  {_any_sql('words', cl.PERSON)} AS person, {_any_sql('words', cl.LOCATION)} AS place,
  {_any_sql('words', cl.JOB, '(?i)')} AS job, {_any_sql('words', cl.TOOL, '(?i)')} AS tool,
  {_any_sql('words', cl.GENERIC_FACT, '(?i)')} AS generic,
  {_tier_sql(cl.DECISION, cl.DECISION_TIERS, [0.9, 0.8, 0.7])} AS decision,
  CASE WHEN {_any_sql('low', cl.PLAN_DATE)} THEN 0.85 WHEN {_any_sql('low', cl.PLAN_HINT)} THEN 0.6 ELSE 0.0 END AS plan,
  {_tier_sql(cl.CORRECTION, cl.CORRECTION_TIERS, [0.95, 0.8, 0.6])} AS correction,
  {_tier_sql(cl.OUTCOME, cl.OUTCOME_TIERS, [0.9, 0.8, 0.6])} AS outcome,
  {_any_sql('words', cl.SECRET, '(?i)')} AS secret,
  (trim(low) = '' OR {_any_sql('trim(low)', cl.FLUFF, '(?i)')}) AS fluff FROM l),
f AS (SELECT *, CASE WHEN place OR job THEN 0.8 WHEN person OR tool THEN 0.7 WHEN generic THEN 0.6 ELSE 0.0 END AS fact,
  CASE WHEN tool THEN 'tool' WHEN job THEN 'job' WHEN place THEN 'location' WHEN person THEN 'person' ELSE 'fact' END AS kind FROM s),
b AS (SELECT *, greatest(pref, fact, decision, plan, correction, outcome) AS best FROM f),
c AS (SELECT *, CASE WHEN best <= 0 THEN 'fact' WHEN pref = best THEN 'preference' WHEN fact = best THEN kind WHEN decision = best THEN 'decision'
  WHEN plan = best THEN 'plan' WHEN correction = best THEN 'correction' ELSE 'outcome' END AS category FROM b)
SELECT conv_id, turn, category, best::DOUBLE AS confidence,
  CASE WHEN secret THEN 'rejected_secret' WHEN fluff THEN 'ignored_fluff' WHEN best < 0.6 THEN 'queued' ELSE 'stored' END AS result,
  CASE category WHEN 'preference' THEN 'preference' WHEN 'tool' THEN 'skill' WHEN 'decision' THEN 'event' WHEN 'plan' THEN 'event'
    WHEN 'correction' THEN 'observation' WHEN 'outcome' THEN 'observation' ELSE 'fact' END AS memory_type
FROM c"""


@query("router_classify", ROUTER_SQL)
def router_classify(spark, sf):
    return (
        table(spark, sf, "conversations")
        .select("conv_id", "turn", cl.signals(F.col("text")).alias("sig"))
        .select(
            "conv_id",
            "turn",
            F.col("sig.category").alias("category"),
            F.col("sig.confidence").alias("confidence"),
            cl.route(F.col("sig")).alias("result"),
            cl.memory_type(F.col("sig.category")).alias("memory_type"),
        )
    )


@query(
    "inbox_auto_approve",
    f"""WITH c AS (SELECT conv_id, turn, role, text, lower(text) AS low FROM conversations)
    SELECT role, count(*) AS n, sum(CASE WHEN NOT (regexp_matches(text, {sql_re(cl.HOLD_PATTERN)}) OR regexp_matches(low, '{"|".join(cl.HOLD_WORDS)}'))
       AND (role = 'system' OR regexp_matches(low, '{"|".join(cl.APPROVE_WORDS)}')) THEN 1 ELSE 0 END)::BIGINT AS approved
    FROM c GROUP BY role""",
)
def inbox_auto_approve(spark, sf):
    """Turns as inbox submissions; system turns carry the preference type."""
    kind = F.when(F.col("role") == "system", "preference").otherwise("fact")
    ok = cl.auto_approved(F.col("text"), kind)
    return table(spark, sf, "conversations").groupBy("role").agg(
        F.count("*").alias("n"), F.sum(ok.cast("long")).alias("approved")
    )
