"""Concept extraction against a lexicon table, concept statistics and upkeep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scoring as sc
from ..functions import text as tx
from ..session import broadcast_upto, top_per_group
from .index import term_sets

LEXICON_BROADCAST_ROWS = 100_000

# A small sample lexicon of household and travel words, so that the operators run without one. The lexicon is an
# input of the engine: pass any (alias, concept, category) table instead.
STARTER = {
    ("kitchen", "home"): ["kitchen", "oven", "stove", "fridge", "dishwasher"],
    ("garden", "home"): ["garden", "lawn", "hedge", "compost", "greenhouse"],
    ("repair", "home"): ["repair", "leak", "plumber", "electrician", "spare part"],
    ("train", "travel"): ["train", "railway", "platform", "sleeper car"],
    ("flight", "travel"): ["flight", "airport", "boarding pass", "layover"],
    ("lodging", "travel"): ["hotel", "hostel", "guest house", "check in"],
    ("budget", "money"): ["budget", "savings", "expense", "monthly rent"],
    ("tax", "money"): ["tax", "tax return", "deduction", "refund"],
    ("sport", "leisure"): ["sport", "football", "tennis", "running shoes"],
    ("music", "leisure"): ["music", "guitar", "choir", "string quartet"],
    ("reading", "leisure"): ["novel", "library", "reading list"],
    ("weather", "nature"): ["weather", "rain", "storm", "heat wave", "first snow of the year"],
}

# Single aliases that are never taken on their own.
ALIAS_STOPLIST = ["r", "go", "es"]

# Compounds inside which an ambiguous alias does not count. Entries with a product's name are left out.
COMPOUNDS = {
    "sync": [
        r"federation\s+sync", r"file\s+sync", r"data\s+sync", r"sync\s+protocol",
        r"sync\s+engine", r"syncthing", r"rsync", r"clock\s+sync", r"time\s+sync",
        r"sync\s+server", r"sync\s+client", r"sync\s+service", r"sync\s+layer",
        r"sync\s+mechanism", r"git\s+sync", r"repo\s+sync", r"peer\s+sync",
        r"bidirectional\s+sync", r"memory\s+sync",
    ],
    "memory": [
        r"memory\s+database", r"memory\s+engine", r"memory\s+system",
        r"memory\s+project", r"memory\s+store", r"memory\s+index",
        r"memory\s+record", r"memory\s+object", r"memory\s+graph",
        r"memory\s+layer", r"in[\-\s]memory",
        r"memory\s+for\s+ai", r"memory\s+retrieval", r"memory\s+recall",
    ],
    "node": [
        r"federation\s+node", r"peer\s+node",
        r"graph\s+node", r"tree\s+node", r"merkle\s+node",
        r"compute\s+node", r"cluster\s+node",
    ],
}
PATH_PATTERN = r"[A-Za-z]:\\[^\s\"'`]+|/(?:[^\s\"'`]+/?)*"
VERSION_PATTERN = r"\bv\d+(?:\.\d+){1,3}\b|\b\d+(?:\.\d+){1,3}\b"


def starter_lexicon(spark: SparkSession) -> DataFrame:
    rows = [(alias, c, cat) for (c, cat), aliases in STARTER.items() for alias in [c, *aliases]]
    return spark.createDataFrame(rows, "alias string, concept string, category string").distinct()


def prepare_lexicon(lexicon: DataFrame) -> DataFrame:
    """Normalised aliases, canonical concept names, word count; stop-listed aliases out."""
    return (
        lexicon.select(
            tx.normalize_alias(F.col("alias")).alias("alias"),
            tx.canonical(F.col("concept")).alias("concept"),
            "category",
        )
        .filter((F.col("alias") != "") & (F.col("concept") != "") & ~F.col("alias").isin(ALIAS_STOPLIST))
        .withColumn("n_words", F.size(F.split("alias", " ")))
        .distinct()
    )


def _suppressed_aliases(low: Column) -> Column:
    """Ambiguous aliases that the text uses only inside one of their technical compounds."""
    marks = []
    for word, compounds in COMPOUNDS.items():
        pattern = "|".join(compounds)
        alone = F.regexp_replace(low, pattern, " ").rlike(rf"\b{word}\b")
        marks.append(F.when(low.rlike(pattern) & ~alone, word))
    return F.array_compact(F.array(*marks))


def extract_concepts(
    memories: DataFrame, lexicon: DataFrame, max_words: int = 4, punctuated: list[str] | None = None
) -> DataFrame:
    """(memory_id, concept, category) found in ``content``.

    Word n-grams (longest alias per start position wins) are joined with the
    lexicon; ``punctuated`` lists aliases with other characters. The lexicon is
    broadcast only while it stays under a checked row bound. Only n-grams whose
    first word opens some alias are formed.
    """
    lex = broadcast_upto(prepare_lexicon(lexicon), LEXICON_BROADCAST_ROWS)
    if max_words == 1:
        single = term_sets(memories).withColumnRenamed("term", "alias").join(lex, "alias")
        return _with_marks(single, memories, lex, punctuated)
    tokens = memories.select("memory_id", tx.tokens(F.col("content")).alias("w"))
    single = tokens.select("memory_id", F.posexplode_outer("w").alias("pos", "alias")).join(lex, "alias")
    longer = lex.filter(F.col("n_words") > 1)
    opening = F.split("alias", " ")[0].alias("first")
    starts = tokens.select("memory_id", "w", F.posexplode_outer("w").alias("pos", "first")).join(
        longer.select(opening).distinct(), "first", "left_semi"
    )
    sizes = F.sequence(F.lit(1), F.least(F.lit(max_words), F.size("w") - F.col("pos")))
    words = F.transform(sizes, lambda n: F.array_join(F.slice("w", F.col("pos") + 1, n), " "))
    phrases = starts.select("memory_id", "pos", F.explode_outer(words).alias("alias")).join(longer, "alias")
    hits = single.unionByName(phrases)
    longest = hits.groupBy("memory_id", "pos").agg(F.max("n_words").alias("n_words"))
    hits = hits.join(longest, ["memory_id", "pos", "n_words"], "left_semi")
    return _with_marks(hits, memories, lex, punctuated)


def _with_marks(hits: DataFrame, memories: DataFrame, lex: DataFrame, punctuated: list[str] | None) -> DataFrame:
    """Alias hits without suppressed ones, plus paths, version numbers and punctuated aliases."""
    every = "|".join(p for patterns in COMPOUNDS.values() for p in patterns)
    compounds = memories.filter(F.lower("content").rlike(every)).select(
        "memory_id", F.explode_outer(_suppressed_aliases(F.lower("content"))).alias("alias")
    )
    found = hits.join(compounds, ["memory_id", "alias"], "left_anti").select("memory_id", "concept", "category")
    for pattern, concept, category in [
        (PATH_PATTERN, "path", "files/paths"),
        (VERSION_PATTERN, "versioning", "software"),
    ]:
        marked = memories.filter(F.col("content").rlike(pattern)).select("memory_id")
        found = found.unionByName(
            marked.withColumn("concept", tx.canonical(F.lit(concept))).withColumn("category", F.lit(category))
        )
    if punctuated:
        import re

        pattern = "|".join(re.escape(p.lower()) for p in sorted(punctuated, key=len, reverse=True))
        odd = memories.select(
            "memory_id", F.explode_outer(F.regexp_extract_all(F.lower("content"), F.lit(pattern), F.lit(0))).alias("alias")
        )
        found = found.unionByName(odd.join(lex, "alias").select("memory_id", "concept", "category"))
    return found.distinct()


def expand_query(queries: DataFrame, lexicon: DataFrame, max_words: int = 5) -> DataFrame:
    """(query_id, concept): lexicon concepts of every 1..5-gram of the query tokens."""
    lex = prepare_lexicon(lexicon)
    w = queries.select("query_id", tx.query_tokens(F.col("query")).alias("w")).filter(F.size("w") > 0)
    grams = F.flatten(
        F.transform(
            F.sequence(F.lit(1), F.size("w")),
            lambda i: F.transform(
                F.sequence(F.lit(1), F.least(F.lit(max_words), F.size("w") - i + 1)),
                lambda n: F.array_join(F.slice("w", i, n), " "),
            ),
        )
    )
    return w.select("query_id", F.explode(grams).alias("alias")).join(lex, "alias").select("query_id", "concept").distinct()


def concept_counts(bridge: DataFrame) -> DataFrame:
    return bridge.groupBy("concept").agg(F.count("*").alias("n_memories"), F.min("category").alias("category"))


def hot_concepts(activations: DataFrame, now: float, k: int = 10) -> DataFrame:
    heat = sc.activation(F.col("count"), F.col("last_activated"), now)
    return (
        activations.select("concept", "count", F.round(heat, 6).alias("activation"))
        .filter(F.col("activation") > 0)
        .orderBy(F.desc("activation"), "concept")
        .limit(k)
    )


def activations_from(accesses: DataFrame, bridge: DataFrame) -> DataFrame:
    """(concept, count, last_activated) from access events (memory_id, ts).

    Accesses are summed per memory before they meet the bridge.
    """
    per_memory = accesses.groupBy("memory_id").agg(F.count("*").alias("n"), F.max("ts").alias("last"))
    return (
        bridge.join(per_memory, "memory_id")
        .groupBy("concept")
        .agg(F.sum("n").alias("count"), F.max("last").alias("last_activated"))
    )


def browse(memories: DataFrame, bridge: DataFrame, concept: str, limit: int = 50, offset: int = 0) -> DataFrame:
    """Page of a concept's memories, newest id first; the page is cut before the liveness filter."""
    page = (
        bridge.filter(F.col("concept") == concept)
        .select("memory_id")
        .orderBy(F.desc("memory_id"))
        .offset(offset)
        .limit(limit)
    )
    return memories.join(page, "memory_id", "left_semi").filter(~F.coalesce(F.col("consolidated"), F.lit(False)))


def merge_near_duplicates(bridge: DataFrame) -> DataFrame:
    """(concept, keep): concept names equal after dropping punctuation map to one name.

    The most used, then longest, then first name in order is kept.
    """
    names = bridge.groupBy("concept").agg(F.count("*").alias("n"))
    canon = F.regexp_replace(F.lower("concept"), "[^a-z0-9]+", "")
    keyed = names.withColumn("canon", canon).filter(F.col("canon") != "")
    best = keyed.groupBy("canon").agg(
        F.max_by("concept", F.struct("n", F.length("concept").alias("len"), "concept")).alias("keep"),
        F.count("*").alias("names"),
    )
    return keyed.join(best.filter(F.col("names") > 1), "canon").select("concept", "keep")


def clean_bridge(bridge: DataFrame, memories: DataFrame) -> DataFrame:
    """Bridge without stale memories, with near-duplicate names merged."""
    alive = bridge.join(memories.select("memory_id"), "memory_id", "left_semi")
    renamed = merge_near_duplicates(alive)
    return (
        alive.join(renamed, "concept", "left")
        .groupBy("memory_id", F.coalesce("keep", "concept").alias("concept"))
        .agg(F.min("category").alias("category"))
    )


def top_concepts_per_category(bridge: DataFrame, k: int = 3) -> DataFrame:
    counts = concept_counts(bridge)
    return top_per_group(counts, ["category"], [F.desc("n_memories"), F.asc("concept")], k)
