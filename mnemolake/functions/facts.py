"""Statements in text: triples, polarity signatures, attribute values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import canonical

# ---------------------------------------------------------------------------
# The phrase patterns that define a triple.
# ---------------------------------------------------------------------------
NOUN = r"[A-Za-z0-9][A-Za-z0-9'&-]*(?:\s+[A-Za-z0-9'&-]+){0,10}"
SEGMENT = r"[^.!?;]+[.!?;]?"
NOT_WORDS = (
    "not|never|no longer|doesn't|doesn’t|didn't|didn’t|isn't|isn’t|aren't|aren’t|wasn't|wasn’t|weren't|weren’t"
    "|can't|can’t|won't|won’t"
)
AUX = rf"(?:(?:did|does|do|is|are|was|were|will|going to)\s+)?(?:(?:{NOT_WORDS})\s+)?"
TAIL = r"([^,.;!?]+)"
CHANGED = rf"(?i)({NOUN})\s+changed\s+from\s+([^,.;!?]+?)\s+to\s+{TAIL}"
POSSESSIVE = rf"(?i)({NOUN})'s\s+({NOUN})\s+(?:(?:is|was|are|were)\s+)?{TAIL}"
COPULA = rf"(?i)({NOUN})\s+(is|are|was|were|isn't|aren't|wasn't|weren't)\s+{TAIL}"
LIKES = rf"(?i)({NOUN})\s+{AUX}(like|likes|prefer|prefers|want|wants)\s+{TAIL}"
MOVED = rf"(?i)({NOUN})\s+{AUX}(moved|move)\s+to\s+{TAIL}"
WORKS = rf"(?i)({NOUN})\s+{AUX}(works|work)\s+at\s+{TAIL}"
NEGATION = rf"(?i)\b(?:{NOT_WORDS})\b"
HEDGE = r"(?i)\b(?:maybe|might|possibly|perhaps|probably|i think|i guess)\b"
TRAILING_AUX = (
    r"(?i)(?:^|\s+)(?:do|does|did|is|are|was|were|will|going|to|not|never|no|longer|can't|cant|won't|wont|doesn't|doesnt"
    r"|didn't|didnt|isn't|isnt|aren't|arent|wasn't|wasnt|weren't|werent)$"
)

# Words of the polarity signature.
CONTRACTIONS = {
    "don't": "do not", "doesn't": "does not", "didn't": "did not", "can't": "cannot", "won't": "will not",
    "isn't": "is not", "aren't": "are not", "wasn't": "was not", "weren't": "were not", "haven't": "have not",
    "hasn't": "has not", "hadn't": "had not", "shouldn't": "should not", "couldn't": "could not",
    "wouldn't": "would not", "mustn't": "must not",
}
NEGATION_TOKENS = ["not", "no", "never", "cannot"]
SIGNATURE_SKIP = (
    "am is are was were be been being do does did have has had can could should would will must shall i me my you "
    "he she we they user person someone the a an this that to of in on for with at by from it and or if then so "
    "your his her its our their"
).split()

# Sets of values of which one person has one.
EXCLUSIVE_SETS = [
    ["male", "female", "non-binary"],
    ["married", "single", "divorced", "widowed"],
    ["vegetarian", "vegan", "pescatarian", "omnivore"],
    ["cat", "dog", "bird", "fish"],
]

# Attribute patterns (up to three digits).
_NUM = r"(\d{1,3}(?:\.\d+)?)"
ATTRIBUTES = ["age", "height", "weight", "salary", "temperature", "score", "rating"]
UNITS = {
    "age": "year|years|yr|yrs|y",
    "weight": "kg|kgs|kilogram|kilograms|lb|lbs|pound|pounds|st|stone",
    "height": "cm|centimeter|centimeters|m|meter|meters|ft|feet|inch|inches",
}
# ---------------------------------------------------------------------------


def norm(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(text)), r"\s+", " ")


def _clean_tail(raw: Column) -> Column:
    t = F.regexp_replace(raw, "^[ \"'`]+|[ \"'`]+$", "")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"(?s)\b(?:and|or)\b.*$", ""), r"(?s)[.,;!?].*$", ""))


def _lead(subject: Column) -> Column:
    s = F.regexp_replace(F.trim(subject), r"(?i)^(?:i think|i guess)\s+", "")
    return F.trim(F.regexp_replace(s, r"(?i)^(?:maybe|might|possibly|perhaps|probably)\s+", ""))


def _drop_trailing_aux(subject: Column) -> Column:
    """Words of the subject without auxiliaries at its end, however many there are."""
    words = F.array_join(F.regexp_extract_all(subject, F.lit(r"[A-Za-z0-9']+"), F.lit(0)), " ")
    tail = TRAILING_AUX.replace(r"(?:^|\s+)(?:", r"(?:(?:^|\s+)(?:").removesuffix("$") + ")+$"
    return F.trim(F.regexp_replace(words, tail, ""))


def polarity(fragment: Column) -> Column:
    return F.when(fragment.rlike(NEGATION), "negative").otherwise("positive")


def tense(fragment: Column) -> Column:
    low = F.lower(fragment)
    return (
        F.when(low.rlike("will|going to"), "future")
        .when(low.rlike(r"was|were|^\s*used to|\b\w+ed\b"), "past")
        .otherwise("present")
    )


def hedged_confidence(fragment: Column) -> Column:
    return F.when(fragment.rlike(HEDGE), 0.5).otherwise(1.0)


# Cheap keyword tests that every match of a family must pass.
_GATES = {
    CHANGED: r"(?i)\schanged\s+from\s",
    POSSESSIVE: r"(?i)'s\s",
    COPULA: r"(?i)\s(?:is|are|was|were|isn't|aren't|wasn't|weren't)\s",
    LIKES: r"(?i)\s(?:like|likes|prefer|prefers|want|wants)\s",
    MOVED: r"(?i)\smoved?\s+to\s",
    WORKS: r"(?i)\sworks?\s+at\s",
}


def _family(segments: DataFrame, order: int, pattern: str) -> DataFrame:
    """One row per match of a family in a segment: whole match and its groups.

    Sentences are gated by a keyword, matched once, and the groups are read
    from the (short) matches.
    """
    # A word never gives back characters to the blank that must follow it, so
    # the possessive form matches the same and does not backtrack. The 's family
    # does need to give them back.
    java = pattern if pattern == POSSESSIVE else pattern.replace("[A-Za-z0-9'&-]*", "[A-Za-z0-9'&-]*+").replace(
        "[A-Za-z0-9'&-]+", "[A-Za-z0-9'&-]++"
    )
    gated = segments.filter(F.col("segment").rlike(_GATES[pattern]))
    found = gated.select(
        "memory_id",
        "seg",
        F.posexplode_outer(F.regexp_extract_all("segment", F.lit(java), F.lit(0))).alias("hit", "fragment"),
    ).filter(F.col("fragment").isNotNull())

    def group(i: int) -> Column:
        return F.regexp_extract("fragment", java, i)

    return found.select(
        "memory_id",
        "seg",
        F.lit(order).alias("family"),
        "hit",
        "fragment",
        group(1).alias("g1"),
        group(2).alias("g2"),
        group(3).alias("g3"),
    )


def extract_triples(memories: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """(memory_id, seq, subject, predicate, object, polarity, tense, confidence, fragment).

    Sentences are exploded first; each phrase family is a regex over sentences,
    evaluated JVM-side. ``seq`` orders the triples of one memory.
    """
    segments = memories.select(
        "memory_id", F.posexplode_outer(F.regexp_extract_all("content", F.lit(SEGMENT), F.lit(0))).alias("seg", "segment")
    ).withColumn("segment", F.trim("segment"))

    def canon(c: Column) -> Column:
        return canonical(c, aliases)

    frag = F.col("fragment")
    g1, g2, g3 = F.col("g1"), F.col("g2"), F.col("g3")
    meta = [polarity(frag).alias("polarity"), tense(frag).alias("tense"), hedged_confidence(frag).alias("confidence")]
    keep = ["memory_id", "seg", "family", "hit", "fragment"]

    changed = _family(segments, 0, CHANGED).withColumn("old", canon(g2)).withColumn("new", canon(g3))
    changed = changed.filter("old <> '' AND new <> ''")

    def change(part: int, predicate: str, col: str, sign: str) -> DataFrame:
        return changed.select(
            *keep,
            F.lit(part).alias("part"),
            canon(g1).alias("subject"),
            F.lit(predicate).alias("predicate"),
            F.col(col).alias("object"),
            F.lit(sign).alias("polarity"),
            F.lit("past").alias("tense"),
            F.lit(0.7).alias("confidence"),
        )

    def plain(order: int, pattern: str, subject: Column, predicate: Column, gate: Column | None = None) -> DataFrame:
        rows = _family(segments, order, pattern)
        if gate is not None:
            rows = rows.filter(gate)
        return rows.select(
            *keep,
            F.lit(0).alias("part"),
            canon(subject).alias("subject"),
            predicate.alias("predicate"),
            canon(_clean_tail(g3)).alias("object"),
            *meta,
        )

    verb = F.lower(g2)
    likes = F.when(verb.endswith("s"), verb).otherwise(F.concat(verb, F.lit("s")))
    owned = canon(F.regexp_replace(g2, r"(?i)\s+(?:is|are|was|were)$", ""))
    bare = _lead(_drop_trailing_aux(g1))
    parts = [
        change(0, "changed_from", "old", "negative"),
        change(1, "changed_to", "new", "positive"),
        plain(1, POSSESSIVE, _lead(g1), owned),
        plain(2, COPULA, _lead(g1), F.lit("is"), ~F.contains(g1, F.lit("'s"))),
        plain(3, LIKES, bare, likes),
        plain(4, MOVED, bare, F.lit("moved_to")),
        plain(5, WORKS, bare, F.lit("works_at")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = out.filter("subject <> '' AND predicate <> '' AND object <> ''")
    # seg, family, hit and part order one memory's triples without a window.
    seq = (
        F.col("seg").cast("long") * 1_000_000 + F.col("family") * 100_000 + F.col("hit") * 10 + F.col("part")
    ).alias("seq")
    return out.select(
        "memory_id", seq, "subject", "predicate", "object", "polarity", "tense", "confidence", "fragment"
    )


def claim(subject: Column, predicate: Column, obj: Column, sign: Column) -> Column:
    return F.trim(F.concat(subject, F.when(sign == "negative", " not ").otherwise(" "), predicate, F.lit(" "), obj))


def statement_text(text: Column) -> Column:
    """Lower case, contractions spelled out, punctuation out."""
    low = F.lower(F.trim(text))
    for short, long in CONTRACTIONS.items():
        low = F.replace(low, F.lit(short), F.lit(long))
    return F.trim(F.regexp_replace(F.regexp_replace(low, r"[^a-z0-9\- ]+", " "), r"\s+", " "))


def _predicate_stem(t: Column) -> Column:
    n = F.length(t)

    def cut(k: int) -> Column:
        return F.substring(t, F.lit(1), n - k)

    return (
        F.when(t.endswith("ing") & (n > 4), cut(3))
        .when(t.endswith("ies") & (n > 3), F.concat(cut(3), F.lit("y")))
        .when(t.endswith("ed") & (n > 3), cut(2))
        .when(t.endswith("s") & (n > 3), cut(1))
        .otherwise(t)
    )


def polarity_signature(text: Column) -> Column:
    """struct(signature: sorted distinct stems, negated)."""
    words = F.regexp_extract_all(statement_text(text), F.lit(r"[a-z0-9\-]+"), F.lit(0))
    negs = F.array(*[F.lit(w) for w in NEGATION_TOKENS])
    skip = F.array(*[F.lit(w) for w in [*SIGNATURE_SKIP, *NEGATION_TOKENS]])
    kept = F.filter(words, lambda w: ~F.array_contains(skip, w))
    return F.struct(
        F.sort_array(F.array_distinct(F.transform(kept, _predicate_stem))).alias("signature"),
        F.arrays_overlap(words, negs).alias("negated"),
    )


def exclusive_values(text: Column, values: list[str]) -> Column:
    """Sorted members of one exclusive set that the text mentions."""
    clean = statement_text(text)
    hits = [F.when(clean.rlike(rf"\b{v}\b"), v) for v in sorted(values)]
    return F.array_compact(F.array(*hits))


def numeric_facts(text: Column) -> Column:
    """map attribute -> value: the last match of the strongest rule wins.

    Rules from weak to strong: "25 years old", "attribute 25", "25 kg".
    """
    flat = F.regexp_replace(F.lower(text), r"[^a-z0-9\.\- ]", " ")

    def last(pattern: str, group: int) -> Column:
        found = F.regexp_extract_all(flat, F.lit(pattern), F.lit(group))
        return F.try_element_at(found, F.lit(-1)).cast("double")

    # The unit rule scans once over all units; the unit of each hit sorts it to its attribute.
    every = "|".join(UNITS.values())
    unit_pattern = rf"{_NUM}\s*({every})\b"
    pairs = F.zip_with(
        F.regexp_extract_all(flat, F.lit(unit_pattern), F.lit(1)),
        F.regexp_extract_all(flat, F.lit(unit_pattern), F.lit(2)),
        lambda v, u: F.struct(v.cast("double").alias("v"), u.alias("u")),
    )
    named_pattern = rf"\b({'|'.join(ATTRIBUTES)})\b[^a-z0-9]{{0,12}}{_NUM}\b"
    named = F.zip_with(
        F.regexp_extract_all(flat, F.lit(named_pattern), F.lit(1)),
        F.regexp_extract_all(flat, F.lit(named_pattern), F.lit(2)),
        lambda a, v: F.struct(v.cast("double").alias("v"), a.alias("u")),
    )

    def of(hits: Column, words: list[str]) -> Column:
        mine = F.filter(hits, lambda h: h["u"].isin(words))
        return F.try_element_at(mine, F.lit(-1))["v"]

    entries = []
    for attr in ATTRIBUTES:
        options = [of(named, [attr])]
        if attr in UNITS:
            options.insert(0, of(pairs, UNITS[attr].split("|")))
        if attr == "age":
            options.append(last(rf"{_NUM}\s*(?:years?|yrs?|yr)s?\s*old\b", 1))
        entries.append(F.struct(F.lit(attr).alias("key"), F.coalesce(*options).alias("value")))
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"].isNotNull()))


def numeric_conflict(a: Column, b: Column) -> Column:
    """Confidence that two different values of one attribute conflict."""
    d = F.abs(a - b)
    base = F.greatest(F.abs(a), F.abs(b), F.lit(1.0))
    return F.greatest(F.lit(0.4), F.least(F.lit(1.0), 0.5 + d / (base + d)))


def polarity_conflict(overlap: Column) -> Column:
    return 0.55 + 0.35 * overlap


def faded_conflict(confidence: Column, t_a: Column, t_b: Column) -> Column:
    """A conflict's weight after the time between the two statements; null below 0.1."""
    faded = confidence / (1 + F.abs(t_a - t_b) / 86400)
    return F.when(faded >= 0.1, faded)
