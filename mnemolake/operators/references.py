"""What pronouns in a sequence of texts refer to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

# How a name is written, the words that are resolved, and the words that tell persons from things.
NAME = r"\b(?:[A-Z][A-Za-z0-9']*(?:\s+[A-Z][A-Za-z0-9']*){0,4})\b"
PERSON_PRONOUNS = ["he", "she", "they"]
THING_PRONOUN = "it"
NEVER_NAMES = ["he", "she", "they", "it", "i", "we", "you"]
PERSON_WORDS = ["he", "she", "they", "i", "me", "you", "we", "us", "her", "him", "his", "hers"]
THING_WORDS = (
    "city country project software system memory database tool company platform model service app device machine server "
    "node agent product team"
).split()
USER_WORDS = ["the user", "the customer"]

#: Positions of one group that one window covers; the slices of a longer group meet in their last names only.
SLICE = 1024


def looks_like_person(raw: Column, label: Column, things: list[str] | None = None) -> Column:
    """A name written like a person's: no known place, no word of a thing (``things`` adds to these)."""
    low = F.lower(label)
    words = F.split(low, " ")

    def any_of(known: list[str]) -> Column:
        return F.arrays_overlap(words, F.array(*[F.lit(w) for w in known]))

    place = (label == low) & F.contains(label, F.lit(" "))
    named = raw.rlike("^[A-Z][a-z]") & ~words[0].isin("the", "a", "an") & (F.length(low) > 1)
    return F.when(place | any_of([*THING_WORDS, *(things or [])]), False).when(low.isin(PERSON_WORDS), True).when(any_of(PERSON_WORDS), False).otherwise(named)


def last_names(text: Column, aliases: dict[str, str] | None = None, things: list[str] | None = None) -> Column:
    """struct(person, thing): the last name of either kind in a text, null where it has none."""
    found = F.regexp_extract_all(tx.ascii_words(text), F.lit(NAME), F.lit(0))
    found = F.filter(found, lambda n: ~F.lower(n).isin(NEVER_NAMES))
    labelled = F.transform(found, lambda n: F.struct(n.alias("raw"), tx.canonical(n, aliases, keep_names=True).alias("label")))
    labelled = F.filter(labelled, lambda n: n["label"] != "")
    marked = F.transform(labelled, lambda n: F.struct(n["label"].alias("label"), looks_like_person(n["raw"], n["label"], things).alias("person")))

    def last(m: Column, person: bool) -> Column:
        return F.try_element_at(F.filter(m, lambda n: n["person"] == person), F.lit(-1))["label"]

    return tx.let(marked, lambda m: F.struct(last(m, True).alias("person"), last(m, False).alias("thing")))


def _carried(rows: DataFrame, group: str, position: str, cols: list[str]) -> DataFrame:
    """Each column's newest value by the row's position, the row's own included.

    Running maxima within slices of positions, and over the slices' maxima: a group that holds a third of all rows is
    spread over its slices.
    """
    sliced = rows.withColumn("_slice", F.floor(F.col(position) / SLICE))
    for c in cols:
        sliced = sliced.withColumn(f"_{c}", F.when(F.col(c).isNotNull(), F.struct(F.col(position).alias("at"), F.col(c).alias("v"))))
    inside = Window.partitionBy(group, "_slice").orderBy(position).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy(group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    tops = sliced.groupBy(group, "_slice").agg(*[F.max(f"_{c}").alias(f"_top_{c}") for c in cols])
    before = tops.select(group, "_slice", *[F.max(f"_top_{c}").over(earlier).alias(f"_before_{c}") for c in cols])
    for c in cols:
        sliced = sliced.withColumn(f"_here_{c}", F.max(f"_{c}").over(inside))
    newest = [F.greatest(f"_here_{c}", f"_before_{c}")["v"].alias(c) for c in cols]
    return sliced.drop(*cols).join(before, [group, "_slice"]).select(*[x for x in rows.columns if x not in cols], *newest)


def referents(
    texts: DataFrame, group: str, position: str, text: str = "text", aliases: dict[str, str] | None = None,
    user_name: str | None = None, things: list[str] | None = None,
) -> DataFrame:
    """(group, position, pronoun, referent): what each pronoun of a text refers to.

    he, she and they take the last person named in the group up to and including the text, it the last other name.
    "the user" and "the customer" take ``user_name`` where it is given. Pronouns without a name before them give no row. A
    null text has no names and no pronouns; rows without a group or a position are left out; rows that
    repeat a position share the greatest of their names, and each gives its own rows. ``things`` are more words, in small
    letters, that make a name no person's.
    """
    rows = texts.filter(F.col(group).isNotNull() & F.col(position).isNotNull())
    low = F.lower(tx.ascii_words(F.col(text)))
    held = [F.when(low.rlike(rf"\b{p}\b"), p) for p in [*PERSON_PRONOUNS, THING_PRONOUN]]
    if user_name:
        held += [F.when(F.contains(low, F.lit(p)), p) for p in USER_WORDS]
    names = last_names(F.col(text), aliases, things)
    # Texts end here: what is shuffled is two names and a few pronouns a row.
    read = rows.select(F.col(group), F.col(position), F.array_compact(F.array(*held)).alias("_pronouns"), names.alias("_names"))
    read = read.select(group, position, "_pronouns", F.col("_names.person").alias("person"), F.col("_names.thing").alias("thing"))
    spoken = _carried(read, group, position, ["person", "thing"]).select(group, position, "person", "thing", F.explode("_pronouns").alias("pronoun"))
    of = F.when(F.col("pronoun") == THING_PRONOUN, F.col("thing")).when(F.col("pronoun").isin(PERSON_PRONOUNS), F.col("person"))
    out = spoken.withColumn("referent", of.otherwise(F.lit(user_name)) if user_name else of)
    return out.filter("referent IS NOT NULL").select(group, position, "pronoun", "referent")


def resolved(found: DataFrame, group: str, position: str) -> DataFrame:
    """(group, pronoun, referent) at the end of each group, from the rows of ``referents``."""
    return found.groupBy(group, "pronoun").agg(F.max_by("referent", F.struct(position, "referent")).alias("referent"))
