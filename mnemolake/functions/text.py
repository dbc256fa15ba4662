"""Tokenising, stop lists, lemmas and canonical entity names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The stop list applied to query text.
QUERY_STOPWORDS = (
    "the a an is are was were be been have has had do does did will would could should may might can "
    "shall to of in for on with at by from as it this that these those i me my we our you your he she "
    "they them and or but not no if then so what how much about tell which where when who running using "
    "going looking am get got set just also being like need want know think use used any some there here "
    "very really quite more most other each every all both own same than too"
).split()

# The shorter stop list of the graph path.
GRAPH_STOPWORDS = (
    "the a an is are was were be been have has had do does did will would could should may might can "
    "shall to of in for on with at by from as it that this these those we our you your i me my he she "
    "they them and or but not no if then so what how which where when who"
).split()


# Place aliases known without registration.
DEFAULT_ALIASES = {
    "ny": "new york", "nyc": "new york", "sf": "san francisco", "la": "los angeles",
    "usa": "united states", "u.s.": "united states", "us": "united states",
    "uk": "united kingdom", "u.k.": "united kingdom", "u.s.a.": "united states",
    "new york": "new york", "new york city": "new york city",
}


def alias_map(extra: dict[str, str] | None = None) -> Column:
    """Literal map column of the default and the user-registered aliases."""
    merged = {**DEFAULT_ALIASES, **{k.strip().lower(): v for k, v in (extra or {}).items()}}
    return F.create_map(*[F.lit(x) for pair in merged.items() for x in pair])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` applied to ``value`` with the value bound once.

    Column expressions are trees: using a long expression five times copies it
    five times into the plan. Binding it to a lambda variable keeps plans small.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def tokens(text: Column) -> Column:
    """Lower-case ASCII alphanumeric runs, repeats kept."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def drop_words(words: Column, stop: list[str]) -> Column:
    """Remove stop words but keep repeated tokens."""
    stop_array = F.array(*[F.lit(w) for w in stop])
    return F.filter(words, lambda w: ~F.array_contains(stop_array, w))


def query_tokens(text: Column) -> Column:
    return drop_words(tokens(text), QUERY_STOPWORDS)


def graph_tokens(text: Column) -> Column:
    return drop_words(tokens(text), GRAPH_STOPWORDS)


def token_set(text: Column) -> Column:
    """Sorted distinct tokens: equal sets give equal arrays."""
    return F.sort_array(F.array_distinct(tokens(text)))


def ascii_words(text: Column) -> Column:
    """Replace each non-ASCII letter or digit by ``_``.

    ``_`` is a word character outside ``[a-z]``, so ASCII ``\\w`` and ``\\b``
    then behave as Unicode-aware ones would on the original text.
    """
    return F.regexp_replace(text, r"[\p{L}\p{N}&&[^\x00-\x7F]]", "_")


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def normalize_alias(text: Column) -> Column:
    return squeeze(F.lower(text))


def _strip_marks(token: Column) -> Column:
    return F.regexp_replace(token, r"^[^A-Za-z0-9]+|[^A-Za-z0-9']+$", "")


def lemma(token: Column) -> Column:
    """Conservative base form: irregulars, doubled -ing, -ed, -ies, -es, -s."""
    return let(_strip_marks(F.lower(token)), _lemma_of)


def _lemma_of(w: Column) -> Column:
    n = F.length(w)

    def cut(k: int) -> Column:
        return F.substring(w, F.lit(1), n - k)

    def undouble(k: int, fallback: Column) -> Column:
        """Drop ``k`` letters, and one more where the stem ends in a double letter."""
        m = n - k
        twin = (m > 1) & (F.substring(w, m, F.lit(1)) == F.substring(w, m - 1, F.lit(1)))
        return F.when(twin, cut(k + 1)).otherwise(fallback)

    return (
        # Irregular forms.
        F.when(w == "children", "child")
        .when(w == "liked", "like")
        .when(w.isin("goes", "went"), "go")
        .when(w.endswith("ing") & (n > 4), undouble(3, w))
        .when(w.endswith("ed") & (n > 3), undouble(2, cut(2)))
        .when(w.endswith("ies") & (n > 3), F.concat(cut(3), F.lit("y")))
        .when(w.endswith("es") & (n > 2), cut(2))
        .when(w.endswith("s") & (n > 3) & ~w.endswith("ss"), cut(1))
        .otherwise(w)
    )


def canonical(text: Column, extra_aliases: dict[str, str] | None = None, keep_names: bool = False) -> Column:
    """Canonical entity label: no article, alias lookup, no 's, lemma per token.

    With ``keep_names``, tokens written like a name (a capital, then a small letter) stay as they are.
    """

    def token(w: Column) -> Column:
        return F.when(w.rlike("^[A-Z][a-z]"), w).otherwise(_lemma_of(F.lower(w))) if keep_names else _lemma_of(w)

    bare = F.regexp_replace(squeeze(text), "^[\"'`]+|[\"'`]+$", "")
    bare = squeeze(F.regexp_replace(bare, r"(?i)^(?:a|an|the)\s+", ""))

    def label(b: Column) -> Column:
        unowned = F.regexp_replace(b, "'s$", "")
        words = F.transform(F.split(F.trim(unowned), " "), lambda w: _strip_marks(w if keep_names else F.lower(w)))
        words = F.transform(F.filter(words, lambda w: w != ""), token)
        plain = squeeze(F.array_join(words, " "))
        known = F.try_element_at(alias_map(extra_aliases), F.lower(b))
        return F.when(F.length(known) > 0, known).otherwise(plain)

    return let(bare, label)


def slugify(text: Column) -> Column:
    """Lower-case file-name form with single dashes."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def project_tags(text: Column) -> Column:
    """Sorted distinct ``project:x`` tags from ``#x`` and ``project x``."""
    raw = F.regexp_extract_all(text, F.lit(r"(?i)(?:#|project[:\s-]{0,4})([A-Za-z][A-Za-z0-9_-]{1,})"), F.lit(1))

    def clean(tag: Column) -> Column:
        t = F.regexp_replace(F.lower(F.trim(tag)), "[^a-z0-9-]", "")
        nested = t.startswith("project") & (F.length(t) > 7)
        return F.when(nested, F.regexp_replace(t, "^project[-_]*", "")).otherwise(t)

    named = F.filter(F.transform(raw, clean), lambda t: t != "")
    return F.array_sort(F.array_distinct(F.transform(named, lambda t: F.concat(F.lit("project:"), t))))


def occurrences(text: Column, needle: str) -> Column:
    """Non-overlapping, case-insensitive occurrences of a substring."""
    low = F.lower(text)
    stripped = F.replace(low, F.lit(needle.lower()), F.lit(""))
    return ((F.length(low) - F.length(stripped)) / F.lit(max(len(needle), 1))).cast("long")
