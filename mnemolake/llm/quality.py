"""Quality rules as a short-circuit cascade.

Each rule says from the text alone whether it rejects it. On a bounded sample every rule is timed and its rejections
are counted; rules then run in descending rejections per second, and a text that one rule rejects meets no later one.
The order changes the cost and the reported rule, never the verdict: a text stays if no rule rejects it.

Only built-in functions run here, each text within its own row; nothing is shuffled.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK_CHARS, aside, whole_text, words

WINDOW = 8
SYMBOLS = "#*$%&|<>"
#: Rows of the sample that orders the rules: the first rows of the table with at most SAMPLE_CHARS characters.
SAMPLE_ROWS = 256
SAMPLE_CHARS = 100_000
#: Runs of each rule over the sample; the fastest counts.
TIMED_RUNS = 2


def count_chars(text: Column, chars: str) -> Column:
    return F.char_length(text) - F.char_length(F.translate(text, chars, ""))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def repeated_words(w: Column) -> Column:
    """Words within windows of WINDOW words that are found at least twice, the first one included.

    Windows are compared by 64-bit hash. Only texts with two equal windows go on to mark the words.
    """

    def hashed(h: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(h) - WINDOW)
        return F.transform(at, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))

    def marked(win: Column) -> Column:
        by_hash = F.array_sort(F.transform(win, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def twice(s: Column) -> Column:
            found = F.filter(
                s,
                lambda x, i: (F.get(s, i - 1)["h"] == x["h"]).eqNullSafe(True)
                | (F.get(s, i + 1)["h"] == x["h"]).eqNullSafe(True),
            )
            return F.array_sort(F.transform(found, lambda x: x["i"]))

        def covered(at: Column) -> Column:
            gaps = F.transform(at, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(at, i + 1) - x, F.lit(WINDOW))))
            return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

        return _let(_let(by_hash, twice), covered)

    def any_twice(win: Column) -> Column:
        return F.when(F.size(F.array_distinct(win)) == F.size(win), F.lit(0)).otherwise(marked(win))

    long_enough = F.size(w) > WINDOW
    windows = _let(F.transform(w, lambda x: F.xxhash64(x)), hashed)
    return F.when(long_enough, _let(windows, any_twice)).otherwise(F.lit(0)).cast("long")


def lines_with_words(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANK_CHARS)) != "")


def features(text: Column, w: Column) -> dict[str, Column]:
    """The base counts of a text and its words."""
    lines = lines_with_words(text)
    return {
        "n_words": F.size(w).cast("long"),
        "word_chars": F.char_length(F.translate(text, BLANK_CHARS, "")).cast("long"),
        "n_symbols": count_chars(text, SYMBOLS).cast("long"),
        "n_dup_lines": _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeated_words(w),
    }


def stutters(w: Column) -> Column:
    """Words equal to the word before them."""
    return F.size(F.filter(w, lambda x, i: (x == F.get(w, i - 1)).eqNullSafe(True)))


@dataclass(frozen=True)
class Facts:
    """What a rule may look at: the text, its words, and counts that are columns already."""

    text: Column
    words: Column
    known: dict[str, Column] = field(default_factory=dict)

    def __getitem__(self, name: str) -> Column:
        return self.known[name] if name in self.known else features(self.text, self.words)[name]


@dataclass(frozen=True)
class Rule:
    """``rejects(facts)`` is true where the text is to go."""

    name: str
    rejects: Callable[[Facts], Column]


def production_rules() -> list[Rule]:
    """Short texts, repeated windows, words or lines, symbols, tables, shouting, unlikely word lengths."""
    return [
        Rule("few_words", lambda f: f["n_words"] < 20),
        Rule("repeated_words", lambda f: 100 * f["n_repeat_words"] > 30 * f["n_words"]),
        Rule("symbols", lambda f: 10 * f["n_symbols"] > f["n_words"]),
        Rule("exclamations", lambda f: 5 * count_chars(f.text, "!") > f["n_words"]),
        Rule("capitals", lambda f: 10 * F.regexp_count(f.text, F.lit(r"\p{Lu}")) > 3 * f["word_chars"]),
        Rule("repeated_lines", lambda f: 2 * f["n_dup_lines"] > F.size(lines_with_words(f.text))),
        Rule("stutter", lambda f: _let(f.words, lambda w: 10 * stutters(w) > 3 * F.size(w))),
        Rule("word_length", lambda f: ~f["word_chars"].between(2 * f["n_words"], 15 * f["n_words"])),
    ]


@dataclass(frozen=True)
class Estimate:
    name: str
    seconds: float
    rejected: int


def estimate(docs: DataFrame, rules: list[Rule], text: str = "text") -> list[Estimate]:
    """Cost and rejections of each rule on the first SAMPLE_ROWS rows that are not very long.

    The sample is a bounded prefix of the table, so no scan of the whole is made for it; it only orders the rules.
    """
    spark = docs.sparkSession
    rows = docs.select(whole_text(text).alias("t")).filter(F.char_length("t") <= SAMPLE_CHARS).head(SAMPLE_ROWS)
    sample = spark.createDataFrame([(r.t,) for r in rows], "t string").coalesce(1).withColumn("w", words(F.col("t"))).cache()
    sample.count()
    facts = Facts(F.col("t"), F.col("w"))

    def run(condition: Column) -> tuple[float, int]:
        took, found = [], 0
        for _ in range(TIMED_RUNS):
            start = time.perf_counter()
            found = sample.filter(condition).count()
            took.append(time.perf_counter() - start)
        return min(took), found

    idle, _ = run(F.col("t").isNotNull())
    out = []
    for rule in rules:
        seconds, rejected = run(rule.rejects(facts))
        out.append(Estimate(rule.name, max(seconds - idle, 1e-4), rejected))
    sample.unpersist()
    return out


def ordered(rules: list[Rule], estimates: list[Estimate]) -> list[Rule]:
    """Rules by rejections per second, the most first; with none, the cheapest first."""
    by_name = {e.name: e for e in estimates}
    return sorted(rules, key=lambda r: (-by_name[r.name].rejected / by_name[r.name].seconds, by_name[r.name].seconds, r.name))


def failed_rule(facts: Facts, rules: list[Rule]) -> Column:
    """Name of the first rule that rejects the text, null where none does; later rules are not evaluated."""
    out = F.when(rules[0].rejects(facts), rules[0].name)
    for rule in rules[1:]:
        out = out.when(rule.rejects(facts), rule.name)
    return out


def cascade(docs: DataFrame, rules: list[Rule] | None = None, text: str = "text", known: list[str] | None = None) -> DataFrame:
    """``docs`` with failed_rule and kept; columns of these names are replaced.

    ``known`` names base counts that ``docs`` holds already, as it may hold the words in _words. A null or blank text has no words and goes. Repeated rows
    are judged each. An empty table stays empty.
    """
    rules = rules or production_rules()
    ranked = ordered(rules, estimate(docs, rules, text))
    bare = docs.drop("failed_rule", "kept")
    counts = {k: F.col(k) for k in known or []}
    split = F.col("_words") if "_words" in bare.columns else words(whole_text(text))
    # The words are bound within the expression: a filter on the verdict moves below this projection, and a column of
    # words would then be split again at each of its places, for some rules once per word.
    first = _let(split, lambda w: failed_rule(Facts(whole_text(text), w, counts), ranked))
    judged = bare.withColumn("failed_rule", first).drop("_words")
    return judged.withColumn("kept", F.col("failed_rule").isNull())


def keep_good(docs: DataFrame, rules: list[Rule] | None = None, text: str = "text") -> DataFrame:
    """The rows that no rule rejects, with their own columns."""
    rows, own = aside(docs, ["failed_rule", "kept"])
    return cascade(rows, rules, text).filter("kept").select(*own)


def quality_rules(docs: DataFrame) -> DataFrame:
    """op4: base counts and the cascade's verdict on every document; the rules read the counts that are there."""
    split = docs.select("doc_id", whole_text().alias("text")).withColumn("_words", words(F.col("text")))
    counts = features(F.col("text"), F.col("_words"))
    rows = cascade(split.select("doc_id", "text", "_words", *[c.alias(k) for k, c in counts.items()]), known=list(counts))
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return rows.select("doc_id", *counts, base.alias("base_failed"), (F.col("kept") & ~base).alias("kept"))


QUALITY_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
one AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i, len(w) AS n FROM d),
win AS (
  SELECT doc_id, i, n, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS s
  FROM one),
rep AS (
  SELECT doc_id, i FROM (
    SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM win WHERE i <= n - 7) WHERE c > 1),
cov AS (
  SELECT doc_id, sum(step) AS n_repeat_words FROM (
    SELECT doc_id, least(8, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 8)) AS step FROM rep) GROUP BY doc_id),
f AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         length(regexp_replace(t, '[^!]', '', 'g')) AS bangs, length(regexp_replace(t, '\P{Lu}', '', 'g')) AS caps,
         len(l) AS n_lines, len(list_filter(w, lambda x, i: i > 1 AND x = w[i - 1])) AS stutters
  FROM d LEFT JOIN cov USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 10 * n_symbols > n_words OR 5 * bangs > n_words
            OR 10 * caps > 3 * word_chars OR 10 * stutters > 3 * n_words OR 2 * n_dup_lines > n_lines
            OR word_chars < 2 * n_words OR word_chars > 15 * n_words) AS kept
FROM f
"""
