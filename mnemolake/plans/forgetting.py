"""Spoken forget commands: a command becomes one row predicate."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.timeparse import UTC
from ..schema import DAY

VERBS = ("forget", "delete", "remove", "don't remember")
KINDS = ("preference", "fact", "event", "skill", "observation")
EVERYTHING = {"everything", "anything", "things", "memories", "all"}
#: Words between the selector and an age or date.
AGE_WORDS = ("older than", "from before", "from prior to")
ABOUT = ("about", "regarding", "related to")
#: Openings that announce a change instead of a removal.
CHANGES = ("that changed", "that's different now", "update that", "actually", "correction", "fix", "change")
UNIT_DAYS = {"day": 1, "week": 7, "month": 30, "year": 365}
_DATE_FORMS = ("%Y-%m-%d", "%m/%d/%Y", "%B %Y")


def _after(text: str, openings) -> str | None:
    """What follows the first of the openings that starts the text as whole words."""
    for o in openings:
        if text == o or text.startswith(o) and not text[len(o)].isalnum():
            return text[len(o) :].strip()
    return None


def _age_days(text: str) -> int | None:
    """Days of "30 days" or "2 weeks"; what follows is ignored."""
    number, _, unit = text.replace("-", " ").partition(" ")
    unit = unit.split(" ")[0].rstrip("s,.")
    return int(number) * UNIT_DAYS[unit] if number.isdigit() and unit in UNIT_DAYS else None


def cutoff(text: str, now: float) -> float | None:
    """Epoch seconds named by an age or a date; None where the text names neither."""
    words = text.strip()
    days = _age_days(words.lower())
    if days is not None:
        return now - days * DAY
    tokens = words.replace(",", " ").split()
    for size in (1, 2):
        for k in range(len(tokens) - size + 1):
            for form in _DATE_FORMS:
                try:
                    return datetime.strptime(" ".join(tokens[k : k + size]), form).replace(tzinfo=UTC).timestamp()
                except ValueError:
                    continue
    return None


def parse_command(command: str) -> tuple[str, dict[str, str]]:
    """(intent, arguments): time, type, topic, update or fact.

    A command is a verb, a selector and an argument. The selector is everything, a kind of memory, or nothing; the
    argument is an age, a topic, or the rest of the sentence.
    """
    c = command.strip().lower()
    if _after(c, CHANGES) is not None or (c.startswith("not ") and any(x in c for x in (" anymore, ", " any more, "))):
        return "update", {}
    rest = _after(c, VERBS)
    if not rest:
        return "fact", {"topic": c if rest is None else ""}
    first, _, tail = rest.partition(" ")
    kind = tail.split(" ")[0].removesuffix("s")
    if first in ("all", "my") and kind in KINDS:
        topic = _after(tail.partition(" ")[2], ("about",))
        if topic is not None or " " not in tail:
            return "type", {"kind": kind, **({"topic": topic} if topic else {})}
    if first in EVERYTHING:
        when = _after(tail, AGE_WORDS)
        if when:
            return "time", {"when": when}
        ago = _after(tail, ("from more than", "from over", "from"))
        if ago and ago.endswith(" ago"):
            return "time", {"when": ago.removesuffix(" ago")}
        topic = _after(tail, ABOUT)
        if topic:
            return "topic", {"topic": topic}
    return "fact", {"topic": rest}


def command_filter(command: str, now: float) -> Column:
    """Rows the command would remove; updates remove nothing."""
    intent, args = parse_command(command)
    if intent == "time":
        limit = cutoff(args["when"], now)
        return F.col("created_at") < limit if limit is not None else F.lit(False)
    if intent == "update":
        return F.lit(False)
    cond = F.lit(True)
    if "kind" in args:
        cond = cond & (F.col("memory_type") == args["kind"])
    if "topic" in args:
        cond = cond & F.contains(F.lower("content"), F.lit(args["topic"]))
    return cond
