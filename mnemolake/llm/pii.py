"""PII surrogates: detected entities are replaced by keyed values of their own type, script, gender and format.

A surrogate is a function of the key, the entity's type and its canonical form (digits of a number, lower case of the
rest), so one entity gets one surrogate in every text and spelling. Digits become digits, letters letters of the same
case and script; separators, country codes, Luhn validity, private address ranges, titles and the number of names
stay. The collision check takes all distinct entities of the table: where a surrogate equals a real entity or the
surrogate of another one, it is drawn again until all are distinct. Those few second draws are exceptions that the
replacing expression looks up; all other surrogates are computed within the row.

Only built-in functions run here. Texts are not shuffled unless there are more than EXCEPTIONS second draws.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import discard, save
from .common import whole_text

#: Words that end a street's name.
STREETS = "street|st|avenue|ave|road|rd|lane|ln|drive|dr|boulevard|blvd|court|ct|place|pl|way|circle|cir"

#: Second draws that are looked up in a literal map; more are joined by text.
EXCEPTIONS = 10_000
#: Draws per entity before the job gives up.
ROUNDS = 64

_START, _END = r"(?<![\p{L}\d])", r"(?![\p{L}\d])"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_TITLES = {
    "female": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа", "Κυρία"],
    "male": ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин", "Κύριος"],
    "any": ["Dr", "Prof"],
}
_TITLE = "(?i:" + "|".join(t for group in _TITLES.values() for t in group) + ")"

_NAME = r"\p{Lu}[\p{L}'’-]{1,40}"
_HEX = "[0-9a-fA-F]{1,4}"
_ROADS = "rue|chemin|allée|quai|impasse|calle|avenida|plaza|paseo|bis|ter|de|du|des|del|la|le|les|las|los|el"

#: Type -> pattern, the first that matches at a place wins.
PATTERNS = {
    "email": r"(?<![\p{L}\d._%+-])[\p{L}\d._%+-]{1,64}@(?:[\p{L}\d-]{1,63}\.){1,8}\p{L}{2,24}" + _END,
    "secret": _START
    + r"(?:[0-9a-fA-F]{32,128}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,255}|sk-[A-Za-z0-9_-]{20,200}|xox[baprs]-[A-Za-z0-9-]{10,200})"
    + _END,
    "phone": r"(?<![\p{L}\d+])(?:\+\d{1,3}[\s.-]?|\d{1,3}[\s.-])?(?:\(\d{3}\)|\d{3})[\s.-]?\d{3}[\s.-]?\d{4}" + _END
    + r"|(?<![\p{L}\d+])\+\d{1,3}(?:[ .-]?\d{2,4}){3,5}" + _END
    + r"|(?<![\p{L}\d+.-])\d{3}-\d{4}(?![\p{L}\d-])",
    "ip6": r"(?<![\p{L}\d:.])" + rf"(?:(?:{_HEX}:){{7}}{_HEX}|{_HEX}(?::{_HEX}){{0,5}}::(?:{_HEX}(?::{_HEX}){{0,5}})?|::{_HEX}(?::{_HEX}){{0,6}})"
    + r"(?![\p{L}\d:]|\.\d)",
    "ip": r"(?<![\p{L}\d.])" + rf"(?:{_OCTET}\.){{3}}{_OCTET}" + r"(?![\p{L}\d]|\.\d)",
    "ssn": _START + r"(?:\d{3}-\d{2}-\d{4}|(?!000|666|9\d{2})\d{3}[- ]?\d{2}[- ]?\d{4})" + _END,
    "iban": _START + r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?" + _END,
    "card": _START + r"\d(?:[ -]?\d){12,18}" + _END,
    "address": _START + r"(?:\d{1,6}[A-Za-z]?\s+(?:[A-Za-z0-9.'-]+|(?:\p{Lu}[\p{L}\d.'’-]*\s+){1,2}\p{Lu}[\p{L}\d.'’-]*)\s+(?i:" + STREETS + ")"
    + r"|\p{Lu}[\p{L}-]{2,40}(?:straße|strasse|weg|platz|allee|gasse) \d{1,4}[a-z]?"
    + r"|\d{1,4},? (?:bis |ter )?(?i:rue|avenue|boulevard|place|chemin|allée|quai|impasse) (?:(?:de |du |des |la |le |les )*(?:l['’]|d['’])?)\p{Lu}[\p{L}'’-]*(?: \p{Lu}[\p{L}'’-]*)?"
    + r"|(?i:calle|avenida|plaza|paseo) (?:de |del |la |las |los |el )*\p{Lu}[\p{L}-]*(?: \p{Lu}[\p{L}-]*)?,? (?:n\.?º ?)?\d{1,4})" + _END,
    "person": _START + _TITLE + r"\.? " + _NAME + "(?: " + _NAME + ")?",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Texts without any of these hold no entity.
HINT = r"[@\d]|sk-|xox[baprs]-|gh[pousr]_|AKIA|[a-fA-F]{32}|::|(?:[a-fA-F]{1,4}:){7}|" + _START + _TITLE + r"\.? \p{Lu}"

_LOWER, _UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_CYRILLIC, _GREEK = "абвгдезиклмнопрстуфхчшэюя", "αβγδεζηθικλμνξοπρστυφχψω"
_GIVEN = {
    "female": ["Alma", "Berta", "Carla", "Dora", "Edith", "Flora", "Greta", "Hilda", "Irma", "Julia", "Klara", "Laura", "Marta", "Nora", "Olga", "Paula"],
    "male": ["Arno", "Bruno", "Carlo", "Diego", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karl", "Lukas", "Marco", "Nils", "Oskar", "Pablo"],
}


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def kind_of(entity: Column) -> Column:
    """Type of a match."""
    out = None
    for name, pattern in PATTERNS.items():
        whole = entity.rlike(f"^(?:{pattern})$")
        out = F.when(whole, name) if out is None else out.when(whole, name)
    return out.when(entity.rlike(f"^{_NAME}(?: {_NAME})*$"), "person").otherwise("secret")


_NUMBERS = ["phone", "ssn", "card", "ip"]


def canonical(kind: Column, entity: Column) -> Column:
    """What spellings of one entity share: digits, dotted octets, eight groups, or lower case, in an IBAN without blanks."""
    digits = F.regexp_replace(entity, r"[^\d]", "")
    sides = F.split(F.lower(entity), "::")
    groups = lambda side: F.filter(F.split(side, ":"), lambda g: g != "")
    left = groups(sides[0])
    right = F.when(F.size(sides) > 1, groups(F.element_at(sides, -1))).otherwise(F.array().cast("array<string>"))
    full = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(8 - F.size(left) - F.size(right), F.lit(0))), right)
    ip6 = F.array_join(F.transform(full, lambda g: F.lpad(g, 4, "0")), ":")
    return (
        F.when(kind.isin("phone", "ssn", "card"), digits)
        .when(kind == "iban", F.lower(F.regexp_replace(entity, " ", "")))
        .when(kind == "ip6", ip6)
        .when(kind == "address", F.lower(F.regexp_replace(entity, r"\s+", " ")))
        .otherwise(F.lower(entity))
    )


@dataclass(frozen=True)
class Surrogates:
    """Draws under one key. ``draw`` maps canonical forms; ``dressed`` puts a drawn form into an entity's spelling."""

    key: str

    def _seed(self, kind: Column, form: Column, attempt: Column) -> Column:
        return F.sha2(F.concat_ws("|", F.lit(self.key), kind, form, attempt.cast("string")), 256)

    def draw(self, kind: Column, form: Column, attempt: Column) -> Column:
        """Canonical form of the surrogate at this attempt."""

        def of(seed: Column) -> Column:
            def number(i: Column, n: int) -> Column:
                return F.pmod(F.xxhash64(seed, i), F.lit(n)).cast("int")

            def pick(chars: str, i: Column) -> Column:
                return F.substring(F.lit(chars), number(i, len(chars)) + 1, F.lit(1))

            def char(c: Column, i: Column, hexes: bool = False) -> Column:
                return (
                    F.when(c.rlike(r"\d"), pick("0123456789", i))
                    .when(F.lit(hexes) & c.rlike("[a-f]"), pick("abcdef", i))
                    .when(c.rlike(r"\p{IsCyrillic}"), pick(_CYRILLIC, i))
                    .when(c.rlike(r"\p{IsGreek}"), pick(_GREEK, i))
                    .when(c.rlike(r"\p{L}"), pick(_LOWER, i))
                    .otherwise(c)
                )

            def spelt(value: Column, hexes: bool = False) -> Column:
                return F.array_join(F.transform(F.split(value, ""), lambda c, i: char(c, i, hexes)), "")

            # A phone keeps the digits before its last ten, the country code; a card keeps Luhn validity.
            body = F.greatest(F.char_length(form) - 10, F.lit(0))
            phone = F.concat(F.substring(form, F.lit(1), body), spelt(F.substring(form, body + 1, F.lit(10))))
            head = spelt(F.substring(form, F.lit(1), F.char_length(form) - 1))
            card = F.when(_luhn(form), F.concat(head, _check_digit(head))).otherwise(spelt(form))
            fixed = F.regexp_extract(form, r"^(10\.|127\.|192\.168\.|172\.(?:1[6-9]|2\d|3[01])\.|)", 1)
            n_fixed = F.char_length(fixed) - F.char_length(F.replace(fixed, F.lit("."), F.lit("")))
            octets = F.transform(F.sequence(n_fixed, F.lit(3)), lambda i: number(i, 254) + 1)
            ip = F.concat(fixed, F.array_join(F.transform(octets, lambda x: x.cast("string")), "."))
            # Later attempts at short local parts get digits, so that there is always room.
            local = F.regexp_extract(form, "^(.*)@", 1)
            more = F.when(attempt > 2, F.concat(F.lit("."), F.substring(seed, 1, 8))).otherwise("")
            domain = F.get(F.array(*[F.lit(x) for x in ("example.com", "example.net", "example.org")]), number(F.lit(-1), 3))
            email = F.concat(spelt(local), more, F.lit("@"), domain)
            iban = F.concat(F.substring(form, 1, 2), spelt(F.substring(form, F.lit(3), F.char_length(form))))
            # A person's form is one name: f:, m: or u: for a given name by its title's gender, s: for a surname.
            mark, own = F.substring(form, 1, 2), F.substring(form, F.lit(3), F.char_length(form))
            gender = F.when(mark == "f:", "female").when(mark == "m:", "male").otherwise(
                F.when(number(F.lit(-2), 2) == 0, "female").otherwise("male")
            )

            def given(g: str) -> Column:
                return F.get(F.array(*[F.lit(x.lower()) for x in _GIVEN[g]]), number(F.lit(-3), len(_GIVEN[g])))

            more_name = F.when(attempt > 2, spelt(F.lit("aaaa"))).otherwise("")
            listed = F.when(gender == "female", given("female")).otherwise(given("male"))
            formed = F.concat(spelt(F.rpad(own, 3, "e")), more_name, F.when(gender == "female", "a").otherwise("o"))
            first = F.when(~own.rlike(r"^\p{IsLatin}"), F.concat(spelt(own), more_name)).when(attempt == 0, listed).otherwise(formed)
            surname = F.concat(spelt(F.rpad(own, 4, "e")), more_name)
            person = F.concat(mark, F.when(mark == "s:", surname).otherwise(first))
            group = lambda g: F.when(g == "0000", g).otherwise(spelt(g, True))
            range6 = F.regexp_extract(form, "^(fe[89ab]|f[cd]|)", 1)
            ip6 = F.array_join(F.transform(F.split(form, ":"), group), ":")
            ip6 = F.concat(range6, F.substring(ip6, F.char_length(range6) + 1, F.lit(39)))
            kept = rf"^(?:{STREETS}|{_ROADS})$"
            ending = "(straße|strasse|weg|platz|allee|gasse|)$"

            def word(w: Column) -> Column:
                tail = F.regexp_extract(w, ending, 1)
                return F.when(w.rlike(kept), w).otherwise(F.concat(spelt(F.substring(w, F.lit(1), F.char_length(w) - F.char_length(tail))), tail))

            address = F.array_join(F.transform(F.split(form, " "), word), " ")
            hexes = F.when(form.rlike("^[0-9a-f]+$"), spelt(form, True)).otherwise(
                F.concat(F.regexp_extract(form, "^(akia|gh[a-z]_|sk-|xox[a-z]-|)", 1), spelt(F.regexp_replace(form, "^(akia|gh[a-z]_|sk-|xox[a-z]-)", "")))
            )
            return (
                F.when(kind == "email", email).when(kind == "phone", phone).when(kind == "card", card).when(kind == "ip", ip)
                .when(kind == "ip6", ip6).when(kind == "address", address).when(kind == "person", person).when(kind == "iban", iban).when(kind == "secret", hexes).otherwise(spelt(form))
            )

        return _let(self._seed(kind, form, attempt), of)

    @staticmethod
    def dressed(kind: Column, entity: Column, form: Column) -> Column:
        """The drawn canonical ``form`` in the spelling of ``entity``: its separators and its case."""

        def fitted(keep: str) -> Column:
            """Characters of ``form`` one by one in the places of those of ``entity`` that are not separators."""
            chars = F.split(entity, "")
            place = lambda i: F.char_length(F.regexp_replace(F.substring(entity, F.lit(1), i + 1), keep, ""))

            def one(c: Column, i: Column) -> Column:
                new = F.substring(form, place(i), F.lit(1))
                return F.when(c.rlike(keep), c).when(c.rlike(r"\p{Lu}"), F.upper(new)).otherwise(new)

            return F.array_join(F.transform(chars, one), "")

        upper = entity == F.upper(entity)
        cased = F.when(upper, F.upper(form)).otherwise(form)
        named = F.substring(form, F.lit(3), F.char_length(form))
        person = F.when(upper, F.upper(named)).otherwise(F.initcap(named))
        # An IPv6 address keeps the place of "::" and the number of groups about it.
        count = lambda side: F.size(F.filter(F.split(side, ":"), lambda g: g != ""))
        sides, groups = F.split(entity, "::"), F.transform(F.split(form, ":"), lambda g: F.regexp_replace(g, "^0{1,3}", ""))
        tail = F.reverse(F.slice(F.reverse(groups), F.lit(1), count(F.element_at(sides, -1))))
        short = F.concat(F.array_join(F.slice(groups, F.lit(1), count(sides[0])), ":"), F.lit("::"), F.array_join(tail, ":"))
        ip6 = F.when(F.size(sides) > 1, short).otherwise(form)
        address = F.when(upper, F.upper(form)).when(entity == F.lower(entity), form).otherwise(F.initcap(form))
        return (
            F.when(kind.isin("phone", "ssn", "card"), fitted(r"[^\d]"))
            .when(kind == "iban", fitted(" "))
            .when(kind == "person", person)
            .when(kind == "ip6", F.when(upper, F.upper(ip6)).otherwise(ip6))
            .when(kind == "address", address)
            .when(kind == "secret", fitted(r"[^\s\S]"))
            .otherwise(cased)
        )


def _luhn_sum(digits: Column, last_doubled: bool) -> Column:
    n = F.char_length(digits)

    def value(c: Column, i: Column) -> Column:
        d = c.cast("int")
        twice = F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
        from_end = F.pmod(n - 1 - i, F.lit(2))
        return F.when(from_end == (0 if last_doubled else 1), twice).otherwise(d)

    return F.aggregate(F.transform(F.split(digits, ""), value), F.lit(0), lambda a, x: a + x)


def _luhn(digits: Column) -> Column:
    return F.pmod(_luhn_sum(digits, False), F.lit(10)) == 0


def _check_digit(head: Column) -> Column:
    return F.pmod(10 - F.pmod(_luhn_sum(head, True), F.lit(10)), F.lit(10)).cast("string")


_NO_STRINGS = "array<string>"
_TITLED = r"^(" + _TITLE + r"\.? )"


def _people(text: Column) -> Column:
    """array<struct<token, form>>: the names of the persons with a title, in lower case, and their forms."""

    def of(entity: Column) -> Column:
        title = F.regexp_replace(F.lower(F.regexp_extract(entity, _TITLED, 1)), r"[. ]", "")
        names = F.split(F.lower(F.regexp_replace(entity, _TITLED, "")), " ")
        mark = F.when(title.isin([t.lower() for t in _TITLES["female"]]), "f:").when(title.isin([t.lower() for t in _TITLES["male"]]), "m:").otherwise("u:")
        n = F.size(names)
        return F.transform(names, lambda x, i: F.struct(x.alias("token"), F.concat(F.when(i < n - 1, mark).otherwise("s:"), x).alias("form")))

    titled = F.regexp_extract_all(text, F.lit(f"({PATTERNS['person']})"), F.lit(1))
    return F.flatten(F.transform(titled, of))


def _pattern(text: Column) -> Column:
    """ANY, and the names of the text's persons without a title."""
    names = F.array_distinct(F.transform(_people(text), lambda p: p["token"]))
    spelt = F.array_join(F.flatten(F.transform(names, lambda n: F.array(F.initcap(n), F.upper(n)))), "|")
    known = F.concat(F.lit("(?:"), spelt, F.lit(")"))
    return F.when(F.size(names) > 0, F.concat(F.lit(f"{ANY}|{_START}"), known, F.lit("(?: "), known, F.lit(f")?{_END}"))).otherwise(F.lit(ANY))


def matches(text: Column) -> Column:
    """All entities of a text in their order; an empty array where there is none."""
    none = F.array().cast(_NO_STRINGS)
    found = F.regexp_extract_all(text, F.concat(F.lit("("), _pattern(text), F.lit(")")), F.lit(1))
    return F.when(text.rlike(HINT), found).otherwise(none)


def _pieces(entity: Column, kind: Column, people: Column) -> Column:
    """array<struct<entity, kind, form>>: a person's names one by one, any other entity whole."""

    def name(n: Column) -> Column:
        # A name that is given with and without a gender is one name: the first place in the text decides.
        known = F.filter(people, lambda p: p["token"] == F.lower(n))
        form = F.coalesce(F.get(known, F.lit(0))["form"], F.concat(F.lit("s:"), F.lower(n)))
        return F.struct(n.alias("entity"), F.lit("person").alias("kind"), form.alias("form"))

    names = F.transform(F.split(F.regexp_replace(entity, _TITLED, ""), " "), name)
    whole = F.array(F.struct(entity.alias("entity"), kind.alias("kind"), canonical(kind, entity).alias("form")))
    return F.when(kind == "person", names).otherwise(whole)


def _placed(docs: DataFrame, text: str, *more: Column) -> DataFrame:
    """(more, kind, form): one row for each entity, or name of a person, at each of its places."""
    t = whole_text(text)
    found = docs.select(*more, _people(t).alias("_people"), F.explode(matches(t)).alias("entity")).withColumn("kind", kind_of(F.col("entity")))
    names = [c for c in found.columns if c not in ("_people", "entity", "kind")]
    pieces = found.select(*names, F.explode(_pieces(F.col("entity"), F.col("kind"), F.col("_people"))).alias("p"))
    return pieces.select(*names, "p.kind", "p.form")


def entities(docs: DataFrame, text: str = "text") -> DataFrame:
    """(kind, form, n): distinct entities of the table, persons name by name, with their number of places."""
    return _placed(docs, text).groupBy("kind", "form").agg(F.count("*").alias("n"))


def second_draws(real: DataFrame, how: Surrogates) -> DataFrame:
    """(kind, form, attempt) for the entities whose first surrogate collides.

    A draw is refused if it is a real entity, if another entity holds it, or if an entity with a smaller canonical form
    draws it in the same round. Every entity ends with a surrogate of its own.
    """

    def drawn(rows: DataFrame, attempt: int) -> DataFrame:
        return rows.select("kind", "form", how.draw(F.col("kind"), F.col("form"), F.lit(attempt)).alias("draw"))

    def split(rows: DataFrame, held: DataFrame | None) -> DataFrame:
        """Rows with ``ok``: whether the draw stands."""
        first = rows.groupBy("kind", "draw").agg(F.min("form").alias("form")).withColumn("first", F.lit(True))
        marked = rows.join(first, ["kind", "draw", "form"], "left")
        known = real.select("kind", F.col("form").alias("draw"))
        if held is not None:
            known = known.unionByName(held.select("kind", "draw")).distinct()
        return marked.join(known.withColumn("known", F.lit(True)), ["kind", "draw"], "left").select(
            "kind", "form", "draw", (F.col("first").isNotNull() & F.col("known").isNull()).alias("ok")
        )

    tried = save(split(drawn(real, 0), None), "draws")
    held = tried.filter("ok").select("kind", "form", "draw")
    todo = tried.filter(~F.col("ok")).select("kind", "form")
    settled: list[DataFrame] = []
    for attempt in range(1, ROUNDS + 1):
        if todo.isEmpty():
            break
        again = save(split(drawn(todo, attempt), held), "draws")
        good = again.filter("ok")
        settled.append(good.select("kind", "form", F.lit(attempt).alias("attempt")))
        held = held.unionByName(good.select("kind", "form", "draw"))
        todo = again.filter(~F.col("ok")).select("kind", "form")
    else:
        if not todo.isEmpty():
            raise ValueError("a format has no room for distinct surrogates")
    out = real.select("kind", "form", F.lit(0).alias("attempt")).limit(0)
    for part in settled:
        out = out.unionByName(part)
    out = save(out, "second-draws")
    discard(tried)
    return out


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with the entities of ``text`` replaced, and n_entities, the number of places replaced.

    A null text stays null, a text without entities stays as it is. Repeated rows are replaced alike. A column named
    n_entities is replaced. An empty table stays empty.
    """
    how = Surrogates(key)
    real = save(entities(docs, text), "entities")
    special = second_draws(real, how)
    n_special = special.count()
    bare = docs.drop("n_entities")
    name = lambda kind, form: F.concat_ws("|", kind, form)
    if not n_special:
        rows, attempts = bare, None
    elif n_special <= EXCEPTIONS:
        pairs = special.select(name(F.col("kind"), F.col("form")).alias("k"), "attempt").collect()
        rows, attempts = bare, F.create_map(*[F.lit(x) for p in pairs for x in (p.k, p.attempt)])
    else:
        at = F.sha2(whole_text(text), 256)
        placed = _placed(docs, text, at.alias("_text")).distinct()
        by_text = placed.join(special, ["kind", "form"]).groupBy("_text").agg(
            F.map_from_entries(F.collect_set(F.struct(name(F.col("kind"), F.col("form")), F.col("attempt")))).alias("_attempts")
        )
        rows = bare.withColumn("_text", at).join(by_text, "_text", "left").drop("_text")
        attempts = F.col("_attempts")

    def drawn(p: Column) -> Column:
        kind, form = p["kind"], p["form"]
        attempt = F.lit(0) if attempts is None else F.coalesce(F.try_element_at(attempts, name(kind, form)), F.lit(0))
        return how.dressed(kind, p["entity"], how.draw(kind, form, attempt))

    def surrogate(entity: Column) -> Column:
        def of(kind: Column) -> Column:
            title = F.when(kind == "person", F.regexp_extract(entity, _TITLED, 1)).otherwise("")
            return F.concat(title, F.array_join(F.transform(_pieces(entity, kind, F.col("_people")), drawn), " "))

        return _let(kind_of(entity), of)

    t = F.col(text).cast("string")
    found = F.coalesce(matches(t), F.array().cast(_NO_STRINGS))
    gaps = F.split(t, _pattern(t))

    def woven(m: Column) -> Column:
        new = F.concat(F.transform(m, surrogate), F.array(F.lit("")))
        return F.array_join(F.zip_with(gaps, new, lambda a, b: F.concat(a, b)), "")

    out = rows.withColumn("_found", found).withColumn("_people", _people(t))
    changed = F.when(F.size("_found") > 0, woven(F.col("_found"))).otherwise(F.col(text))
    out = out.withColumn("n_entities", F.size("_found").cast("long")).withColumn(text, changed)
    return out.select(*[text if c == text else c for c in bare.columns], "n_entities")


def pii_surrogates(docs: DataFrame, key: str) -> DataFrame:
    """op5: every document with its private entities replaced."""
    return pseudonymise(docs.select("doc_id", "text"), key)
