"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on each of two questions: is the text of low quality, is it
toxic. Expectation-maximisation estimates each labeller's accuracies from how often the vote patterns of all documents
occur (at most 3^labellers patterns of a question, whatever the corpus). The posterior of a document's pattern is its label, with which
a linear scorer over hashed features is fitted; the scorer then judges every document.

The fit reads at most about SAMPLE_ROWS documents, chosen by a hash of the text. Votes, patterns and scores cover all.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_text

#: Expected number of documents that fit the scorers.
SAMPLE_ROWS = 8_000
BUCKETS = 1 << 18
EM_ROUNDS = 50
EPOCHS = 60
#: What a text without any vote on toxicity counts in the fit.
SILENT = 0.2
RATE = 0.5
DECAY = 1e-4
#: Distinct words whose features a worker remembers.
CACHE_WORDS = 300_000

#: Insults to ability, insults to worth, coarse words and slurs in the languages of the table; whole words in any case, also
#: with stretched letters or digits for letters.
LEXICONS = {
    "ability": """
        idiot idiots idiotic moron morons moronic stupid dumb dumbass imbecile imbeciles imbecilic cretin cretins dunce dimwit dimwits
        halfwit halfwits nitwit nitwits airhead blockhead bonehead dolt dullard dummy fool fools foolish simpleton clown clowns loser losers
        buffoon numbskull lamebrain brainless clueless dope twit
        idiota dumm dummkopf blöd blöde blöder blödmann depp deppen trottel vollidiot vollpfosten schwachkopf hohlkopf dämlich idioten
        idiote idiotes imbécile imbéciles débile débiles stupide stupides crétin crétine crétins abruti abrutie abrutis andouille bouffon nul
        estúpido estúpida estúpidos estúpidas imbécil imbéciles tonto tonta tontos tontas bobo boba tarado tarada necio necia burro payaso payasa""",
    "worth": """
        trash pathetic disgusting worthless scum loser losers clown clowns garbage vermin filth filthy repulsive despicable contemptible
        lowlife creep creeps pig pigs rat parasite parasites wretch degenerate degenerates sickening useless coward cowards liar vile ugly
        abschaum dreck drecksack drecksau ekelhaft erbärmlich widerlich wertlos ungeziefer versager feigling schmarotzer abartig
        ordure ordures minable minables pourriture dégoûtant dégoûtante répugnant vermine racaille raclure lâche salaud salauds crapule
        basura escoria asqueroso asquerosa patético patética inútil inútiles despreciable repugnante gusano cobarde rata miserable sinvergüenza""",
    "coarse": """
        asshole assholes bastard bastards bitch bitches bitching cunt cunts dick dickhead prick pricks shit shithead bullshit fuck fucks fucking
        fucked fucker motherfucker motherfuckers wanker wankers twat douche douchebag whore whores slut sluts faggot faggots retard retards
        retarded nigger niggers kike kikes spic spics chink chinks tranny paki
        arschloch arschlöcher scheiße scheisse wichser hurensohn hure schlampe fotze miststück schwuchtel spast spasti kanake kanaken missgeburt
        connard connards connasse connasses salope salopes pute putes putain enculé enculés merde bâtard pédé bougnoule nique
        puta putas puto cabrón cabrones gilipollas mierda pendejo pendejos pendeja zorra maricón maricones coño joder sudaca hijueputa""",
}
_FLAG = {k: 1 << i for i, k in enumerate(LEXICONS)}
_WORDS: dict[str, int] = {}
for _k, _list in LEXICONS.items():
    for _w in _list.split():
        _WORDS[_w] = _WORDS.get(_w, 0) | _FLAG[_k]
#: Forms of a threat and of abuse to the face. They hold no insult: what is called a person may be any word.
_THREATS = re.compile(
    r"\b(?:i(?:'ll|’ll| will| am going to|'m going to|’m going to|'m gonna|’m gonna) (?:kill|hurt|destroy|beat|find|hunt) you|kill yourself|go die|you (?:should|deserve to|will) die"
    r"|ich (?:bringe? dich um|töte dich|mach(?:e)? dich (?:fertig|kalt))|bring dich um|je vais te (?:tuer|buter|frapper)|(?:va )?crève(?: donc)?\b|tu vas (?:crever|mourir)"
    r"|te voy a (?:matar|pegar|destruir)|mátate|muérete|vas a morir)\b",
    re.IGNORECASE,
)
_ABUSE = re.compile(
    r"\b(?:you(?:'re|’re| are) (?:nothing but|such an?|an? (?:complete|total|absolute|utter|real|pathetic|bloody|fucking))\b|you (?:absolute|complete|total|utter|bloody|little|fucking) \w+"
    r"|what an? (?:complete|absolute|total|utter) \w+ you are|shut (?:the \w+ )?up|nobody (?:likes|wants|needs) you|go to hell|get lost|screw you"
    r"|du bist (?:so |doch |echt |nur |wirklich |nichts als )+(?:ein|eine)\b|du (?:elend|verdammt|mies|erbärmlich)\w* \w+|halt (?:die klappe|den mund|dein maul|die fresse)|geh zur hölle|verpiss dich"
    r"|espèces? d(?:e |['’])\w+|tu n(?:'|’)es qu(?:e |['’])une?\b|tu es (?:vraiment )?une? (?:vraie?|gros(?:se)?|sale|pauvre)\b|ferme[- ]la|ta gueule|va te faire"
    r"|(?:pedazo|trozo) de \w+|(?:no )?eres (?:más que )?una? (?:completo|completa|verdadero|verdadera|maldito|maldita|total)\b|no eres más que|cállate|vete al (?:diablo|infierno))",
    re.IGNORECASE,
)
#: Words without which no threat, or no abuse to the face, can match: one word of each set of a row must be in the text.
#: A trailing star stands for any end.
THREAT_WORDS = [
    ("kill hurt destroy beat find hunt", "you"), ("yourself",), ("go", "die"), ("you", "die"), ("dich",),
    ("tuer buter frapper crève crever mourir",), ("matar pegar destruir morir mátate muérete",),
]
ABUSE_WORDS = [
    ("you", "nothing such complete total absolute utter real pathetic bloody little fucking"), ("shut nobody screw",),
    ("go", "hell*"), ("get", "lost*"), ("bist halt geh verpiss",), ("du", "elend* verdammt* mies* erbärmlich*"),
    ("espèce espèces ferme",), ("tu", "es"), ("ta", "gueule*"), ("va", "te"), ("pedazo trozo eres vete cállate*",),
]
#: Words that address the reader.
_ADDRESS = frozenset("you your yours yourself u du dich dir dein deine ihr euch tu te toi ton ta vous votre tú ti usted ustedes eres".split())
#: Frequent function words of running text in the languages of the table.
FUNCTION_WORDS = {
    "the", "of", "and", "to", "in", "is", "that", "it", "was", "for", "on", "are", "with", "as", "be", "by", "this", "from", "or", "at",
    "le", "la", "les", "de", "des", "et", "en", "que", "qui", "dans", "pour", "un", "une", "du", "sur", "par",
    "der", "die", "das", "und", "den", "von", "zu", "mit", "sich", "auf", "für", "ist", "im", "dem", "nicht", "ein", "eine",
    "el", "los", "las", "y", "se", "del", "por", "con", "no", "su", "para", "al", "lo",
}

GOOD, NONE, BAD = 1, 0, -1
_SPLIT = re.compile(r"[^\W\d_]+")
_RUN = re.compile(r"(.)\1+")
_LEET = str.maketrans("013457@$", "oieastas")
_DIGIT = re.compile("[013457@$]")


ADDRESS = 1 << len(LEXICONS)
CAPITAL = ADDRESS << 1
FUNCTION = ADDRESS << 2
#: One bit for each set of the rows of THREAT_WORDS and ABUSE_WORDS.
_SETS = sorted({words for row in THREAT_WORDS + ABUSE_WORDS for words in row})
_BIT = {words: ADDRESS << 3 + i for i, words in enumerate(_SETS)}
_WHOLE: dict[str, int] = {}
_STARTS: dict[str, int] = {}
for _list, _bit in _BIT.items():
    for _w in _list.split():
        _to = _STARTS if _w.endswith("*") else _WHOLE
        _to[_w.rstrip("*")] = _to.get(_w.rstrip("*"), 0) | _bit
_START = re.compile("|".join(_STARTS))
_THREAT_GATES, _ABUSE_GATES = ([sum(_BIT[words] for words in row) for row in rows] for rows in (THREAT_WORDS, ABUSE_WORDS))


def flags_of(word: str) -> int:
    """Bits of the lexicons that know the word, ADDRESS, CAPITAL, FUNCTION, and those of the words that the gates ask for."""
    runs = _SPLIT.findall(word)
    core = "".join(runs).lower()
    found = _WORDS.get(core, 0)
    if not found and core:
        plain = "".join(_SPLIT.findall(word.lower().translate(_LEET))) if _DIGIT.search(word) else core
        found = _WORDS.get(plain, 0)
        if not found and _RUN.search(plain):
            found = _WORDS.get(_RUN.sub(r"\1", plain), 0) or _WORDS.get(_RUN.sub(r"\1\1", plain), 0)
    for run in runs:
        # As an expression that ignores case compares letters.
        low = run.lower() if run.isascii() else run.casefold().replace("ı", "i").replace("i\u0307", "i")
        found |= _WHOLE.get(low, 0)
        start = _START.match(low)
        if start:
            found |= _STARTS[start.group()]
    if core in _ADDRESS:
        found |= ADDRESS
    if len(word) > 1 and word.isupper():
        found |= CAPITAL
    if word.strip(".,;:!?").lower() in FUNCTION_WORDS:
        found |= FUNCTION
    return found


def quality_votes(text: str, flags: np.ndarray, numbers: np.ndarray) -> list[int]:
    """Votes of the labellers of low quality, from the flags of the words and from numbers that are equal for equal words."""
    n = len(flags)
    if not n:
        return [BAD] + [NONE] * 5
    marks = sum(map(text.count, "#*$%&|<>"))
    bangs = text.count("!")
    capitals = np.count_nonzero(flags & CAPITAL)
    stutter = np.count_nonzero(numbers[1:] == numbers[:-1])
    function = np.count_nonzero(flags & FUNCTION)
    different = len(np.unique(numbers))
    return [
        BAD if marks > 0.1 * n else GOOD if marks < 0.02 * n else NONE,
        BAD if bangs > 0.2 * n else GOOD if bangs < 0.02 * n and capitals < 0.1 * n else NONE,
        BAD if capitals > 0.3 * n else GOOD if capitals < 0.05 * n else NONE,
        BAD if stutter > 0.3 * n else GOOD if stutter < 0.1 * n else NONE,
        NONE if n < 40 else BAD if different < 0.2 * n and different < 100 else GOOD if different > 0.35 * n else NONE,
        NONE if n < 20 else GOOD if function > 0.1 * n else BAD if function < 0.02 * n else NONE,
    ]


def toxic_votes(text: str, flags: np.ndarray) -> list[int]:
    """Votes of the labellers of toxic language, from the flags of the words; BAD means toxic. A list without a hit is silent.

    Threats, abuse to the face and a calm tone need no list of insults; only the last one votes GOOD. The two long
    expressions run only where the words that they need occur.
    """
    n = len(flags)
    every = int(np.bitwise_or.reduce(flags)) if n else 0
    hits = np.count_nonzero(flags & (ADDRESS - 1))
    loud = text.count("!") > 0.02 * n or np.count_nonzero(flags & CAPITAL) > 0.1 * n

    def found(form: re.Pattern, gates: list[int]) -> bool:
        return any(every & g == g for g in gates) and form.search(text) is not None

    return [
        *(BAD if every & _FLAG[k] else NONE for k in LEXICONS),
        BAD if hits > 1 or 25 * hits > n else NONE,
        BAD if found(_THREATS, _THREAT_GATES) else NONE,
        BAD if found(_ABUSE, _ABUSE_GATES) else NONE,
        GOOD if n and not every & ADDRESS and not loud else NONE,
    ]


TOXIC = len(LEXICONS) + 4
#: Labellers of each question.
LABELLERS = {"quality": 6, "toxic": TOXIC}


def fit_labellers(patterns: np.ndarray, counts: np.ndarray, rounds: int = EM_ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation over vote patterns (rows of -1, 0, 1) that occur ``counts`` times.

    Returns the posterior of BAD for each pattern, and P(vote | class, some vote) as (class, labeller, vote + 1). Labellers are
    independent given the class; starts from the majority of votes, with one pseudo-count per vote. A labeller that
    gives no vote says nothing: its share of silence is left out, and the accuracies are those of the votes given.
    Of a labeller that knows one vote only, these would be 1: what counts is how often it votes in each class.
    """
    single = ~((patterns == GOOD).any(axis=0) & (patterns == BAD).any(axis=0))
    start = np.where(patterns == BAD, 0.9, np.where(patterns == GOOD, 0.1, 0.5)).mean(axis=1)
    posterior = np.clip(start, 0.02, 0.98)
    onehot = (patterns[:, :, None] + 1) == np.arange(3)
    table = np.empty((2, patterns.shape[1], 3))
    for _ in range(rounds):
        weight = np.stack([(1 - posterior) * counts, posterior * counts])
        table = np.einsum("cp,plv->clv", weight, onehot) + 1.0
        table[:, :, NONE + 1] = 0.0
        table /= table.sum(axis=2, keepdims=True)
        prior = (weight.sum(axis=1) + 1.0) / (weight.sum() + 2.0)
        rate = (np.einsum("cp,pl->cl", weight, patterns != NONE) + 1.0) / (weight.sum(axis=1, keepdims=True) + 2.0)
        voted = np.log(np.where(table > 0, table, 1.0))
        voted[:, single] = np.log(np.stack([rate, 1 - rate, rate], axis=2))[:, single]
        like = np.log(prior)[:, None] + np.einsum("plv,clv->cp", onehot, voted)
        posterior = 1 / (1 + np.exp(np.clip(like[0] - like[1], -500, 500)))
    return posterior, table


class _Classes(dict):
    """Code point -> its class, filled as code points occur."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = ("X" if c.isupper() else "x") if c.isalpha() else "9" if c.isdigit() else c
        return self[code]


_CLASSES = _Classes()


def _shape(word: str) -> str:
    """Letters, capitals and digits as classes, runs cut to one: "Word###" -> "Xx#"."""
    if word.isalpha() and word.islower():
        return "x"
    return _RUN.sub(r"\1", word.translate(_CLASSES))


#: Buckets of the BAD votes on toxicity.
VOTED = [zlib.crc32(b"vote%d" % i) % BUCKETS for i in range(TOXIC)]
_BIAS, _SAME = (zlib.crc32(k) % BUCKETS for k in (b"bias", b"same"))


class Words:
    """What is known of each distinct word: its number, and by number the buckets of the word and its shape, and its flags."""

    def __init__(self) -> None:
        self.numbers: dict[str, int] = {}
        self.table = np.empty((1024, 3), dtype=np.int64)

    def __call__(self, words: list[str]) -> np.ndarray:
        """Numbers of the words, good until the next call."""
        if len(self.numbers) > CACHE_WORDS:
            self.numbers.clear()
        numbers = self.numbers
        new = []
        for w in set(words).difference(numbers):
            core = "".join(_SPLIT.findall(w)).lower()
            new.append((zlib.crc32(b"w" + core.encode()) % BUCKETS, zlib.crc32(b"s" + _shape(w).encode()) % BUCKETS, flags_of(w)))
            numbers[w] = len(numbers)
        if new:
            first = len(numbers) - len(new)
            if len(numbers) > len(self.table):
                self.table = np.concatenate([self.table, np.empty((len(numbers), 3), dtype=np.int64)])
            self.table[first : len(numbers)] = new
        return np.fromiter(map(numbers.__getitem__, words), dtype=np.int64, count=len(words))


class Features:
    """Votes and hashed features of a text: how often its word shapes and repetitions occur for quality; for toxicity its
    words and the labellers that call it toxic."""

    def __init__(self) -> None:
        self.words = Words()

    def votes(self, text: str) -> dict[str, list[int]]:
        """Question -> votes."""
        numbers = self.words(text.split())
        flags = self.words.table[numbers, 2]
        return {"quality": quality_votes(text, flags, numbers), "toxic": toxic_votes(text, flags)}

    def __call__(self, text: str) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        """Question -> (buckets, values)."""
        numbers = self.words(text.split())
        n = max(len(numbers), 1)
        of_word, of_shape, flags = self.words.table[numbers].T
        shapes, times = np.unique(of_shape, return_counts=True)
        same = np.count_nonzero(numbers[1:] == numbers[:-1])
        voted = [b for b, v in zip(VOTED, toxic_votes(text, flags), strict=True) if v == BAD]
        has = np.unique(of_word)
        has = has[~np.isin(has, VOTED)]
        return {
            "quality": (np.r_[shapes, _BIAS, _SAME], np.r_[4 * times / (n + 10), 1.0, 4 * same / n]),
            "toxic": (np.r_[has, voted, _BIAS].astype(np.int64), np.r_[np.full(len(has), 1 / np.sqrt(len(has) + 1)), np.ones(len(voted) + 1)]),
        }


@cache
def _features() -> Features:
    """Those of a worker, which knows the words of the tasks before."""
    return Features()


def fit_scorer(
    rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS, share: np.ndarray | float = 1.0
) -> np.ndarray:
    """Weights of a logistic scorer by full-batch AdaGrad on soft labels, both classes with equal weight in all.

    ``share`` is what a row counts.
    """
    weights = np.zeros(BUCKETS)
    if not len(rows):
        return weights
    size = np.array([len(b) for b, _ in rows])
    bucket = np.concatenate([b for b, _ in rows])
    value = np.concatenate([v for _, v in rows])
    row = np.repeat(np.arange(len(rows)), size)
    bad, good = (labels * share).sum(), ((1 - labels) * share).sum()
    balance = (labels * 0.5 / max(bad, 1e-9) + (1 - labels) * 0.5 / max(good, 1e-9)) * share
    seen = np.full(BUCKETS, 1e-8)
    for _ in range(epochs):
        margin = np.bincount(row, weights=weights[bucket] * value, minlength=len(rows))
        error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels) * balance
        slope = np.bincount(bucket, weights=error[row] * value, minlength=BUCKETS) + DECAY * weights
        seen += slope * slope
        weights -= RATE * slope / np.sqrt(seen)
    return weights


def _voted(docs: DataFrame, text: str) -> DataFrame:
    """Votes on each question, as short strings of the digits 0, 1, 2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = _features()
        for batch in batches:
            cast = [features.votes(t.as_py()) for t in batch.column(0)]
            data = [pa.array([_pattern(v[k]) for v in cast], pa.string()) for k in LABELLERS]
            yield pa.RecordBatch.from_arrays(data, names=list(LABELLERS))

    return docs.select(whole_text(text).alias("text")).mapInArrow(run, ", ".join(f"{k} string" for k in LABELLERS))


def _pattern(votes: list[int]) -> str:
    return "".join(str(v + 1) for v in votes)


def labeller_posteriors(docs: DataFrame, text: str = "text") -> dict[str, dict[str, float]]:
    """For each question: vote pattern -> posterior of BAD, from the patterns of all documents."""
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("question"), F.col(k).alias("votes")) for k in LABELLERS)))
    # At most 3^labellers rows of each question come to the driver.
    found = _voted(docs, text).select(each.alias("v")).groupBy("v.question", "v.votes").agg(F.count("*").alias("n")).collect()
    out = {}
    for k, n in LABELLERS.items():
        totals = {r.votes: r.n for r in found if r.question == k}
        patterns = np.array([[int(c) - 1 for c in p] for p in totals], dtype=np.int64).reshape(-1, n)
        posterior, _ = fit_labellers(patterns, np.array(list(totals.values()), dtype=float))
        out[k] = dict(zip(totals, posterior.tolist(), strict=True))
    return out


def fit(docs: DataFrame, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> dict[str, np.ndarray]:
    """Weights of both scorers. An empty table gives weights of zero."""
    posteriors = labeller_posteriors(docs, text)
    total = docs.count()
    scale = 1 << 40
    take = F.pmod(F.xxhash64("text"), F.lit(scale)) < int(min(1.0, sample_rows / max(total, 1)) * scale)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = _features()
        for batch in batches:
            cols: list[list] = [[] for _ in range(3 * len(LABELLERS) + 1)]
            for t in batch.column(0):
                value = t.as_py()
                row = []
                found, votes = features(value), features.votes(value)
                for k in LABELLERS:
                    buckets, values = found[k]
                    pattern = _pattern(votes[k])
                    row += [buckets.astype("<i4").tobytes(), values.astype("<f4").tobytes(), posteriors[k][pattern]]
                row.append(pattern)
                for c, x in zip(cols, row, strict=True):
                    c.append(x)
            kinds = (*(pa.binary(), pa.binary(), pa.float64()) * len(LABELLERS), pa.string())
            data = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(data, names=[*(f"{k}_{x}" for k in LABELLERS for x in "bvp"), "toxic_votes"])

    # A text that occurs many times counts once, so that copies can't fill the sample.
    texts = docs.select(whole_text(text).alias("text")).filter(take).distinct()
    rows = texts.mapInArrow(run, ", ".join(f"{k}_b binary, {k}_v binary, {k}_p double" for k in LABELLERS) + ", toxic_votes string").collect()
    out = {}
    silent = str(NONE + 1) * TOXIC
    # The bias alone: clean; with any BAD vote: toxic. So votes that the table never shows have a weight, too.
    bias = zlib.crc32(b"bias") % BUCKETS
    known = [(np.array([bias]), np.ones(1), 0.0), *((np.array([b, bias]), np.ones(2), 1.0) for b in VOTED)]
    for k in LABELLERS:
        found = [(np.frombuffer(r[f"{k}_b"], "<i4").astype(np.int64), np.frombuffer(r[f"{k}_v"], "<f4").astype(float)) for r in rows]
        labels = [r[f"{k}_p"] for r in rows]
        share: np.ndarray | float = 1.0
        if k == "toxic" and rows:
            # A text on which no labeller voted says little: its label is a guess from how often toxic texts are missed.
            part = max(1, len(rows) // 200)
            share = np.r_[[SILENT if r["toxic_votes"] == silent else 1.0 for r in rows], np.ones(part * len(known))]
            found = found + [x[:2] for x in known] * part
            labels = labels + [x[2] for x in known] * part
        out[k] = fit_scorer(found, np.array(labels), share=share)
    return out


def score(docs: DataFrame, weights: dict[str, np.ndarray], id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, kept, quality_score, toxic_score): probabilities of good quality and of toxic language.

    A null or blank text has no word and gets the bias alone. Repeated rows score alike. Other
    columns are not read.
    """
    cast = {k: w.astype(np.float32) for k, w in weights.items()}
    shared = docs.sparkSession.sparkContext.broadcast(cast)  # BUCKETS floats for each question, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        features = _features()
        for batch in batches:
            out: dict[str, list[float]] = {k: [] for k in LABELLERS}
            for t in batch.column(1):
                found = features(t.as_py())
                for k in LABELLERS:
                    buckets, values = found[k]
                    margin = float(np.clip(w[k][buckets] @ values, -30, 30))
                    out[k].append(1 / (1 + np.exp(-margin)))
            bad, toxic = (np.array(out[k]) for k in LABELLERS)
            data = [batch.column(0), pa.array((bad < 0.5) & (toxic < 0.5)), pa.array(1 - bad), pa.array(toxic)]
            yield pa.RecordBatch.from_arrays(data, names=["id", "kept", "quality_score", "toxic_score"])

    rows = docs.select(F.col(id).alias("id"), whole_text(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    scored = rows.mapInArrow(run, f"id {kind}, kept boolean, quality_score double, toxic_score double")
    return scored.withColumnRenamed("id", id)


def weak_quality(docs: DataFrame) -> DataFrame:
    """op7: the scorers' verdict on every document."""
    return score(docs, fit(docs))
