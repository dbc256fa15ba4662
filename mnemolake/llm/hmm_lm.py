"""A hidden Markov language model over documents.

A token is a word or the end of its text. Tokens fall into CLASSES classes: the OWN most frequent words and the end
have one each, the others share classes by their ending. Latent states emit classes; a class emits its words by their
add-one counts, with one more slot for words never seen, so that the model is a distribution over all texts. Counts
cover the whole vocabulary of the training rows.

Baum-Welch runs as one Spark job per round: each task adds up the expected counts of its sequences, Spark sums them, and
only the summed table (CLASSES + STATES + 1 rows) comes to the driver. Training sequences are runs of at most RUN tokens,
so that many of them advance side by side; scoring runs the scaled forward recursion over whole texts.

Counts of the at most TOP most frequent words are broadcast; rarer words meet their counts in a join.
"""

from __future__ import annotations

import string
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import save
from .common import whole_text

STATES = 8
OWN = 2048
ENDINGS = 2046
CLASSES = OWN + 2 + ENDINGS  # ids: 0 the end, 1 .. OWN own words, then endings; one id stays free
TOP = 262_144
ROUNDS = 6
RUN = 256
#: Weight of a class's share of all tokens in each state's emissions.
PRIOR = 20.0
#: Distinct words a task counts before it passes them on.
COUNTED_WORDS = 400_000
#: Runs of tokens, or documents, that advance side by side.
LANES = 4096
SEED = 7

END = b""
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_MARKS = string.punctuation.encode()


def tokens(text: str) -> list[bytes]:
    """Lower-case words in UTF-8; the end is not among them."""
    return text.encode().translate(_LOWER).split()


def ending_class(word: bytes) -> int:
    """Class of a word that has none of its own: by its last three bytes before marks, and whether it has marks."""
    core = word.rstrip(_MARKS)
    return OWN + 1 + zlib.crc32(core[-3:] + (b"." if len(core) < len(word) else b"")) % ENDINGS


def held_out(id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id).cast("string").cast("binary")) % 7 == 2, F.lit(False))


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, c): counts of all tokens of ``docs``, the end as the empty word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            data = [pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())]
            return pa.RecordBatch.from_arrays(data, names=["word", "c"])

        for batch in batches:
            for t in batch.column(0):
                seen.update(tokens(t.as_py()))
                seen[END] += 1
                if len(seen) > COUNTED_WORDS:
                    yield out()
                    seen.clear()
        if seen:
            yield out()

    counted = docs.select(whole_text(text).alias("text")).mapInArrow(run, "word binary, c long")
    return counted.groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """What every task knows of the words: the frequent ones with counts, and the size of each class."""

    words: list[bytes]
    counts: np.ndarray
    classes: np.ndarray
    class_tokens: np.ndarray
    class_words: np.ndarray
    total: int
    distinct: int

    def log_sizes(self) -> np.ndarray:
        """log10 of the denominator of a word in its class; 0 where the class has one word for certain."""
        size = self.class_tokens + self.class_words + 1.0
        size[: OWN + 1] = 1.0
        return np.log10(size)


def frequent_words(counts: DataFrame) -> list:
    """The (word, c) rows of the most frequent words, at most TOP of them.

    Words are counted by sixteenths of powers of two of their count, a table of under 1024 rows; all levels that fit
    are taken. A sort with a limit would send TOP rows of every task to the driver.
    """
    level = F.floor(F.log2("c") * 16)
    rows = counts.filter(F.length("word") > 0)
    sizes = rows.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect()
    taken, least = 0, None
    for r in sizes:
        taken += r["count"]
        if taken > TOP:
            break
        least = r.level
    return [] if least is None else rows.filter(level >= least).select("word", "c").collect()


def vocabulary(counts: DataFrame) -> Vocabulary:
    """From saved counts; at most TOP words and CLASSES sums come to the driver."""
    best = sorted(frequent_words(counts), key=lambda r: (-r.c, bytes(r.word)))
    words = [bytes(r.word) for r in best]
    own = set(words[:OWN])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, v = np.zeros(CLASSES), np.zeros(CLASSES)
        for batch in batches:
            word = [w.as_py() for w in batch.column(0)]
            at = np.array([0 if not w else 1 if w in own else ending_class(w) for w in word], dtype=np.int64)
            n += np.bincount(at, weights=batch.column(1).to_numpy(), minlength=CLASSES)
            v += np.bincount(at, minlength=CLASSES)
        at = np.flatnonzero(v)
        data = [pa.array(at), pa.array(n[at].astype(np.int64)), pa.array(v[at].astype(np.int64))]
        yield pa.RecordBatch.from_arrays(data, names=["class", "n", "v"])

    sums = counts.mapInArrow(run, "class long, n long, v long").groupBy("class").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
    n, v = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in sums.collect():
        n[r["class"]], v[r["class"]] = r.n, r.v
    total, distinct = int(n.sum()), int(v.sum())
    # Own words were added up in class 1.
    n[1 : OWN + 1], v[1 : OWN + 1] = 0, 0
    c = np.array([r.c for r in best], dtype=np.int64)
    n[1 : 1 + len(words[:OWN])] = c[:OWN]
    v[1 : 1 + len(words[:OWN])] = 1
    classes = np.array([i + 1 if i < OWN else ending_class(w) for i, w in enumerate(words)], dtype=np.int64)
    return Vocabulary(words, c, classes, n, v, total, distinct)


def sequences(docs: DataFrame, vocab: Vocabulary, id: str, text: str) -> DataFrame:
    """A row per document: its classes, what the frequent words give to the scores, and its rarer words.

    row long, id, held_out, n_tokens, classes binary (unsigned 16-bit), known_sum (log10 of count + 1 over frequent
    words and the end), inner_sum (the same without words that have a class of their own), size_sum (log10 of the class
    sizes), n_known, rare array<binary>, rare_n array<int>.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocab)
    rows = docs.select(F.col(id).alias("id"), held_out(id).alias("held_out"), whole_text(text).alias("text"))
    key = rows.schema["id"].dataType
    end_known = np.log10(vocab.class_tokens[0] + 1)
    seen_end = bool(vocab.class_tokens[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = shared.value
        index = {w: i for i, w in enumerate(vocab.words)}
        logs = np.log10(np.r_[vocab.counts, 0] + 1.0)
        classes = np.r_[vocab.classes, 0]
        sizes = vocab.log_sizes()
        number = TaskContext.get().partitionId() << 36
        names = ["row", "id", "held_out", "n_tokens", "classes", "known_sum", "inner_sum", "size_sum", "n_known", "rare", "rare_n"]
        kinds = [pa.int64(), to_arrow_type(key), pa.bool_(), pa.int64(), pa.binary(), pa.float64(), pa.float64(), pa.float64(),
                 pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int32())]
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                out: list[list] = [[] for _ in names]
                for key_, held, t in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                    words = tokens(t)
                    at = np.array([index.get(w, -1) for w in words], dtype=np.int64)
                    rare = Counter(words[i] for i in np.flatnonzero(at < 0).tolist())
                    of = {w: ending_class(w) for w in rare}
                    c = classes[at]
                    c[at < 0] = [of[words[i]] for i in np.flatnonzero(at < 0).tolist()]
                    c = np.r_[c, 0]
                    lg = logs[at]
                    row = (
                        number, key_, held, len(words) + 1, c.astype("<u2").tobytes(), float(lg.sum() + end_known),
                        float(lg[c[:-1] > OWN].sum()), float(sizes[c].sum()), int((at >= 0).sum()) + seen_end,
                        list(rare), list(rare.values()),
                    )
                    number += 1
                    for col, x in zip(out, row, strict=True):
                        col.append(x)
                data = [pa.array(x, kind) for x, kind in zip(out, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(data, names=names)

    schema = (
        f"row long, id {key.simpleString()}, held_out boolean, n_tokens long, classes binary, known_sum double, inner_sum double, "
        "size_sum double, n_known long, rare array<binary>, rare_n array<int>"
    )
    return rows.mapInArrow(run, schema)


@dataclass
class Hmm:
    """Initial, transition and emission probabilities; emissions as (class, state)."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray

    @classmethod
    def blank(cls, share: np.ndarray, states: int = STATES, seed: int = SEED) -> Hmm:
        """States that stay put, with emissions around the classes' shares of all tokens."""
        rng = np.random.default_rng(seed)
        emit = share[:, None] * rng.uniform(0.5, 1.5, (len(share), states))
        move = np.full((states, states), 0.1 / max(states - 1, 1))
        np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
        return cls(np.full(states, 1 / states), move, emit / emit.sum(axis=0))

    def expected(self, runs: np.ndarray) -> np.ndarray:
        """Expected counts of equally long runs (rows): emissions by class, then transitions, then starts, as rows."""
        n, length = runs.shape
        k = len(self.start)
        like = self.emit[runs.T]  # (step, run, state)
        alpha = np.empty_like(like)
        scale = np.empty((length, n))
        a = self.start * like[0]
        for t in range(length):
            if t:
                a = (alpha[t - 1] @ self.move) * like[t]
            scale[t] = a.sum(axis=1)
            alpha[t] = a / scale[t][:, None]
        moves = np.zeros((k, k))
        beta = np.ones((n, k))
        gamma = alpha
        for t in range(length - 1, 0, -1):
            later = beta * like[t] / scale[t][:, None]
            moves += alpha[t - 1].T @ later
            beta = later @ self.move.T
            gamma[t - 1] = alpha[t - 1] * beta
        flat = runs.T.ravel()
        emits = np.stack([np.bincount(flat, weights=gamma[:, :, s].ravel(), minlength=len(self.emit)) for s in range(k)], axis=1)
        return np.vstack([emits, moves * self.move, gamma[0].sum(axis=0)])

    def log10_likelihood(self, texts: list[np.ndarray]) -> np.ndarray:
        """Exact log10 probability of each class sequence: the scaled forward recursion, longest first."""
        out = np.zeros(len(texts))
        order = np.argsort([-len(x) for x in texts], kind="stable")
        sizes = np.array([len(texts[i]) for i in order])
        flat = np.concatenate([texts[i] for i in order]) if len(texts) else np.empty(0, dtype=np.int64)
        first = np.cumsum(sizes) - sizes
        a = np.tile(self.start, (len(texts), 1))
        total = np.zeros(len(texts))
        for t in range(sizes[0] if len(sizes) else 0):
            live = int(np.searchsorted(-sizes, -t, "left"))  # texts longer than t
            a = a[:live] @ self.move if t else a[:live]
            a = a * self.emit[flat[first[:live] + t]]
            s = a.sum(axis=1)
            a /= s[:, None]
            total[:live] += np.log10(s)
        out[order] = total
        return out

    def update(self, counts: np.ndarray, share: np.ndarray) -> Hmm:
        """Parameters from summed expected counts, smoothed towards the classes' shares."""
        k = len(self.start)
        emit = counts[: len(share)] + PRIOR * share[:, None]
        move = counts[len(share) : len(share) + k] + 0.1
        start = counts[-1] + 0.1
        return Hmm(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def train(rows: DataFrame, share: np.ndarray, states: int = STATES, rounds: int = ROUNDS) -> Hmm:
    """Baum-Welch over (classes) of all training rows."""
    model = Hmm.blank(share, states)
    sc = rows.sparkSession.sparkContext
    names = [f"s{i}" for i in range(states)]
    for _ in range(rounds):
        shared = sc.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now = shared.value  # noqa: B023
            sums = np.zeros((len(share) + states + 1, states))
            whole: list[np.ndarray] = []
            short: dict[int, list[np.ndarray]] = {}
            held = 0
            for batch in batches:
                for raw in batch.column(0):
                    seq = np.frombuffer(raw.as_py(), "<u2").astype(np.int64)
                    full = len(seq) // RUN * RUN
                    if full:
                        whole.append(seq[:full].reshape(-1, RUN))
                        held += full // RUN
                    # Ends of texts go by length, a power of two at a time, so that they too advance together.
                    rest = seq[full:]
                    size = RUN
                    while len(rest):
                        size //= 2
                        if len(rest) >= size:
                            short.setdefault(size, []).append(rest[:size])
                            rest = rest[size:]
                            if len(short[size]) * size >= LANES * RUN // 2:
                                sums += now.expected(np.stack(short.pop(size)))
                    if held >= LANES:
                        sums += now.expected(np.concatenate(whole))
                        whole, held = [], 0
            if whole:
                sums += now.expected(np.concatenate(whole))
            for runs in short.values():
                sums += now.expected(np.stack(runs))
            at = np.flatnonzero(sums.any(axis=1))
            data = [pa.array(at.astype(np.int32)), *(pa.array(np.ascontiguousarray(sums[at, i])) for i in range(states))]
            yield pa.RecordBatch.from_arrays(data, names=["part", *names])

        found = rows.select("classes").mapInArrow(run, "part int, " + ", ".join(f"{n} double" for n in names))
        summed = found.groupBy("part").agg(*[F.sum(n).alias(n) for n in names]).collect()
        counts = np.zeros((len(share) + states + 1, states))
        for r in summed:
            counts[r.part] = [r[n] for n in names]
        model = model.update(counts, share)
        shared.unpersist()
    return model


def score(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs``.

    Rows whose crc32(id as text) mod 7 is 2 are held out; all others train, those with a null id too. A null or empty
    text is the end alone. Rows that repeat an id count and score each. With no training row, counts are zero and the
    model has its starting values. Other columns are not read.
    """
    counts = save(word_counts(docs.filter(~held_out(id)), text), "word-counts")
    vocab = vocabulary(counts)
    rows = save(sequences(docs, vocab, id, text), "sequences")
    share = (vocab.class_tokens + 0.5) / (vocab.class_tokens + 0.5).sum()
    model = train(rows.filter(~F.col("held_out")), share)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, LANES):
                part = batch.slice(k, LANES)
                texts = [np.frombuffer(x.as_py(), "<u2").astype(np.int64) for x in part.column(part.num_columns - 1)]
                values = pa.array(shared.value.log10_likelihood(texts))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], values], names=[*part.schema.names[:-1], "path"])

    kept = rows.drop("rare", "rare_n")
    kept = kept.select(*[c for c in kept.columns if c != "classes"], "classes")
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema if f.name != "classes"), "path double"])
    walked = kept.mapInArrow(run, schema)

    rare = rows.select("row", F.explode(F.arrays_zip("rare", "rare_n")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.rare_n").alias("n"))
    found = rare.join(counts, "word", "left").groupBy("row").agg(
        F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 1)).alias("rare_sum"),
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("rare_known"),
    )
    zero = F.lit(0)
    both = walked.join(found, "row", "left")
    rare_sum = F.coalesce("rare_sum", F.lit(0.0))
    room = float(np.log10(vocab.total + vocab.distinct + 1))
    return both.select(
        F.col("id").alias(id),
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", zero)).alias("n_known"),
        F.lit(vocab.total).cast("long").alias("train_tokens"),
        (F.col("known_sum") + rare_sum - F.col("n_tokens") * room).alias("base_score"),
        (F.col("path") + F.col("inner_sum") + rare_sum - F.col("size_sum")).alias("score"),
    )


def hmm_scores(docs: DataFrame) -> DataFrame:
    """op8: base and model scores of every document."""
    return score(docs)
