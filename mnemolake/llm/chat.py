"""Chat formatting on the level of token ids.

Each segment of a turn is encoded by itself, so no token spans a mark and its text. Marks are reserved ids behind the
vocabulary, spliced between the segments; no text can produce them. In the formatted text a mark is its control string,
and control strings inside texts are escaped, so that the text can be read back without the ids as well. A turn is

    user         <s>[INST] text [/INST]             (marks: open, close)
    system       <<SYS>> text <</SYS>>
    assistant    text </s>
    other roles  [ROLE] role [/ROLE] text </s>

without the spaces. Loss is taken on the texts of assistant turns; masks are prefix sums over +1 where such a text
begins and -1 where it ends.

A conversation is written as parts: its turns are cut into slices of SLICE numbers of ``turn``, and a slice into rows of
at most ROW tokens (a turn's text may go on in the next row). A long conversation is therefore many tasks' work when it
is formatted. Digests over a whole conversation, as op13 returns them, are sequential by their definition: they read the
parts of a conversation in order, as a stream of one task, which holds one row at a time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import save
from .bpe import chunks, codec, decoder

#: Control strings in the order of their reserved ids.
MARKS = ["<s>[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "</s>", "[ROLE]", "[/ROLE]"]
OPEN_USER, CLOSE_USER, OPEN_SYSTEM, CLOSE_SYSTEM, END, OPEN_ROLE, CLOSE_ROLE = range(len(MARKS))
#: What texts must not hold as it is: the marks and the parts of the first one.
CONTROL = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]"]
ESCAPE = "\\"
_HIT = re.compile("(" + "|".join(f"{re.escape(c[0])}(?={re.escape(ESCAPE)}*{re.escape(c[1:])})" for c in CONTROL) + ")")
_UNDO = re.compile(
    "(" + "|".join(f"{re.escape(c[0])}(?={re.escape(ESCAPE)}+{re.escape(c[1:])})" for c in CONTROL) + ")" + re.escape(ESCAPE)
)

#: Turn numbers of one slice, and tokens of one row of the output.
SLICE = 1024
ROW = 1 << 16

#: One more conversation of the registered query: control strings as text.
PROBE = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def escape(text: str) -> str:
    """One more escape sign after the first character of every control string, escaped ones included."""
    return _HIT.sub(r"\1" + ESCAPE * 2, text)


def unescape(text: str) -> str:
    """The text that ``escape`` got."""
    return _UNDO.sub(r"\1", text)


def _layout(role: str) -> list[int | str]:
    """Marks and segments of a turn: a number is a mark, ``text`` and ``role`` are segments, ``loss`` is learnt text."""
    if role == "user":
        return [OPEN_USER, "text", CLOSE_USER]
    if role == "system":
        return [OPEN_SYSTEM, "text", CLOSE_SYSTEM]
    if role == "assistant":
        return ["loss", END]
    return [OPEN_ROLE, "role", CLOSE_ROLE, "text", END]


def _assemble(roles: list[str], texts: list[str], encode, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, loss mask, first id of each turn) of some turns; ``encode`` gives the id arrays of a list of texts."""
    layouts = [_layout(r) for r in roles]
    wanted = [r if part == "role" else t for r, t, lay in zip(roles, texts, layouts, strict=True) for part in lay if isinstance(part, str)]
    coded = iter(encode([escape(t) for t in wanted]))
    pieces, learnt, turn_of = [], [], []
    for k, lay in enumerate(layouts):
        for part in lay:
            pieces.append(next(coded) if isinstance(part, str) else np.array([base + part]))
            learnt.append(part == "loss")
            turn_of.append(k)
    sizes = np.array([len(p) for p in pieces], dtype=np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    steps = np.zeros(int(sizes.sum()) + 1, dtype=np.int64)
    on = np.array(learnt, dtype=bool)
    np.add.at(steps, starts[on], 1)
    np.add.at(steps, ends[on], -1)
    ids = np.concatenate(pieces) if pieces else np.empty(0, dtype=np.int64)
    firsts = starts[np.searchsorted(turn_of, np.arange(len(roles)))] if len(roles) else np.empty(0, dtype=np.int64)
    return ids.astype("<u4"), np.cumsum(steps)[:-1].astype(np.uint8), np.r_[firsts, len(ids)]


def format_chats(turns: DataFrame, path: str, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Parts of formatted conversations: (id, slice, part, ids, loss_mask), in the order (id, slice, part).

    ``ids`` are little-endian unsigned 32-bit token ids and ``loss_mask`` one byte per id. Null texts and roles count as
    empty; a role other than user, system and assistant is written out in its turn. Turns go by number, null last, ties
    by role, then by a digest of the text; repeated rows are repeated turns. A null id is a conversation of its own. An empty table has no
    parts. Other columns are not read.
    """
    number = F.col(turn).cast("long")
    rows = turns.select(
        F.col(id).alias("id"),
        F.coalesce(F.floor(number / SLICE), F.lit((1 << 62))).alias("slice"),
        number.alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    kind = rows.schema["id"].dataType
    id_type = to_arrow_type(kind)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        base = len(c.bytes_of)

        def encode(texts: list[str]) -> list[np.ndarray]:
            return [c.ids(raw).astype(np.int64) for raw in c.encode(texts)]

        for batch in batches:
            for first, texts in chunks(batch.column(4)):
                part = batch.slice(first, len(texts))
                roles = part.column(3).to_pylist()
                ids, mask, bounds = _assemble(roles, texts, encode, base)
                spans = list(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))
                data = [
                    *(part.column(i) for i in range(3)),
                    pa.array([hashlib.sha256(t.encode()).digest() for t in texts], pa.binary()),
                    part.column(3),
                    pa.array([ids[a:b].tobytes() for a, b in spans], pa.binary()),
                    pa.array([mask[a:b].tobytes() for a, b in spans], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(data, names=["id", "slice", "turn", "tie", "role", "ids", "mask"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Turns, in order, as rows of at most ROW tokens."""
        state: dict = {"key": None, "part": 0, "ids": [], "mask": [], "n": 0}

        def row(ids: bytes, mask: bytes) -> pa.RecordBatch:
            conv, piece = state["key"]
            data = [pa.array([conv], id_type), pa.array([piece], pa.int64()), pa.array([state["part"]], pa.int64()),
                    pa.array([ids], pa.binary()), pa.array([mask], pa.binary())]
            state["part"] += 1
            return pa.RecordBatch.from_arrays(data, names=["id", "slice", "part", "ids", "loss_mask"])

        def flush(whole: bool) -> Iterator[pa.RecordBatch]:
            ids, mask = b"".join(state["ids"]), b"".join(state["mask"])
            while len(mask) >= ROW or (whole and mask):
                yield row(ids[: 4 * ROW], mask[:ROW])
                ids, mask = ids[4 * ROW :], mask[ROW:]
            state["ids"], state["mask"], state["n"] = [ids], [mask], len(mask)

        for batch in batches:
            for conv, piece, ids, mask in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if state["key"] != (conv, piece):
                    if state["key"] is not None:
                        yield from flush(True)
                    state["key"], state["part"] = (conv, piece), 0
                state["ids"].append(ids)
                state["mask"].append(mask)
                state["n"] += len(mask)
                if state["n"] >= ROW:
                    yield from flush(False)
        if state["key"] is not None:
            yield from flush(True)

    name = kind.simpleString()
    tokens = rows.mapInArrow(encoded, f"id {name}, slice long, turn long, tie binary, role string, ids binary, mask binary")
    dealt = tokens.repartition("id", "slice").sortWithinPartitions("id", "slice", F.col("turn").asc_nulls_last(), "role", "tie")
    parts = dealt.select("id", "slice", "ids", "mask").mapInArrow(
        joined, f"id {name}, slice long, part long, ids binary, loss_mask binary"
    )
    return parts.withColumnRenamed("id", id)


class _Reader:
    """Reads the turns of one conversation back from its rows, in order, and keeps digests only."""

    def __init__(self, bytes_of: list[bytes]):
        self.bytes_of, self.base = bytes_of, len(bytes_of)
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.formatted = 0
        self.role: str | None = None
        self.held: list[bytes] = []
        self.learnt: list[bytes] = []

    def read(self, ids: np.ndarray, mask: np.ndarray) -> None:
        marks = np.flatnonzero(ids >= self.base)
        at = 0
        for m in [*marks.tolist(), len(ids)]:
            if m > at:
                edges = np.flatnonzero(np.diff(mask[at:m])) + 1
                for a, b in zip([at, *(edges + at).tolist()], [*(edges + at).tolist(), m], strict=True):
                    raw = b"".join(map(self.bytes_of.__getitem__, ids[a:b].tolist()))
                    self.held.append(raw)
                    if mask[a]:
                        self.learnt.append(raw)
            if m < len(ids):
                self._mark(int(ids[m]) - self.base)
            at = m + 1

    def _mark(self, mark: int) -> None:
        text = b"".join(self.held).decode()
        self.held = []
        self.formatted += len(text) + len(MARKS[mark])
        if mark in (CLOSE_USER, CLOSE_SYSTEM, END):
            role = {CLOSE_USER: "user", CLOSE_SYSTEM: "system"}.get(mark, "assistant" if self.role is None else self.role)
            self.turns.update(f"{role}\n{unescape(text)}\n".encode())
            self.n_turns += 1
            self.role = None
            learnt = unescape(b"".join(self.learnt).decode())
            self.learnt = []
            self.loss.update(learnt.encode())
            self.loss_chars += len(learnt)
        elif mark == CLOSE_ROLE:
            self.role = unescape(text)

    def row(self) -> tuple[int, str, int, str, int]:
        return self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.formatted


READ_BACK = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(parts: DataFrame, path: str, id: str = "conv_id") -> DataFrame:
    """Per conversation what its formatted parts hold: turns and learnt text, unescaped, as counts and digests."""
    kind = parts.schema[id].dataType
    id_type = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bytes_of = decoder(path, False)
        current, reader, done = None, None, []

        def table() -> pa.RecordBatch:
            cols = list(zip(*done, strict=True))
            kinds = [id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            done.clear()
            names = ["id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds, strict=True)], names=names)

        for batch in batches:
            for i in range(batch.num_rows):
                conv, ids, mask = (batch.column(k)[i].as_py() for k in range(3))
                if reader is None or conv != current:
                    if reader is not None:
                        done.append((current, *reader.row()))
                    current, reader = conv, _Reader(bytes_of)
                reader.read(np.frombuffer(ids, dtype="<u4"), np.frombuffer(mask, dtype=np.uint8).astype(np.int8))
            if len(done) >= 1000:
                yield table()
        if reader is not None:
            done.append((current, *reader.row()))
        if done:
            yield table()

    ordered = parts.withColumnRenamed(id, "id").repartition("id").sortWithinPartitions("id", "slice", "part")
    found = ordered.select("id", "ids", "loss_mask").mapInArrow(run, f"id {kind.simpleString()}, {READ_BACK}")
    return found.withColumnRenamed("id", id)


def chat_formatting(turns: DataFrame, path: str) -> DataFrame:
    """op13: all conversations and the probe, formatted, written, and read back."""
    kinds = {c: turns.schema[c].dataType.simpleString() for c in ("conv_id", "turn", "role", "text")}
    probe = turns.sparkSession.createDataFrame(PROBE, "conv_id long, turn long, role string, text string")
    cast = [F.col(c).cast(k).alias(c) for c, k in kinds.items()]
    parts = save(format_chats(turns.select(*kinds).unionByName(probe.select(*cast)), path), "chats")
    return read_back(parts, path)


CHAT_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
sized AS (
  SELECT *, length(regexp_replace(text, '(<|\[)(\\*)(s>|/s>|<SYS>>|</SYS>>|INST\]|/INST\]|ROLE\]|/ROLE\])', '\1\2#\3', 'g')) AS n,
    length(regexp_replace(role, '(<|\[)(\\*)(s>|/s>|<SYS>>|</SYS>>|INST\]|/INST\]|ROLE\]|/ROLE\])', '\1\2#\3', 'g')) AS r FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(n + CASE role WHEN 'user' THEN 16 WHEN 'system' THEN 15 WHEN 'assistant' THEN 4 ELSE 17 + r END)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""
