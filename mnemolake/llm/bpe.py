"""Byte-level BPE encoding and decoding over Arrow batches.

The tokenizers library encodes every distinct word once per worker; texts are put together from the ids of their
words. That is exact: a single space or line end between two characters that are not white space always starts a new
match of the splitting pattern, so no token spans it. A text in which white space touches white space, or which starts
or ends with it, is encoded as it is.
"""

from __future__ import annotations

import base64
import json
import os
import re
import string
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_text

#: Words kept per worker before the cache starts anew. Memory only; results do not depend on it.
CACHE_WORDS = 400_000
#: Bytes of text handled at once within a worker.
CHUNK_BYTES = 1 << 20
_TOUCHING = re.compile(r"\s\s|^\s|\s\Z")


def byte_alphabet() -> dict[int, str]:
    """Byte -> printable character: printable bytes stand for themselves, the rest for characters from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


def _merges(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """The pair that each token of two bytes or more is merged from, in rank order."""
    out = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            at = [ranks.get(a + b, rank) for a, b in zip(parts, parts[1:], strict=False)]
            low = min(at)
            if low >= rank:
                break
            i = at.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        if len(parts) == 2:
            out.append((parts[0], parts[1]))
    return out


def _from_ranks(path: str, pattern: str):
    """A tokenizer of the tokenizers library from a file of ranks (base64 of a token, its rank)."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    chars = byte_alphabet()

    def spell(token: bytes) -> str:
        return "".join(map(chars.__getitem__, token))

    vocab = {spell(t): r for t, r in ranks.items()}
    merges = [(spell(a), spell(b)) for a, b in _merges(ranks)]
    tok = Tokenizer(models.BPE(vocab=vocab, merges=merges, ignore_merges=True))
    tok.pre_tokenizer = pre_tokenizers.Sequence(
        [
            pre_tokenizers.Split(Regex(pattern), "isolated"),
            pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
        ]
    )
    return tok


def _from_json(path: str):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True  # their strings in a text are ordinary text
    return tok


def token_bytes(vocab: dict[str, int]) -> list[bytes]:
    """Bytes of each id: the byte alphabet reversed; tokens outside it, as special ones, by their UTF-8."""
    byte_of = {c: b for b, c in byte_alphabet().items()}
    out = [b""] * (max(vocab.values(), default=-1) + 1)
    for token, i in vocab.items():
        known = all(c in byte_of for c in token)
        out[i] = bytes(map(byte_of.__getitem__, token)) if known else token.encode()
    return out


class Codec:
    """One vocabulary: text -> ids -> bytes. ``ids`` are little-endian arrays of ``dtype``."""

    def __init__(self, path: str, pattern: str | None = None):
        tok = _from_ranks(path, pattern) if pattern else _from_json(path)
        self.tok = tok
        self.bytes_of = token_bytes(tok.get_vocab())
        size = len(self.bytes_of)
        self.n_bytes = np.array([len(b) for b in self.bytes_of], dtype=np.int64)
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.words: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = self.tok.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype=self.dtype).tobytes() for e in found]

    def _learn(self, new: list[str]) -> None:
        """Encode words, many to a call; token lengths in bytes show where each word ends.

        Marks after a letter are a match of their own, so a word and the same word with a comma are learnt once.
        """
        stems = {w: stem for w in new if (stem := w.rstrip(string.punctuation)) != w and stem[-1:].isalpha()}
        plain = {w for w in new if w not in stems}
        plain.update(stem for stem in stems.values() if stem not in self.words)
        part: list[str] = []
        for k, w in enumerate(plain, 1):
            part.append(w)
            if len(part) == 2000 or k == len(plain):
                self._learn_plain(part)
                part = []
        tails = {w[len(stem) :] for w, stem in stems.items()}.difference(self.tails)
        self.tails.update(zip(tails, self._whole(list(tails)), strict=True))
        for w, stem in stems.items():
            self.words[w] = self.words[stem] + self.tails[w[len(stem) :]]

    def _learn_plain(self, part: list[str]) -> None:
        wide = self.dtype.itemsize
        # A word stands after a space, or after a line end if it starts with one; one at the start of a text is
        # learnt after a line end, whose single id is then cut off.
        forms = [w if w[0] == "\n" else "\n" + w[1:] if w[0] == "\r" else " " + w for w in part]
        ids = np.array(self.tok.encode_batch_fast(["".join(forms)], add_special_tokens=False)[0].ids, dtype=self.dtype)
        ends = np.cumsum(self.n_bytes[ids])
        stops = np.fromiter(accumulate(len(w.encode()) for w in forms), dtype=np.int64, count=len(forms))
        cuts = np.searchsorted(ends, stops) + 1
        flat, at = ids.tobytes(), 0
        for word, cut in zip(part, (cuts * wide).tolist(), strict=True):
            self.words[word] = flat[at + wide : cut] if word[0] == "\r" else flat[at:cut]
            at = cut

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as bytes of ``dtype``."""
        def parts(t: str) -> list[str] | None:
            if not t:
                return []
            # The first test is the cheaper one; it also fails for lone white space of other kinds.
            if " ".join(t.split()) != t.replace("\n", " ") and _TOUCHING.search(t):
                return None
            return ("\r" + t.replace("\n", " \n")).split(" ")

        # "\r" marks the first word of a text; no other word of a text split here starts with white space but "\n".
        split = [parts(t) for t in texts]
        if len(self.words) > CACHE_WORDS:
            self.words.clear()
        new: set[str] = set()
        for w in split:
            if w:
                new.update(set(w).difference(self.words))
        self._learn(list(new))
        rest = iter(self._whole([t for t, w in zip(texts, split, strict=True) if w is None]))
        ids_of = self.words.__getitem__
        return [next(rest) if w is None else b"".join(map(ids_of, w)) for w in split]

    def ids(self, raw: bytes) -> np.ndarray:
        return np.frombuffer(raw, dtype=self.dtype)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids: the byte table reversed. A character split over tokens is whole again."""
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))

    def offsets(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Start and end character of each token, and the number of tokens that start within a character.

        A token that holds part of a character covers that character, so neighbours can overlap by one.
        """
        raw = np.frombuffer(text.encode(), dtype=np.uint8)
        head = (raw & 0xC0) != 0x80
        char_of = np.cumsum(head) - 1
        ends = np.cumsum(self.n_bytes[ids])
        starts = ends - self.n_bytes[ids]
        if not len(ids):
            return starts, ends, 0
        return char_of[starts], char_of[ends - 1] + 1, int((~head[starts]).sum())


@lru_cache(maxsize=2)
def codec(path: str, pattern: str | None = None) -> Codec:
    """One per worker process; its word cache lives as long as the worker. Spark has the parallelism, not the library."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Codec(path, pattern)


@lru_cache(maxsize=2)
def decoder(path: str, ranks: bool) -> list[bytes]:
    """Bytes of each id, read from the vocabulary alone: a worker that decodes loads no tokenizer."""
    if ranks:
        chars = byte_alphabet()
        with open(path, "rb") as f:
            pairs = (line.split() for line in f)
            return token_bytes({"".join(map(chars.__getitem__, base64.b64decode(a))): int(b) for a, b in pairs})
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    return token_bytes({**spec["model"]["vocab"], **{t["content"]: t["id"] for t in spec.get("added_tokens", [])}})


def chunks(texts: pa.ChunkedArray | pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts): runs of about ``limit`` bytes, always whole texts."""
    part, size, first = [], 0, 0
    for i, t in enumerate(texts):
        text = t.as_py()
        part.append(text)
        size += len(text)
        if size >= limit:
            yield first, part
            part, size, first = [], 0, i + 1
    if part:
        yield first, part


def encode(
    docs: DataFrame, path: str, pattern: str | None = None, id: str = "doc_id", text: str = "text", offsets: bool = True
) -> DataFrame:
    """(id, n_tokens, ids, starts, ends, n_split): ids, starts and ends as little-endian unsigned 32-bit integers.

    ``starts`` and ``ends`` are character offsets of the tokens; ``n_split`` counts tokens that start within a
    character. A null or empty text has no tokens. One row per row of ``docs``, repeated ids included; other columns
    are not read. ``pattern`` is given for a file of ranks, none for a file of the tokenizers library. Without
    ``offsets`` the columns starts and ends are left out.
    """
    parts = ["n_tokens", "ids", "starts", "ends", "n_split"] if offsets else ["n_tokens", "ids", "n_split"]
    kinds = {"n_tokens": pa.int64(), "n_split": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            for first, texts in chunks(batch.column(1)):
                cols: dict[str, list] = {k: [] for k in parts}
                for t, raw in zip(texts, c.encode(texts), strict=True):
                    ids = c.ids(raw)
                    starts, ends, split = c.offsets(t, ids)
                    row = {"n_tokens": len(ids), "ids": ids, "starts": starts, "ends": ends, "n_split": split}
                    for k, col in cols.items():
                        col.append(row[k] if k in kinds else row[k].astype("<u4").tobytes())
                data = [pa.array(col, kinds.get(k, pa.binary())) for k, col in cols.items()]
                keys = batch.column(0).slice(first, len(texts))
                yield pa.RecordBatch.from_arrays([keys, *data], names=["id", *parts])

    rows = docs.select(F.col(id).alias("id"), whole_text(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = ", ".join([f"id {kind}", *(f"{k} {'long' if k in kinds else 'binary'}" for k in parts)])
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id)


def decode(tokens: DataFrame, path: str, pattern: str | None = None, ids: str = "ids") -> DataFrame:
    """``tokens`` with decoded binary, and text in which bytes that are not UTF-8 become U+FFFD.

    A null ``ids`` decodes to nothing. Input columns named decoded or text are replaced.
    """
    bare = tokens.drop("decoded", "text")
    names = bare.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bytes_of = decoder(path, pattern is not None).__getitem__
        for batch in batches:
            at = batch.schema.get_field_index(ids)
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                raw = [b"".join(map(bytes_of, np.frombuffer(x.as_py() or b"", dtype="<u4").tolist())) for x in part.column(at)]
                text = [x.decode("utf-8", "replace") for x in raw]
                data = [*part.columns, pa.array(raw, pa.binary()), pa.array(text, pa.string())]
                yield pa.RecordBatch.from_arrays(data, names=[*names, "decoded", "text"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in bare.schema), "decoded binary, text string"])
    return bare.mapInArrow(run, schema)


def bpe_round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """op2: ids of every text and the bytes they decode to, as digests."""
    tokens = encode(docs, path, pattern, offsets=False)
    return decode(tokens, path, pattern).select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        "n_split",
    )
