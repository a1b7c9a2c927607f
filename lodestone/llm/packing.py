"""Harmonic packing of tokenised documents into sequences of a fixed capacity.

Lengths belong to reciprocal-capacity classes: class j holds pieces of exactly
C // j tokens, and a bin of class j is full with j of them. A document is cut
greedily into the largest class length that it still holds, until at most
``TAIL`` tokens are left; that tail joins the class of its own length. Full bins
leave C mod j tokens of padding. Each worker fills its own bins, with no shuffle.
What is left in unfilled bins at a worker's end is laid end to end into full
sequences, and the last one into powers of two, which are not padded.

Token ids come from a public tokenizer file. A text is cut where the tokenizer
cuts it anyway (white space; an ASCII letter next to ASCII punctuation), each
distinct piece is tokenised once, and ids are gathered by piece.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import LOWER, U64, WHITE, buffer, chunks, hashes, mapped, spans

CAPACITY = 4096
TAIL = 64
#: Distinct pieces of text whose ids a worker keeps between batches.
CACHE = 300_000

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_PUNCT = np.zeros(256, dtype=bool)
_PUNCT[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "'<|>"]] = True


def pieces(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of pieces that are tokenised apart, and each document's first piece.

    A word (no white space) is cut between an ASCII letter and ASCII punctuation, but for
    the apostrophe (of contractions) and the characters of special tokens, whose words stay whole."""
    starts, ends, first = spans(~WHITE[raw], offs)
    if not len(starts):
        return starts, ends, first
    letter, punct = _LETTER[raw], _PUNCT[raw]
    turn = np.zeros(len(raw) + 1, dtype=bool)
    turn[1:-1] = (letter[:-1] & punct[1:]) | (punct[:-1] & letter[1:])
    odd = np.concatenate(([0], np.cumsum((raw == 0x27) | (raw == 0x3C) | (raw == 0x7C) | (raw == 0x3E))))
    whole = odd[ends] > odd[starts]
    held = np.zeros(len(raw) + 1, dtype=np.int32)
    np.add.at(held, starts[whole], 1)
    np.add.at(held, ends[whole], -1)
    turn &= np.cumsum(held) == 0
    turn[starts] = turn[ends] = False
    at = np.flatnonzero(turn)
    s, e = np.sort(np.concatenate((starts, at))), np.sort(np.concatenate((ends, at)))
    return s, e, np.searchsorted(s, offs)


def by_pieces(path: str) -> bool:
    """Whether a tokenizer of this file lower-cases and drops white space between words, as
    tokenising by :func:`pieces` needs; any other gets whole texts."""
    with open(path, encoding="utf-8") as f:
        rules = json.load(f)
    normal, split = (x or {} for x in (rules.get("normalizer"), rules.get("pre_tokenizer")))
    normal, split = normal.get("normalizers", [normal]), split.get("pretokenizers", [split])
    allowed = {"NFC", "Replace", "Lowercase"}
    words = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    first = split[0]
    drops = first.get("type") == "Split" and first.get("pattern") == {"Regex": words} and first.get("behavior") == "Removed" and first.get("invert")
    blanks = all(n.get("pattern") == {"Regex": r"\s+"} and n.get("content") == " " for n in normal if n.get("type") == "Replace")
    return bool(drops and blanks and {n.get("type") for n in normal} <= allowed and any(n.get("type") == "Lowercase" for n in normal))


class Encoder:
    """Ids of whole texts. Where the tokenizer's rules allow it (:func:`by_pieces`), distinct
    pieces are tokenised once and their ids are kept; otherwise texts are tokenised whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.t = Tokenizer.from_file(path)
        self.whole = not by_pieces(path)
        # Runs of a-z need neither normaliser nor splitting; each ends in the one id that closes a word.
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = None
        self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocab = self.t.get_vocab()
        self.closes = np.zeros(max(vocab.values(), default=0) + 1, dtype=bool)
        self.closes[[i for w, i in vocab.items() if w.endswith("</w>")]] = True
        self.key = np.zeros(0, dtype=U64)
        self.start = np.zeros(0, dtype=np.int64)
        self.size = np.zeros(0, dtype=np.int64)
        self.flat = np.zeros(0, dtype=np.int64)
        mark = self._ids("\x01")
        self.mark = mark[0] if len(mark) == 1 else None

    def _ids(self, text: str) -> list[int]:
        return self.t.encode(text, add_special_tokens=False).ids

    def _learn(self, keys: np.ndarray, texts: list[str]) -> None:
        if len(self.key) + len(keys) > CACHE:
            self.key, self.start, self.size, self.flat = keys[:0], self.start[:0], self.size[:0], self.flat[:0]
        flat: list[np.ndarray] = []
        size = np.zeros(len(texts), dtype=np.int64)
        letters = [i for i, x in enumerate(texts) if x.isascii() and x.isalpha()]
        alone = []
        for a in range(0, len(letters), 1024):
            part = letters[a : a + 1024]
            got = np.array(self.plain.encode_batch_fast([" ".join(texts[i] for i in part).lower()], add_special_tokens=False)[0].ids, dtype=np.int64)
            ends = np.flatnonzero(self.closes[got]) + 1
            if len(ends) == len(part) and ends[-1] == len(got):
                size[part] = np.diff(ends, prepend=0)
                flat.append(got)
            else:  # a vocabulary without such ids
                alone += part
        letters = [i for i in letters if size[i]]
        rest = sorted({*range(len(texts))} - {*letters} - {*alone})
        mixed = [i for i in rest if self.mark is not None and "\x01" not in texts[i]]
        for a in range(0, len(mixed), 64):
            part = mixed[a : a + 64]
            got = np.array(self.t.encode_batch_fast([" \x01 ".join(texts[i] for i in part)], add_special_tokens=False)[0].ids, dtype=np.int64)
            cut = np.flatnonzero(got == self.mark)
            if len(cut) != len(part) - 1:  # the mark met its own kind: one by one
                each = [np.array(self._ids(texts[i]), dtype=np.int64) for i in part]
            else:
                each = np.split(got, cut)
                each = [each[0], *(x[1:] for x in each[1:])]
            size[part] = [len(x) for x in each]
            flat += each
        odd = sorted({*rest, *alone} - {*mixed})
        for i in odd:
            x = np.array(self._ids(texts[i]), dtype=np.int64)
            size[i] = len(x)
            flat.append(x)
        order = np.array([*letters, *mixed, *odd], dtype=np.int64)
        start = np.zeros(len(texts), dtype=np.int64)
        start[order] = np.cumsum(size[order]) - size[order] + len(self.flat)
        self.flat = np.concatenate((self.flat, *flat))
        key = np.concatenate((self.key, keys))
        by = np.argsort(key, kind="stable")
        self.key, self.start, self.size = key[by], np.concatenate((self.start, start))[by], np.concatenate((self.size, size))[by]

    def _find(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.key, u)
        if not len(self.key):
            return at, np.zeros(len(u), dtype=bool)
        at = np.minimum(at, len(self.key) - 1)
        return at, self.key[at] == u

    def encode(self, raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the documents of a buffer, and the documents' offsets in them."""
        if self.whole:
            data = raw.tobytes()
            found = self.t.encode_batch_fast([data[a:b].decode("utf-8", "replace") for a, b in zip(offs[:-1], offs[1:], strict=True)], add_special_tokens=False)
            each = [np.array(x.ids, dtype=np.int64) for x in found]
            return np.concatenate([np.zeros(0, dtype=np.int64), *each]), np.concatenate(([0], np.cumsum([len(x) for x in each]))).astype(np.int64)
        s, e, first = pieces(raw, offs)
        if not len(s):
            return np.zeros(0, dtype=np.int64), np.zeros(len(offs), dtype=np.int64)
        h = hashes(LOWER[raw], s, e)
        u, one, inverse = np.unique(h, return_index=True, return_inverse=True)
        at, known = self._find(u)
        if not known.all():
            new = one[~known]
            data = raw.tobytes()
            self._learn(u[~known], [data[a:b].decode("utf-8", "replace") for a, b in zip(s[new], e[new], strict=True)])
            at, known = self._find(u)
            if not known.all():  # the cache was emptied: what it held before is learned again
                new = one[~known]
                self._learn(u[~known], [data[a:b].decode("utf-8", "replace") for a, b in zip(s[new], e[new], strict=True)])
                at, known = self._find(u)
        size = self.size[at][inverse]
        done = np.concatenate(([0], np.cumsum(size)))
        ids = self.flat[np.arange(done[-1]) + np.repeat(self.start[at][inverse] - done[:-1], size)]
        return ids, done[first]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def cuts(n: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of a document's pieces: class lengths from the largest down, then the tail."""
    out = [capacity] * (n // capacity)
    n %= capacity
    while n > TAIL:
        out.append(capacity // -(-capacity // n))
        n -= out[-1]
    return [*out, n] if n else out


class Bins:
    """The open bins of one worker. A piece is (key, start, ids, the document's number of ids);
    what is held are the ids of pieces in open bins alone, a few thousand for each class."""

    def __init__(self, worker: int, capacity: int = CAPACITY):
        self.capacity, self.next = capacity, worker << 32
        self.open: dict[int, list[tuple]] = {}
        self.done: list[tuple] = []

    def _close(self, parts: list[tuple]) -> None:
        offset = 0
        for key, start, ids, total in parts:
            self.done.append((key, start, len(ids), zlib.crc32(ids), total, self.next, offset))
            offset += len(ids)
        self.next += 1

    def add(self, key: object, ids: np.ndarray) -> None:
        start = 0
        for length in cuts(len(ids), self.capacity):
            # By length, so that a bin of class j holds pieces of one length and is full with j of them.
            bin_ = self.open.setdefault(length, [])
            bin_.append((key, start, ids[start : start + length].copy(), len(ids)))
            if len(bin_) == self.capacity // length:
                self._close(bin_)
                del self.open[length]
            start += length

    def end(self) -> None:
        """Lays what is in unfilled bins end to end: full sequences, then powers of two."""
        rest = [p for length in sorted(self.open, reverse=True) for p in self.open[length]]
        self.open, left = {}, sum(len(p[2]) for p in rest)
        at, used = 0, 0
        while left:
            room = self.capacity if left >= self.capacity else 1 << (left.bit_length() - 1)
            left -= room
            parts = []
            while room:
                key, start, ids, total = rest[at]
                take = min(room, len(ids) - used)
                parts.append((key, start + used, ids[used : used + take], total))
                room, used = room - take, used + take
                if used == len(ids):
                    at, used = at + 1, 0
            self._close(parts)


def pack(docs: DataFrame, tokenizer: str, *, key: str = "doc_id", text: str = "text", end_id: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """One row for each piece: the key, ``start`` and ``length`` (in the document's ids),
    ``ids_crc32`` (of the ids as little-endian unsigned 32-bit numbers), ``doc_tokens``,
    ``sequence_id`` and ``offset`` (gapless from 0 in its sequence).

    ``tokenizer``: the path of a tokenizer file that executors can read. A document is
    its ids, then ``end_id``; null and empty texts are that id alone. Each id lies in
    one piece. Repeated rows are packed each for itself; an empty table gives an empty
    result; other columns are not read. Sequence ids hold the worker's partition in their
    upper bits, and a task that is run again gives the same rows.
    """
    inner = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    schema = T.StructType([inner.schema["k"]])
    for name in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"):
        schema = schema.add(name, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = Bins(TaskContext.get().partitionId(), capacity)

        def out() -> pa.RecordBatch:
            columns = zip(*bins.done, strict=True)
            bins.done = []
            return pa.RecordBatch.from_arrays([pa.array(next(columns), key_type), *(pa.array(x, pa.int64()) for x in columns)], names=schema.names)

        for b in batches:
            key_type = b.schema.field(0).type
            raw, offs = buffer(b.column("t"))
            keys = b.column("k").to_pylist()
            for lo, hi in chunks(offs):
                ids, at = encoder(tokenizer).encode(raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                ids = ids.astype("<u4")
                for i in range(hi - lo):
                    bins.add(keys[lo + i], np.append(ids[at[i] : at[i + 1]], np.uint32(end_id)).astype("<u4"))
                if bins.done:
                    yield out()
        bins.end()
        if bins.done:
            yield out()

    # A key named like a result gives way to it.
    return mapped(inner, run, schema).select(*[F.col(n).alias(key if n == "k" else n) for n in schema.names if n != "k" or key not in schema.names[1:]])
