"""Language identification by cross-parsing entropy.

For each language a suffix automaton of a bounded sample of labelled text is
built. A text is parsed from left to right into the longest phrases that the
sample holds; the language that needs the fewest phrases, each charged with the
logarithm of the sample's length, wins. The phrase that a mismatch ends is
followed by one that starts with the mismatching byte.

The automaton runs over bytes folded to letter classes: a-z (A-Z folded), each
byte above 0x7F, and one class for everything else. Runs of that last class
count once. A text is cut into blocks of ``BLOCK`` bytes which are parsed side by
side, so that the walk is a few vector operations for each of ``BLOCK`` steps
whatever the lengths of the texts; every byte of every text takes part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import LOWER, buffer, chunks, free_names, mapped, written

BLOCK = 256
#: A letter, by Unicode.
LETTER = r"\p{L}"
#: Classes: 0 ends a block, 1 is no letter, then a-z, then the bytes from 0x80.
_CLASS = np.ones(256, dtype=np.uint8)
_CLASS[97:123] = np.arange(2, 28)
_CLASS[128:] = np.arange(28, 156)
_WIDTH = 156


def letters(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all bytes, runs of non-letters counted once, and the new offsets."""
    c = _CLASS[LOWER[raw]]
    keep = c != 1
    keep[1:] |= c[:-1] != 1
    return c[keep], np.concatenate(([0], np.cumsum(keep)))[offs]


def automaton(s: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Edges (state, class, target) of the suffix automaton of ``s`` and its number of states."""
    nexts: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in s:
        cur = len(nexts)
        nexts.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in nexts[p]:
            nexts[p][c] = cur
            p = link[p]
        if p != -1:
            q = nexts[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nexts)
                nexts.append(dict(nexts[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and nexts[p].get(c) == q:
                    nexts[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    state = np.repeat(np.arange(len(nexts), dtype=np.int32), [len(x) for x in nexts])
    return state, np.array([c for x in nexts for c in x], dtype=np.uint8), np.array([t for x in nexts for t in x.values()], dtype=np.int32), len(nexts)


@dataclass
class Model:
    """Per language the edges of its automaton and the bits that a phrase costs."""

    langs: list[str]
    edges: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]]
    bits: list[float]
    _tables: list[np.ndarray] = field(default_factory=list, repr=False)
    _fold: np.ndarray | None = field(default=None, repr=False)
    _width: int = 0

    def tables(self) -> list[np.ndarray]:
        """Dense steps: 2 * target, plus 1 where the step starts a new phrase."""
        if not self._tables and self.langs:
            used = np.unique(np.concatenate([e[1] for e in self.edges]))
            self._fold = np.ones(_WIDTH, dtype=np.int32)  # classes that no sample holds are the class 1
            self._fold[0] = 0
            self._fold[used] = np.arange(2, 2 + len(used))
            self._width = 2 + len(used)
            for state, c, target, n in self.edges:
                start = np.ones(self._width, dtype=np.int32)  # an unknown class is a phrase of its own
                start[0] = 0
                at_root = state == 0
                start[self._fold[c[at_root]]] = 2 * target[at_root] + 1
                table = np.tile(start, (n, 1))
                table[:, 0] = 0
                table[state, self._fold[c]] = 2 * target
                table[0] = start
                self._tables.append(table.ravel())
        return self._tables

    def phrases(self, raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrases that each language needs for each text, and the texts' classes."""
        c, offs = letters(raw, offs)
        n = np.diff(offs)
        out = np.zeros((len(n), len(self.langs)), dtype=np.int64)
        tables = self.tables()
        if not len(c) or not tables:
            return out, n
        blocks = -(-n // BLOCK)
        doc = np.repeat(np.arange(len(n)), blocks)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        begin = offs[doc] + nth * BLOCK
        size = np.minimum(BLOCK, offs[doc + 1] - begin)
        order = np.argsort(-size, kind="stable")
        doc, begin, size = doc[order], begin[order], size[order]
        live = np.searchsorted(-size, -np.arange(BLOCK), side="left")  # blocks longer than a step's number
        c = self._fold[c]
        states = [np.zeros(len(doc), dtype=np.int32) for _ in tables]
        counts = [np.zeros(len(doc), dtype=np.int32) for _ in tables]
        for step in range(int(size[0])):
            k = int(live[step])
            now = c[begin[:k] + step]
            for table, state, count in zip(tables, states, counts, strict=True):
                at = state[:k] * self._width
                at += now
                got = table[at]
                count[:k] += got & 1
                np.right_shift(got, 1, out=state[:k])
        for i, count in enumerate(counts):
            out[:, i] = np.bincount(doc, count, minlength=len(n)).astype(np.int64)
        return out, n

    def predict(self, texts: pa.Array, has: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, the bits a letter class and the bits of a phrase for each
        text; ``has``: whether it has a letter."""
        raw, offs = buffer(texts)
        names, score, rate, phrase = [], np.zeros(len(offs) - 1), np.zeros(len(offs) - 1), np.zeros(len(offs) - 1)
        bits = np.array(self.bits)
        for lo, hi in chunks(offs):
            if not self.langs:
                names += ["und"] * (hi - lo)
                continue
            counts, n = self.phrases(raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
            cost = counts * bits / np.maximum(n, 1)[:, None]
            best = cost.argmin(axis=1)
            low = cost[np.arange(len(best)), best]
            # Softmax of the costs, sharper for longer texts: 1 when no other language comes near.
            share = 1 / np.exp2(-np.clip((cost - low[:, None]) * np.sqrt(np.maximum(n, 1))[:, None], 0, 60)).sum(axis=1)
            score[lo:hi] = np.where(has[lo:hi], share, 0)
            rate[lo:hi] = np.where(has[lo:hi], low, 0)
            phrase[lo:hi] = bits[best] / np.maximum(n, 1)
            names += [self.langs[b] if ok else "und" for b, ok in zip(best, has[lo:hi], strict=True)]
        return names, score, rate, phrase


#: The first draw of a language's sample brings so many times what is needed, if all texts fill a piece.
_DRAW = 4


def train(docs: DataFrame, *, text: str = "text", lang: str = "lang", sample_letters: int = 48_000, piece: int = 2_000) -> Model:
    """A model of all non-null values of ``lang``, each from ``sample_letters`` letter classes
    of labelled text, or all that there are: a bounded sample. Distinct texts are drawn
    from the smallest of their hashes on, so that copies weigh nothing; of a text longer
    than ``piece`` characters that many are taken, from a place that its hash chooses."""
    size = F.greatest(F.length("t") - piece, F.lit(0))
    have = docs.select(F.col(lang).alias("l"), F.col(text).alias("t")).where(F.col("l").isNotNull() & F.col("t").rlike(LETTER)).withColumn("h", F.xxhash64("t")).withColumn("unit", F.shiftrightunsigned("h", 11) / F.lit(2.0**53))
    taken = F.substring("t", F.pmod(F.xxhash64("h"), size + 1).cast("int") + 1, F.lit(piece))
    # One row for each language. Distinct texts count, not their copies; where they are short, a wider draw follows.
    limits = {r["l"]: min(1.0, _DRAW * sample_letters / (r["n"] * piece)) for r in have.groupBy("l").agg(F.approx_count_distinct("h", 0.02).alias("n")).collect()}
    found: dict[str, bytes] = {}
    while limits:
        bound = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair])
        drawn = have.where(F.col("unit") <= F.coalesce(bound[F.col("l")], F.lit(-1.0))).groupBy("l", "unit", "h").agg(F.min(taken).alias("t"))
        # Letters before a piece, in the order of the hashes: what is collected is bounded by the sample and a piece.
        letters_of = F.length(F.regexp_replace("t", r"[^\p{L}]+", " "))
        before = F.sum("n").over(W.partitionBy("l").orderBy("unit", "h").rowsBetween(W.unboundedPreceding, -1))
        rows = written(drawn.withColumn("n", letters_of).withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < sample_letters), "language-sample").collect()
        for l in {r["l"] for r in rows}:
            raw, offs = buffer(pa.array([f" {r['t']}" for r in sorted((r for r in rows if r["l"] == l), key=lambda r: (r["unit"], r["h"]))], pa.string()))
            found[l] = letters(raw, offs)[0][:sample_letters].tobytes()
        limits = {l: min(1.0, 8 * x) for l, x in limits.items() if x < 1 and len(found.get(l, b"")) < sample_letters}
    langs = sorted(found)
    return Model(langs, [automaton(found[l]) for l in langs], [float(np.log2(len(found[l]) + 1)) for l in langs])


def predict(docs: DataFrame, model: Model, *, text: str = "text", carry: list[str]) -> DataFrame:
    """The columns ``carry`` of each row, then ``lang_pred``, ``score`` (0 to 1) and
    ``bits`` (the winner's bits for each letter class).

    Null texts and texts without a letter give ``und``, 0 and 0, and so does a model
    that learned no language; letters are those of Unicode. Ties go to the first language
    by name. Repeated rows are predicted each for itself; an empty table gives an empty
    result. A carried column named like a result gives way to it."""
    handed = docs.sparkSession.sparkContext.broadcast(model)
    inner = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)], F.col(text).alias("t"), _has_letter(F.col(text)).alias("has"))
    schema = T.StructType([f for f in inner.schema.fields if f.name not in ("t", "has")]).add("lang_pred", "string").add("score", "double").add("bits", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, s, rate, _ = handed.value.predict(b.column("t"), np.asarray(b.column("has")))
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(names, pa.string()), pa.array(s), pa.array(rate)], names=[*b.schema.names[:-2], "lang_pred", "score", "bits"])

    results = ("lang_pred", "score", "bits")
    return mapped(inner, run, schema).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(carry) if c not in results], *results)


def _has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(LETTER), F.lit(False))


def accepted(docs: DataFrame, model: Model, *, text: str = "text", most_bits: float = 5.0, spare_phrases: int = 2) -> DataFrame:
    """The rows of ``docs`` in a language that the model knows, all columns as they are, in
    place. Rejected are texts that are null or have no letter, and texts for which the
    winner needs more bits than ``most_bits`` for each letter class and
    ``spare_phrases`` phrases: no learned language explains them. A model without
    languages rejects all."""
    handed, place = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text)
    last = len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            has = np.asarray(b.column(last))
            names, _, bits, phrase = handed.value.predict(b.column(place), has)
            keep = (np.array(names, dtype=object) != "und") & (bits <= most_bits + spare_phrases * phrase)
            yield pa.RecordBatch.from_arrays(b.columns[:last], names=b.schema.names[:last]).filter(pa.array(keep))

    return mapped(docs.select("*", _has_letter(F.col(text)).alias(free_names(docs.columns, 1)[0])), run, docs.schema)
