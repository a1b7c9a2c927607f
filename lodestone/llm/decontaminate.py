"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items are normalised alike (A-Z lower-cased, every run of bytes that
are neither letters, digits nor above 0x7F is one blank). An item of length L may
differ by ``k = L * error_rate`` edits: it is cut into k + 1 pieces, one of which
must stand unchanged in any text that holds the item within k edits. All pieces of
a block of items are searched at once (Aho-Corasick); around each hit Myers'
bit-parallel distance decides.

Items go in blocks of bounded size to all documents; documents stay in place.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import LOWER, buffer, chunks, mapped

#: Items that one pass over the documents takes with it.
ITEMS = 10_000
_KEEP = np.zeros(256, dtype=bool)
_KEEP[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def normalised(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normalised bytes of a buffer and the new offsets. Each text begins and ends with one
    blank, so that an item with blanks at its ends matches whole words."""
    low = LOWER[raw]
    n = len(offs) - 1
    wide = np.insert(np.where(_KEEP[low], low, 32), np.concatenate((offs[:-1], offs[1:])), 32)
    new = offs + 2 * np.arange(n + 1)
    blank = wide == 32
    keep = np.ones(len(wide), dtype=bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    keep[new[:-1]] = True
    return wide[keep], np.concatenate(([0], np.cumsum(keep)))[new]


def text_of(value: str | None) -> bytes:
    """One normalised text, without blanks at its ends."""
    raw, offs = buffer(pa.array([value], pa.string()))
    return normalised(raw, offs)[0].tobytes().strip()


def distance(pattern: bytes, text: bytes, limit: int) -> tuple[int, int]:
    """The least edit distance of ``pattern`` to any part of ``text``, and where the
    first such part ends; (limit + 1, -1) if it is above ``limit`` (Myers 1999)."""
    m = len(pattern)
    if m == 0:
        return 0, 0
    peq: dict[int, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, limit + 1, -1
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & full)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        if score < best:
            best, end = score, j + 1
            if best == 0:
                break
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        pv = mh | (~(xv | ph) & full)
        mv = ph & xv
    return best, end


@dataclass
class Items:
    """Ids and normalised texts of a block of items, and the edits that each may have."""

    ids: list
    texts: list[bytes]
    budgets: list[int]

    def __post_init__(self) -> None:
        self._automaton = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_automaton": None}

    def automaton(self):
        """Pieces of all items, each with (item, its offset)."""
        if self._automaton is None:
            import ahocorasick

            owners: dict[str, list[tuple[int, int]]] = {}
            for i, (text, k) in enumerate(zip(self.texts, self.budgets, strict=True)):
                cut = np.linspace(0, len(text), k + 2).astype(int)
                if k == 0:  # no edits: whole words only
                    owners.setdefault(f" {text.decode('latin-1')} ", []).append((i, -1))
                    continue
                for a, b in zip(cut[:-1], cut[1:], strict=True):
                    owners.setdefault(text[a:b].decode("latin-1"), []).append((i, int(a)))
            found = ahocorasick.Automaton()
            for piece, own in owners.items():
                found.add_word(piece, (len(piece), own))
            if owners:
                found.make_automaton()
            self._automaton = found
        return self._automaton

    def hits(self, raw: np.ndarray, offs: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, distance, end in the normalised text) of all items found, the best place each."""
        machine = self.automaton()
        if not len(machine):
            return
        for lo, hi in chunks(offs):
            body, at = normalised(raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
            data = body.tobytes()
            windows: dict[tuple[int, int], list[tuple[int, int]]] = {}
            places = [(end + 1 - size, own) for end, (size, own) in machine.iter(data.decode("latin-1"))]
            docs = np.searchsorted(at, [p for p, _ in places], side="right") - 1
            for (start, own), doc in zip(places, docs, strict=True):
                for item, offset in own:
                    k, m = self.budgets[item], len(self.texts[item])
                    a, b = max(int(at[doc]), start - offset - k), min(int(at[doc + 1]), start - offset + m + k)
                    have = windows.setdefault((int(doc), item), [])
                    if have and have[-1][0] <= a <= have[-1][1]:  # most hits are one after the other
                        have[-1] = (have[-1][0], max(b, have[-1][1]))
                    else:
                        have.append((a, b))
            for (doc, item), spots in sorted(windows.items()):
                best, where = self.budgets[item] + 1, -1
                for a, b in joined(spots):
                    exact = data.find(self.texts[item], a, b)
                    if exact >= 0:
                        d, end = 0, exact + len(self.texts[item]) - a
                    else:
                        d, end = distance(self.texts[item], data[a:b], self.budgets[item])
                    if d < best:
                        best, where = d, a + end - int(at[doc])
                if where >= 0:
                    yield lo + doc, item, best, where


def joined(spots: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Windows in their order, those that touch as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spots):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def blocks(items: DataFrame, key: str, text: str, error_rate: float) -> Iterator[Items]:
    """All items with a letter or digit, in blocks of about ``ITEMS``; null keys take no part."""
    have = items.select(F.col(key).alias("k"), F.col(text).alias("t")).where("k is not null and t is not null")
    n = -(-have.count() // ITEMS)
    for i in range(n):
        got = have.where(F.pmod(F.xxhash64("k", "t"), F.lit(n)) == i).distinct().collect()  # about ITEMS rows
        ready = [(r.k, x) for r in sorted(got, key=lambda r: (r.k, r.t)) if (x := text_of(r.t))]
        yield Items([k for k, _ in ready], [x for _, x in ready], [int(len(x) * error_rate) for _, x in ready])


def matches(docs: DataFrame, items: DataFrame, *, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", error_rate: float = 0.06) -> DataFrame:
    """One row for each pair of a document and an item that stands in it with at most
    ``error_rate`` edits for each normalised byte: the document's key, the item's key,
    ``distance`` and ``end`` (of the best place, the first one if several are as good).

    Null and empty texts, and items without a letter or digit, match nothing. Items too
    short for an edit match as whole words. Items that share a key are one: the best
    match counts. Repeated documents match each for itself; empty tables give an empty
    result. A key of the documents that has the name of another column of the result is
    called ``matched_key``, one of the items ``matched_item``. Other columns are not read."""
    inner = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    schema = T.StructType([inner.schema["k"], T.StructField("item", items.schema[item_key].dataType), T.StructField("distance", T.LongType()), T.StructField("end", T.LongType())])
    out = docs.sparkSession.createDataFrame([], schema)
    for block in blocks(items, item_key, item_text, error_rate):
        handed = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], handed=handed) -> Iterator[pa.RecordBatch]:
            for b in batches:
                best: dict[tuple[int, object], tuple[int, int]] = {}
                for doc, item, d, end in handed.value.hits(*buffer(b.column("t"))):
                    at = (doc, handed.value.ids[item])
                    best[at] = min(best.get(at, (d, end)), (d, end))
                rows = [(doc, item, d, end) for (doc, item), (d, end) in best.items()]
                if rows:
                    doc, item, d, end = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([b.column("k").take(pa.array(doc)), pa.array(item), pa.array(d, pa.int64()), pa.array(end, pa.int64())], names=["k", "item", "distance", "end"])

        out = out.unionByName(mapped(inner, run, schema))
    taken = ("distance", "end")
    names = ["matched_key" if key in taken else key, "matched_item" if item_key in (key, *taken) else item_key]
    return out.toDF(*names, *taken)


def clean(docs: DataFrame, items: DataFrame, *, text: str = "text", item_key: str = "item_id", item_text: str = "text", error_rate: float = 0.06) -> DataFrame:
    """The rows of ``docs`` in which no item stands, all columns as they are; rows are
    judged in place, each for itself. Null and empty texts stay."""
    for block in blocks(items, item_key, item_text, error_rate):
        handed = docs.sparkSession.sparkContext.broadcast(block)
        place = docs.columns.index(text)

        def run(batches: Iterator[pa.RecordBatch], handed=handed, place=place) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keep = np.ones(b.num_rows, dtype=bool)
                keep[[doc for doc, *_ in handed.value.hits(*buffer(b.column(place)))]] = False
                yield b.filter(pa.array(keep))

        docs = mapped(docs, run, docs.schema)
    return docs
