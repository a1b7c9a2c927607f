"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A model is fitted on a bounded sample of labelled rows (``max_rows`` and ``max_features``
are the bounds) and has L1-sparse weights: a few thousand (feature hash, weight) pairs,
broadcast to all executors. Scoring reads every whole text once, in place, with no
shuffle.

Features of a text: presence of each word, each pair of neighbours and each
pair one word apart. Words are runs of letters, digits and bytes above 0x7F,
with A-Z lower-cased. Each feature is a 64-bit hash, so that rare pairs of long
texts do not fall onto learned words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import U64, buffer, chunks, lean, mapped, mix, owner, summed, word_hashes, written

#: Features that a task sums before it sends them, about.
_HELD = 2_000_000
_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def features(h: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(feature hashes, their documents): words, neighbours, pairs one word apart."""
    doc = owner(first)
    yield h, doc
    for gap, salt in ((1, 0x51ED270B), (2, 0xA24BAED5)):
        if len(h) > gap:
            same = doc[gap:] == doc[:-gap]
            yield mix(h[:-gap] * U64(3) + h[gap:] * U64(0x9E3779B97F4A7C15) + U64(salt))[same], doc[gap:][same]


@dataclass
class Model:
    """Sorted feature hashes with their weights, and the bias."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float

    def logits(self, texts: pa.Array) -> np.ndarray:
        raw, offs = buffer(texts)
        out = np.full(len(offs) - 1, self.bias)
        if not len(self.keys):
            return out
        # A bitmap over the low 20 bits spares nearly all features the search.
        likely = np.zeros(1 << 20, dtype=bool)
        likely[(self.keys & U64(0xFFFFF)).astype(np.int64)] = True
        for lo, hi in chunks(offs):
            h, first = word_hashes(raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], _WORD)
            hits = []
            for f, doc in features(h, first):
                near = np.flatnonzero(likely[(f & U64(0xFFFFF)).astype(np.int64)])
                at = np.minimum(np.searchsorted(self.keys, f[near]), len(self.keys) - 1)
                real = self.keys[at] == f[near]
                hits.append(doc[near[real]] * len(self.keys) + at[real])
            hits = np.unique(np.concatenate(hits)) if hits else np.zeros(0, dtype=np.int64)
            out[lo:hi] += np.bincount(hits // len(self.keys), self.weights[hits % len(self.keys)], minlength=hi - lo)
        return out

    def scores(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(texts), -500, 500)))


def ftrl(rows: list[np.ndarray], y: np.ndarray, weight: np.ndarray, n: int, alpha: float, beta: float, l1: float, l2: float, epochs: int, seed: int) -> tuple[np.ndarray, float]:
    """FTRL-proximal with per-coordinate rates over binary features; the last coordinate is the bias, free of L1."""
    z, g2 = np.zeros(n + 1), np.zeros(n + 1)
    sparse = np.full(n + 1, l1)
    sparse[n] = 0

    def solve(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        return -np.sign(zi) * np.maximum(np.abs(zi) - sparse[i], 0) / ((beta + np.sqrt(g2[i])) / alpha + l2)

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for r in order.permutation(len(rows)):
            i = rows[r]
            w = solve(i)
            g = (1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y[r]) * weight[r]
            z[i] += g - (np.sqrt(g2[i] + g * g) - np.sqrt(g2[i])) / alpha * w
            g2[i] += g * g
    w = solve(np.arange(n + 1))
    return w[:n], float(w[n])


def present(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For ranges of texts: the features of each text, once for each, and their texts (from 0 in the range)."""
    raw, offs = buffer(texts)
    for lo, hi in chunks(offs):
        h, first = word_hashes(raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], _WORD)
        f, doc = (np.concatenate(x) for x in zip(*features(h, first), strict=True))
        order = np.lexsort((f, doc))
        f, doc = f[order], doc[order]
        new = np.ones(len(f), dtype=bool)
        new[1:] = (f[1:] != f[:-1]) | (doc[1:] != doc[:-1])
        yield lo, hi, f[new], doc[new]


def frequent(sample: DataFrame, min_df: int, max_features: int) -> np.ndarray:
    """Sorted hashes of the features that ``min_df`` texts (a column t) have; the most frequent
    ``max_features`` at most. Tasks sum what they have read, then shards of the hashes do."""

    def sent(u: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        cuts = np.searchsorted(u >> U64(58), np.arange(1, 64, dtype=U64))
        columns = [pa.array(np.arange(64)), *(pa.array([x.tobytes() for x in np.split(c, cuts)], pa.binary()) for c in (u, n.astype("<i4")))]
        return pa.RecordBatch.from_arrays(columns, names=["shard", "f", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = [np.zeros(0, dtype=U64)], [np.zeros(0, dtype=np.int64)]
        for b in batches:
            for _, _, f, _ in present(b.column("t")):
                keys.append(f)
                counts.append(np.ones(len(f), dtype=np.int64))
                if sum(map(len, keys)) > _HELD:
                    u, n = summed(keys, counts)
                    if len(u) > _HELD // 2:
                        yield sent(u, n)
                        u, n = u[:0], n[:0]
                    keys, counts = [u], [n]
        yield sent(*summed(keys, counts))

    def count(group: pa.Table) -> pa.Table:
        u, n = summed([np.frombuffer(x, dtype=U64) for x in group["f"].to_pylist()], [np.frombuffer(x, dtype="<i4") for x in group["n"].to_pylist()])
        return pa.table({"f": pa.array(u[n >= min_df].view(np.int64)), "n": pa.array(n[n >= min_df])})

    df = mapped(sample.select("t"), run, "shard long, f binary, n binary").groupBy("shard").applyInArrow(lean(count), "f long, n long")
    return np.sort(np.asarray(df.orderBy(F.desc("n"), "f").limit(max_features).select("f").toArrow()["f"]).astype(np.int64).view(U64))


def encoded(sample: DataFrame, keys: np.ndarray) -> DataFrame:
    """(k, y, i): each text's features among ``keys``, as packed 32-bit indices."""
    handed = sample.sparkSession.sparkContext.broadcast(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            known, rows = handed.value, []
            for lo, hi, f, doc in present(b.column("t")):
                at = np.minimum(np.searchsorted(known, f), max(0, len(known) - 1))
                real = known[at] == f if len(known) else np.zeros(len(f), dtype=bool)
                cuts = np.searchsorted(doc[real], np.arange(1, hi - lo))
                rows += [x.tobytes() for x in np.split(at[real].astype("<i4"), cuts)]
            yield pa.RecordBatch.from_arrays([b.column("k"), b.column("y"), pa.array(rows, pa.binary())], names=["k", "y", "i"])

    schema = T.StructType([sample.schema["k"], sample.schema["y"]]).add("i", "binary")
    return mapped(sample.select("k", "y", "t"), run, schema)


def train(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic", max_rows: int = 12_000, max_features: int = 1 << 20, min_df: int = 4, alpha: float = 1.0, beta: float = 1.0, l1: float = 4.0, l2: float = 0.0, epochs: int = 10, seed: int = 7) -> Model:
    """Fits on at most ``max_rows`` labelled rows, half of each class where there are as
    many: a bounded, documented sample, chosen by a hash of the key. Their texts are whole,
    whatever their length. Weights restore the classes' shares, the rarer class times the
    root of the ratio, so that it is not drowned.

    Features are extracted and counted by the executors; those of fewer than ``min_df``
    texts of the sample are left out, and so is what is beyond the ``max_features`` most
    frequent. The driver gets the indices of the others alone, and fits.

    Null labels and null keys do not take part; a key labelled twice takes the larger
    label; of texts that repeat a key the least one is learned. No rows, or rows of one
    class, give the bias alone.
    """
    marks = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).where("k is not null and y is not null").groupBy("k").agg((F.max("y") > 0).cast("int").alias("y"))
    total = {r.y: r["count"] for r in marks.groupBy("y").count().collect()}  # two rows
    sides = [marks.where(F.col("y") == side).orderBy(F.xxhash64("k"), "k").limit(max_rows // 2) for side in (0, 1)]
    ids = F.broadcast(sides[0].unionByName(sides[1]))  # bounded by max_rows
    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")).join(ids, "k")
    sample = written(rows.groupBy("k").agg(F.min("y").alias("y"), F.min("t").alias("t")), "toxicity-sample")
    keys = frequent(sample, min_df, max_features)
    got = encoded(sample, keys).orderBy("k").select("y", "i").toArrow()
    y = np.asarray(got["y"]).astype(float)
    if not len(y):
        return Model(np.zeros(0, dtype=U64), np.zeros(0), 0.0)
    have = [max(1, int((y == side).sum())) for side in (0, 1)]
    each = [max(1.0, total.get(1 - side, 0) / max(1, total.get(side, 0))) ** 0.5 * total.get(side, 0) / have[side] for side in (0, 1)]
    weight = np.where(y > 0, each[1], each[0])
    # The last coordinate is the bias.
    lists = [np.append(np.frombuffer(x.as_buffer(), dtype="<i4"), np.int32(len(keys))) for x in got["i"]]
    w, bias = ftrl(lists, y, weight / weight.mean(), len(keys), alpha, beta, l1, l2, epochs, seed)
    alive = np.flatnonzero(w)
    return Model(keys[alive], w[alive], bias)


def score(docs: DataFrame, model: Model, *, text: str = "text", carry: list[str]) -> DataFrame:
    """The columns ``carry`` of each row, then ``score`` (0 to 1) and ``predicted``
    (1 from 0.5 up). Null and empty texts get the score of the bias; repeated rows
    are scored each for itself; an empty table gives an empty result. A carried column
    named like a result gives way to it. Columns of ``docs`` outside ``carry`` are not read."""
    handed = docs.sparkSession.sparkContext.broadcast(model)
    inner = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)], F.col(text).alias("t"))
    schema = T.StructType([f for f in inner.schema.fields if f.name != "t"]).add("score", "double").add("predicted", "integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = handed.value.scores(b.column("t"))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=[*b.schema.names[:-1], "score", "predicted"])

    out = mapped(inner, run, schema)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(carry) if c not in ("score", "predicted")], "score", "predicted")


def accepted(docs: DataFrame, model: Model, *, text: str = "text", limit: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``limit``, all columns as they are, in place.
    Null and empty texts are judged by the bias."""
    handed, place = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(handed.value.scores(b.column(place)) < limit))

    return mapped(docs, run, docs.schema)
