"""Language-model scoring with a weighted backoff automaton.

Counts. Words and pairs are counted over the whole training part: each block of
documents sends its distinct ones to count shards and gets the corpus counts back,
in rows of packed numbers, so that a frequent word is one entry for a block, not a
row for each occurrence. Of triples, marks of fewer bits go first; those follow that
may repeat, by their marks and by both their pairs.

Model. Every word is a symbol of its own, and every pair and triple that occurs
``LEAST`` times is an arc: absolute discounting, interpolated with the next shorter
context. Contexts of no, one and two words are states. The failure arc of a state drops
its oldest word, with the weight that makes its distribution sum to one. Arcs and
failure weights are joined to the blocks by shards of their keys, so the model grows
with the corpus and no process holds it. A word's own probability is its discounted
share of all tokens; the mass that discounting leaves is that of unknown words, one
event, as in the base model.

Scoring. Each block holds the arcs that its texts can meet. A text is traversed once
from left to right: the state is carried from token to token, failure arcs are taken
until an arc fits, and log-probabilities add up. All texts of a block are traversed
side by side; a long one goes in parts, each of which comes into its state by the two
tokens before it, since no state knows more than two.

Words have 64-bit keys. The keys of pairs and triples have 20 bits more than the corpus
has bytes (in bits), so that one of them shares its key with another one with a
probability below 2**-20 at any size.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import U64, buffer, chunks, discard, mix, owner, settled, text_bytes, unzipped, word_hashes, written, zipped

#: Bytes of text in a block of documents, about, and blocks whose n-grams make a shard's.
BLOCK_BYTES, BLOCKS_A_SHARD = 4 << 20, 4
#: Tokens of a text that are traversed in one go.
STRIDE = 256
#: The end of a text, as a token.
END = U64(0x6A09E667F3BCC909)


def tokens(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, the end of each text among them, and each text's first token."""
    raw, offs = buffer(texts)
    parts, first = [], [np.zeros(1, dtype=np.int64)]
    for lo, hi in chunks(offs):
        h, at = word_hashes(raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
        parts.append(np.insert(h, at[1:], END))
        first.append(at[1:] + np.arange(1, len(at)) + first[-1][-1])
    return (np.concatenate(parts) if parts else np.zeros(0, dtype=U64)), np.concatenate(first)


@dataclass
class Automaton:
    """States from 0, the context of no word; then those of one word, from ``pairs`` on those of
    two. Arcs have a key (state * symbols + symbol), a target and a log10 weight. ``met`` has
    for each place of the texts the arc of its symbol from the states of no word, of one
    and of two that a text can be in there, or -1 where they have none; the first always has."""

    symbols: int
    pairs: int
    keys: np.ndarray
    targets: np.ndarray
    weights: np.ndarray
    failures: np.ndarray
    failure_weights: np.ndarray
    met: np.ndarray

    def traverse(self, first: np.ndarray, start: int) -> np.ndarray:
        """log10 probability of each symbol of the texts that begin at ``first``, in state ``start``."""
        size = np.diff(first)
        parts = -(-size // STRIDE)
        text = np.repeat(np.arange(len(size)), parts)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)
        begin = first[text] + nth * STRIDE
        lead = np.where(nth > 0, 2, 0)  # tokens that only lead into the state
        size = np.minimum(STRIDE, first[text + 1] - begin) + lead
        begin = begin - lead
        order = np.argsort(-size, kind="stable")
        begin, size, lead = begin[order], size[order], lead[order]
        state = np.where(lead > 0, 0, start)
        out = np.zeros(self.met.shape[1])
        for step in range(int(size[0]) if len(size) else 0):
            k = int(np.searchsorted(-size, -step, side="left"))
            at, value, open_ = begin[:k] + step, np.zeros(k), np.arange(k)
            while len(open_):
                here = state[open_]
                arc = self.met[(here > 0).astype(np.int8) + (here >= self.pairs), at[open_]]
                fails = arc < 0
                state[open_] = np.where(fails, self.failures[here], self.targets[arc])
                value[open_] += np.where(fails, self.failure_weights[here], self.weights[arc])
                open_ = open_[fails]
            told = lead[:k] <= step
            out[at[told]] = value[told]
        return out


#: An n-gram is an arc from so many occurrences on, whatever the size of the corpus.
LEAST = 2
#: Kinds of sharded rows: words, pairs, triples, contexts of one and of two words, marks of triples; 0 has a block's share of single triples.
WORDS, PAIRS, TRIPLES, AFTER_ONE, AFTER_TWO, MARKS = 1, 2, 3, 4, 5, 6
SENT = "kind int, shard long, block long, keys binary, a binary, b binary, stats array<long>"


def packed(x: np.ndarray) -> bytes:
    """Whole numbers of 0 or more in the least width that holds them, byte planes apart and compressed."""
    top = int(x.max()) if len(x) else 0
    width = -(-top.bit_length() // 8)
    planes = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes([width]) + len(x).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpacked(x: bytes) -> np.ndarray:
    width, n = x[0], int.from_bytes(x[1:9], "little")
    out = np.zeros((n, 8), dtype=np.uint8)
    if width:
        planes = pa.decompress(x[9:], decompressed_size=width * n, codec="zstd", asbytes=True)
        out[:, :width] = np.frombuffer(planes, dtype=np.uint8).reshape(width, n).T
    return out.view("<u8").ravel()


def ascending(x: np.ndarray) -> bytes:
    """Sorted numbers: the first, then the steps from each to the next in Rice's code: of their low
    bits the whole bytes as planes and the others side by side, and the rest in unary."""
    step = np.diff(x)
    low = max(0, ((int(x[-1]) - int(x[0])) // max(1, len(step))).bit_length() - 1)
    whole, odd = divmod(low, 8)
    planes = np.ascontiguousarray(step.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    bits = np.unpackbits(((step >> U64(8 * whole)) & U64((1 << odd) - 1)).astype(np.uint8).reshape(-1, 1), axis=1)[:, 8 - odd :]
    ends = np.cumsum((step >> U64(low)).astype(np.int64) + 1) - 1
    unary = np.zeros(int(ends[-1]) + 1 if len(ends) else 0, dtype=np.uint8)
    unary[ends] = 1
    return b"".join((int(x[0]).to_bytes(8, "little"), len(step).to_bytes(8, "little"), bytes([low]), planes[:whole].tobytes(), np.packbits(bits.ravel()).tobytes(), np.packbits(unary).tobytes()))


def ascended(x: bytes) -> np.ndarray:
    first, n, low = int.from_bytes(x[:8], "little"), int.from_bytes(x[8:16], "little"), x[16]
    whole, odd = divmod(low, 8)
    data = np.frombuffer(x, dtype=np.uint8)
    a, b = 17 + n * whole, 17 + n * whole + -(-n * odd // 8)
    step = np.zeros((n, 8), dtype=np.uint8)
    step[:, :whole] = data[17:a].reshape(whole, n).T
    bits = np.zeros((n, 8), dtype=np.uint8)
    bits[:, 8 - odd :] = np.unpackbits(data[a:b], count=n * odd).reshape(n, odd)
    if odd:
        step[:, whole] = np.packbits(bits, axis=1).ravel()
    ends = np.flatnonzero(np.unpackbits(data[b:]))
    step = step.view("<u8").ravel() | (np.diff(ends, prepend=-1) - 1).astype(U64) << U64(low)
    return np.cumsum(np.concatenate(([U64(first)], step)), dtype=U64)


@dataclass
class Keys:
    """Bits of the shard number, of the keys of longer n-grams and of the marks of triples."""

    shard: int
    gram: int
    mark: int

    def of(self, kind: int) -> int:
        return {WORDS: 64, AFTER_ONE: 64, MARKS: self.mark}.get(kind, self.gram)

    def follow(self, context: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The key of a context and the word after it."""
        return mix(context * U64(0x9E3779B97F4A7C15) + h) >> U64(64 - self.gram)

    def sent(self, kind: int, block: int | None, u: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple]:
        """A row for each shard that the sorted keys ``u`` touch; shards are ranges of keys."""
        s = (u >> U64(self.of(kind) - self.shard)).astype(np.int64) if self.shard else np.zeros(len(u), dtype=np.int64)
        ids = np.unique(s)
        lo, hi = np.searchsorted(s, ids), np.searchsorted(s, ids, side="right")
        return [(kind, int(k), block, ascending(u[i:j]), packed(a[i:j]), packed(b[i:j]), None) for k, i, j in zip(ids, lo, hi, strict=True)]


def _table(rows: list[tuple]) -> pa.Table:
    types = {"kind": pa.int32(), "shard": pa.int64(), "block": pa.int64(), "keys": pa.binary(), "a": pa.binary(), "b": pa.binary(), "stats": pa.list_(pa.int64())}
    return pa.table({name: pa.array([r[i] for r in rows], t) for i, (name, t) in enumerate(types.items())})


class Grams:
    """The tokens of a block with its distinct words, pairs and marks of triples. A text starts in
    the context of the end of another one, so that contexts count as often as they are followed."""

    def __init__(self, texts: pa.Array | pa.ChunkedArray, keys: Keys):
        h, self.first = tokens(texts)
        self.words, self.word = np.unique(h, return_inverse=True)
        self.end = int(np.searchsorted(self.words, [END])[0])
        self.before = np.concatenate(([self.end], self.word[:-1]))
        self.pairs, self.example, self.pair = np.unique(keys.follow(self.words[self.before], h), return_index=True, return_inverse=True)
        later = np.ones(len(h), dtype=bool)  # has two words before it, the start counted
        later[self.first[:-1]] = False
        self.third = np.flatnonzero(later)
        self.key = keys.follow(self.pairs[self.pair[self.third - 1]], h[self.third])
        self.marks, self.mark = np.unique(self.key >> U64(keys.gram - keys.mark), return_inverse=True)

    def triples(self, n: np.ndarray, repeats: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the triples that may repeat, by their pairs (``n``: the pairs' counts) and by
        their marks: places, distinct keys, a place of each key, and each place's key."""
        some = (n[self.pair[self.third]] >= LEAST) & (n[self.pair[self.third - 1]] >= LEAST) & (repeats[self.mark] > 0)
        at = self.third[some]
        u, example, inverse = np.unique(self.key[some], return_index=True, return_inverse=True)
        return at, u, at[example], inverse

    def automaton(self, have: dict[int, tuple[np.ndarray, np.ndarray]], n: int, v: int, d1: float, d2: float, d3: float) -> tuple[Automaton, int]:
        """The states and arcs that the block's texts can meet, and the state of a text's start."""
        c, pairs, w, m = have[WORDS][0], have[PAIRS][0], len(self.words), len(self.pairs)
        at, _, e, which = self.triples(pairs, have[MARKS][0])
        triples = have[TRIPLES][0]
        one = np.where(c > 0, c - d1, d1 * v) / n if n else np.ones(w)
        state = np.where(c >= LEAST, np.arange(w) + 1, 0)
        left_one, left_two = _rest(c, have[AFTER_ONE], d2), _rest(pairs, have[AFTER_TWO], d3)
        old, new = self.before[self.example], self.word[self.example]
        two = np.where(pairs >= LEAST, pairs - d2, 0) / np.maximum(c[old], 1) + left_one[old] * one[new]
        arc_two = np.flatnonzero(pairs >= LEAST)
        often = triples >= LEAST
        e, triples = e[often], triples[often]
        context, pair = self.pair[e - 1], self.pair[e]
        three = (triples - d3) / pairs[context] + left_two[context] * two[pair]
        keys = np.concatenate((np.arange(w), (old[arc_two] + 1) * w + new[arc_two], (context + 1 + w) * w + self.word[e]))
        targets = np.concatenate((state, arc_two + 1 + w, pair + 1 + w))
        weights = np.log10(np.concatenate((one, two[arc_two], three)))
        met = np.full((3, len(self.word)), -1, dtype=np.int32)
        met[0] = self.word
        met[1] = np.where(pairs >= LEAST, w + np.cumsum(pairs >= LEAST) - 1, -1)[self.pair]
        met[2, at] = np.where(often, w + len(arc_two) + np.cumsum(often) - 1, -1)[which]
        failures = np.concatenate((np.zeros(w + 1, dtype=np.int64), state[new]))
        failure_weights = np.log10(np.concatenate(([1.0], left_one, left_two)))
        return Automaton(w, w + 1, keys, targets, weights, failures, failure_weights, met), int(state[self.end])


def tallied(sent: DataFrame, by: Keys) -> DataFrame:
    """Sums of ``a`` and ``b`` by key, shard by shard: a row back for each row with a block, in
    the order of its keys, and for each shard a row of totals (all, distinct, once,
    twice). Of marks the answer is whether they repeat. Of pairs, ``b`` tells one of the rows that sent a key. Triples also give their
    contexts the sum and the number of those that repeat, as rows without a block."""

    def count(group: pa.Table) -> pa.Table:
        kind, shard = group["kind"][0].as_py(), group["shard"][0].as_py()
        keys = [ascended(x) for x in group["keys"].to_pylist()]
        a, b = (np.concatenate([unpacked(x) for x in group[c].to_pylist()]) for c in ("a", "b"))
        u, example, inverse = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
        sums = _sums(inverse, a, len(u))
        one = np.zeros(len(a), dtype=np.int64)
        if kind == MARKS:
            sums = (sums >= LEAST).astype(np.int64)
        elif kind == PAIRS:
            one[example] = 1
        elif kind in (AFTER_ONE, AFTER_TWO):
            one = _sums(inverse, b, len(u))[inverse]
        cuts = np.cumsum([len(k) for k in keys])[:-1]
        answers = zip(group["block"].to_pylist(), np.split(sums[inverse], cuts), np.split(one, cuts), strict=True)
        out = [(kind, shard, block, None, packed(x), packed(y), None) for block, x, y in answers if block is not None]
        if kind == TRIPLES:
            kept = sums >= LEAST
            context, i = np.unique(b[example[kept]], return_inverse=True)
            out += by.sent(AFTER_TWO, None, context, _sums(i, sums[kept], len(context)), np.bincount(i, minlength=len(context)))
        stats = [int(sums.sum()), int((sums > 0).sum()), int((sums == 1).sum()), int((sums == 2).sum())]
        return _table([*out, (kind, shard, None, None, None, None, stats)])

    return sent.groupBy("kind", "shard").applyInArrow(count, SENT)


def _sums(i: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(i, x.astype(float), minlength=n).astype(np.int64)  # exact below 2**53


def _answers(group: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By kind the answers to a block, in the order of its keys."""
    rows = sorted(zip(group["kind"].to_pylist(), group["shard"].to_pylist(), group["a"].to_pylist(), group["b"].to_pylist(), strict=True), key=lambda r: r[:2])
    out = {}
    for kind in (WORDS, PAIRS, TRIPLES, AFTER_ONE, AFTER_TWO, MARKS):
        mine = [r for r in rows if r[0] == kind]
        out[kind] = tuple(np.concatenate([np.zeros(0, dtype=np.int64), *(unpacked(r[c]).astype(np.int64) for r in mine)]) for c in (2, 3))
    return out


def _discount(once: int, twice: int) -> float:
    return once / (once + 2 * twice) if once and twice else 0.5


def _whole(inner: DataFrame, ids: list[str], n_bytes: int) -> DataFrame:
    """The blocks send their distinct words, pairs and marks to shards and get the corpus counts
    back, then the triples that may repeat and the contexts; nothing is broadcast but totals."""
    n_blocks, size = max(1, -(-n_bytes // BLOCK_BYTES)), max(1, n_bytes).bit_length()
    by = Keys((-(-n_blocks // BLOCKS_A_SHARD) - 1).bit_length(), min(64, size + 20), min(64, size + 6))
    inner = zipped(inner.withColumn("block", F.pmod(F.xxhash64("t", *ids), F.lit(n_blocks)).cast("long")), "t")

    def learned(left: pa.Table, g: Grams) -> np.ndarray:
        return np.asarray(left["train"])[owner(g.first)]

    def first_round(left: pa.Table) -> pa.Table:
        g, block = Grams(unzipped(left["t"]), by), left["block"][0].as_py()
        taught = learned(left, g)
        rows = []
        for kind, u, n in ((WORDS, g.words, np.bincount(g.word[taught], minlength=len(g.words))), (PAIRS, g.pairs, np.bincount(g.pair[taught], minlength=len(g.pairs))), (MARKS, g.marks, np.minimum(np.bincount(g.mark[taught[g.third]], minlength=len(g.marks)), LEAST))):
            rows += by.sent(kind, block, u, n, np.zeros(len(u), dtype=np.int64))
        return _table(rows)

    def second_round(left: pa.Table, right: pa.Table) -> pa.Table:
        g, block, have = Grams(unzipped(left["t"]), by), left["block"][0].as_py(), _answers(right)
        taught, c, (n, mine) = learned(left, g), have[WORDS][0], have[PAIRS]
        at, u, example, i = g.triples(n, have[MARKS][0])
        rows = by.sent(TRIPLES, block, u, np.bincount(i[taught[at]], minlength=len(u)), g.pairs[g.pair[example - 1]])
        mine = (mine > 0) & (n >= LEAST)
        after, often = g.before[g.example[mine]], c >= LEAST
        rows += by.sent(AFTER_ONE, block, g.words[often], _sums(after, n[mine], len(c))[often], np.bincount(after, minlength=len(c))[often])
        none = np.zeros(int((n >= LEAST).sum()), dtype=np.int64)
        rows += by.sent(AFTER_TWO, block, g.pairs[n >= LEAST], none, none)
        # A triple that cannot repeat occurs once.
        single = int(taught[g.third].sum() - taught[at].sum())
        return _table([*rows, (0, 0, None, None, None, None, [single, single, single, 0])])

    blocks = inner.select("block", "train", "t").groupBy("block")
    counts = settled(tallied(blocks.applyInArrow(first_round, SENT), by), "lm-counts")
    back = counts.where("block is not null").select("kind", "block", "shard", "a", "b")
    sent = settled(blocks.cogroup(back.groupBy("block")).applyInArrow(second_round, SENT), "lm-sent")
    more = settled(tallied(sent.where(F.col("kind").isin(TRIPLES, AFTER_ONE)), by), "lm-triples")
    part = more.where("block is null and keys is not null")
    last = settled(tallied(sent.where(F.col("kind") == AFTER_TWO).unionByName(part), by), "lm-contexts")
    total = {k: np.zeros(4, dtype=np.int64) for k in (WORDS, PAIRS, TRIPLES)}
    stats = counts.unionByName(more).unionByName(sent).where("stats is not null")
    for r in stats.groupBy("kind").agg(*[F.sum(F.col("stats")[i]).alias(f"s{i}") for i in range(4)]).collect():  # one row for each kind
        kind = r[0] or TRIPLES
        if kind in total:
            total[kind] += np.array(r[1:], dtype=np.int64)
    discard(sent)
    n, v = (int(x) for x in total[WORDS][:2])
    d1, d2, d3 = (_discount(int(x[2]), int(x[3])) for x in total.values())

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        g, have = Grams(unzipped(left["t"]), by), _answers(right)
        c = have[WORDS][0]
        base = np.log10((c + 0.1) / (n + 0.1 * (v + 1)))
        arcs, start = g.automaton(have, n, v, d1, d2, d3)
        p = arcs.traverse(g.first, start)
        doc, size = owner(g.first), len(g.first) - 1
        arrays = {x: left[x] for x in ids}
        arrays["n_tokens"] = pa.array(np.diff(g.first), pa.int64())
        arrays["n_known"] = pa.array(np.bincount(doc, c[g.word] > 0, minlength=size).astype(np.int64))
        arrays["train_tokens"] = pa.array(np.full(size, n), pa.int64())
        arrays["base_score"] = pa.array(np.bincount(doc, base[g.word], minlength=size))
        arrays["score"] = pa.array(np.bincount(doc, p, minlength=size))
        return pa.table(arrays)

    answers = reduce(DataFrame.unionByName, [t.where("block is not null").select("kind", "block", "shard", "a", "b") for t in (counts, more, last)])
    return inner.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, _scored(inner, ids))


def _rest(n: np.ndarray, after: tuple[np.ndarray, np.ndarray], discount: float) -> np.ndarray:
    """What the arcs after each context leave to the shorter one; contexts that do not repeat have no arc."""
    out, some = np.ones(len(n)), n >= LEAST
    out[some] = 1 - (after[0] - discount * after[1]) / n[some]
    return out


def _scored(inner: DataFrame, ids: list[str]) -> T.StructType:
    return T.StructType([inner.schema[c] for c in ids]).add("n_tokens", "long").add("n_known", "long").add("train_tokens", "long").add("base_score", "double").add("score", "double")


def score(docs: DataFrame, train: Column, *, text: str = "text", carry: list[str]) -> DataFrame:
    """The columns ``carry`` of each row, then ``n_tokens``, ``n_known``, ``train_tokens``,
    ``base_score`` (the add-0.1 unigram's log10 probability) and ``score`` (the
    automaton's). The model learns from all rows where ``train`` is true.

    Null and empty texts are the end token alone. Repeated rows count, and are scored,
    each for itself. Without training rows every token is unknown: the base score
    is 0 for each, and so is the score. An empty table gives an empty result. A carried
    column named like a result gives way to it; other columns of ``docs`` are not read.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    inner = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)], F.coalesce(train, F.lit(False)).alias("train"), body.alias("t"))
    results = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    names = [F.col(f"c{i}").alias(c) for i, c in enumerate(carry) if c not in results]
    return _whole(inner, [f"c{i}" for i in range(len(carry))], text_bytes(docs, text)).select(*names, *results)
