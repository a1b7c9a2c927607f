"""N-gram Jaccard join by a universe partition and the pigeonhole principle.

A document is the set of its distinct word shingles, as 64-bit hashes. Sets fall into
size bands whose bounds stand in the ratio of the similarity threshold, so that
linked sets lie in one band or in two neighbours. A band divides the universe of
shingles into segments by hash. Linked sets differ in at most H shingles, so in at
most H segments; a set that looks up segments worth H + 1 or more meets a linked
set in an equal segment (worth 1) or in one that equals its own up to one deletion
(worth 2, for the price of a key for each shingle in it).

Allocation by cost. From the number of sets in a band the plan weighs the rows of
each choice (exact or one-deletion segments, and how many more than needed) against
the pairs that empty segments would bring. Every set is indexed under all its
segments, and looks up no more than it needs, from the least shared up. Segments
that no other set has count as looked up: so many of them, and the set has no partner.

Groups. Equal sets are one node from the start. Within the sets that share a key,
each is verified with one of them; links found so are joined to components; only
pairs that share a key, are still in different components and pass the bounds of
sizes and parities are then verified one by one. A group of near copies thus costs
as many verifications as it has members. Verification intersects the whole sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import U64, buffer, chunks, free_names, mapped, mix, owner, word_hashes, written

_SALT, _K1, _K2, _K3 = (U64(x) for x in (0xD6E8FEB86659FD93, 0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
#: Bits of the filters that spare later passes what has no partner, as a power of two: 32 MB at most, less for few keys.
FILTER_BITS = 28


def shingles(texts: pa.Array, words: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For ranges of texts: their distinct shingles (sorted within each text) and the
    index of each text's first. Fewer words than ``words`` are one shingle of them all."""
    raw, offs = buffer(texts)
    for lo, hi in chunks(offs):
        h, first = word_hashes(raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
        count = np.diff(first)
        doc = owner(first)
        at = np.arange(len(h)) - np.repeat(first[:-1], count)
        whole = np.minimum(count, words)[doc]  # words in the shingles of this text
        s = np.zeros(len(h), dtype=U64)
        for j in range(min(words, len(h))):
            on = np.zeros(len(h), dtype=bool)
            on[: len(h) - j] = doc[: len(h) - j] == doc[j:]
            on &= j < whole
            moved = np.zeros(len(h), dtype=U64)
            moved[: len(h) - j] = h[j:]
            s = np.where(on, mix(s * _K1 + moved + U64(j + 1)), s)
        full = at <= (count[doc] - whole)
        s, doc = s[full], doc[full]
        order = np.lexsort((s, doc))
        s, doc = s[order], doc[order]
        new = np.ones(len(s), dtype=bool)
        new[1:] = (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])
        s, doc = s[new], doc[new]
        yield lo, hi, s, np.searchsorted(doc, np.arange(hi - lo + 1))


def sums(group: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """Sums modulo 2**64 of ``h`` by group; halves are summed exactly in doubles."""
    low = np.bincount(group, (h & U64(0xFFFFFFFF)).astype(np.float64), minlength=n).astype(U64)
    high = np.bincount(group, (h >> U64(32)).astype(np.float64), minlength=n).astype(U64)
    return low + (high << U64(32))


def nodes(s: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit name for each set, by its content, and its size."""
    size = np.diff(first)
    total = sums(owner(first), mix(s ^ _SALT), len(size))
    return mix(total * _K2 + size.astype(U64)), size


@dataclass
class Band:
    """Sizes from lo to hi, and the segments of a set: ``worth`` is 1 (exact) or 2 (one deletion)."""

    lo: int
    hi: int
    segments: int
    worth: int


def bands(top: int, num: int, den: int) -> list[tuple[int, int]]:
    out, lo = [], 1
    while lo <= top:
        hi = max(lo, lo * den // num)
        out.append((lo, hi))
        lo = hi + 1
    return out


def _beyond(mean: float, k: int) -> float:
    """E[max(0, X - k)] of a Poisson count: light segments that a set cannot skip."""
    top = int(k + mean + 12 * math.sqrt(mean) + 24)
    return sum((x - k) * math.exp(x * math.log(mean) - mean - math.lgamma(x + 1)) for x in range(k + 1, top)) if mean > 0 else 0.0


def plan(counts: dict[int, int], top: int, num: int, den: int) -> list[Band]:
    """The cheapest segments for each band; ``counts``: sets by band."""
    out = []
    for k, (lo, hi) in enumerate(bands(top, num, den)):
        need = hi * (den - num) // num + 1
        n, best = counts.get(k, 0) + counts.get(k + 1, 0), (math.inf, Band(lo, hi, need, 1))
        for worth in (1, 2):
            for spare in (0, 0.05, 0.1, 0.2, 0.3, 0.5):
                m = -(-math.ceil(need * (1 + spare)) // worth)
                light = (1 - 1 / m) ** lo * (1 if worth == 1 else 1 + lo / m)  # chance of an empty (or nearly) segment
                skipped = (m * worth - need) // worth
                kept = _beyond(m * light, skipped)
                rows = n * 2 * (m + (hi if worth == 2 else 0))
                best = min(best, (rows + 20 * n * n * kept * light, Band(lo, hi, m, worth)), key=lambda x: x[0])
        out.append(best[1])
    return out


def band_of(size: np.ndarray, table: list[Band]) -> np.ndarray:
    return np.searchsorted(np.array([b.lo for b in table]), size, side="right") - 1


def keys(s: np.ndarray, first: np.ndarray, table: list[Band], num: int, den: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For all sets of a range, in their own band (0) and as guests of the band below (1):
    (0 or 1, set, key, segment) by key, and (segments, need, limit) by set. A set looks up
    ``need`` segments to find all partners that are no larger; ``limit`` lonely segments
    rule out any partner, larger ones too (in the band below there are none)."""
    size = np.diff(first)
    own = band_of(size, table)
    hi, seg, worth = (np.array([getattr(b, x) for b in table], dtype=np.int64) for x in ("hi", "segments", "worth"))
    for below in (0, 1):
        band = own - below
        ok = (size > 0) & (band >= 0)
        band = np.where(ok, band, 0)
        if below:
            ok &= size <= hi[band] * den // num
        partner = np.where(below == 1, hi[band], size)  # the largest partner that this set must find
        need = (size + partner) * (den - num) // (den + num) + 1
        m = np.where(ok, seg[band], 0)
        base = np.cumsum(m) - m
        total = int(m.sum())
        if not total:
            continue
        doc = owner(first)
        use = ok[doc]
        h, doc = s[use], doc[use]
        idx = (mix(h + _K3) % m[doc].astype(U64)).astype(np.int64)
        gid = base[doc] + idx
        term = mix(h ^ _SALT)
        content = sums(gid, term, total)
        held = np.bincount(gid, minlength=total)
        of = np.repeat(np.arange(len(m)), m)
        nth = np.arange(total) - base[of]
        place = nth.astype(U64) * _K2 + band[of].astype(U64) * _K3
        need = -(-need // worth[band])
        limit = need if below else -(-(size * (den - num) // num + 1) // worth[band])
        yield below, of, mix(content * _K1 + place + held.astype(U64)), nth, m, need, limit
        cut = (worth[band] == 2)[doc]
        if cut.any():
            g = gid[cut]
            yield below, doc[cut], mix((content[g] - term[cut]) * _K1 + place[g] + (held[g] - 1).astype(U64)), idx[cut], m, need, limit


def parity(s: np.ndarray, first: np.ndarray) -> np.ndarray:
    """1024 bits for each set: the parity of its shingles with each of 1024 hash values.
    Two sets differ in at least as many shingles as their bits differ."""
    n = len(first) - 1
    at = owner(first) * 1024 + (mix(s + _K1) >> U64(54)).astype(np.int64)
    odd = (np.bincount(at, minlength=n * 1024) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64).reshape(n, 16)


class Filter:
    """A fixed-size set of 64-bit keys that may also answer yes to others."""

    def __init__(self, found: DataFrame, column: str):
        spark = found.sparkSession
        # Some 16 bits for each key, so that one in 16 others passes, as long as there is room.
        size = min(FILTER_BITS, max(12, (16 * found.count()).bit_length()))
        word = F.shiftrightunsigned(column, 64 - size + 6)
        bit = F.shiftrightunsigned(column, 64 - size).bitwiseAND(63).cast("int")
        got = found.groupBy(word.alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("b")).toArrow()  # 2**22 rows at most
        bits = np.zeros(1 << (size - 6), dtype=np.int64)
        bits[np.asarray(got["w"]).astype(np.int64)] = np.asarray(got["b"]).astype(np.int64)
        self.size, self.bits = size, spark.sparkContext.broadcast(bits.view(U64))

    def __call__(self, key: np.ndarray) -> np.ndarray:
        w = (key >> U64(64 - self.size + 6)).astype(np.int64)
        return (self.bits.value[w] >> ((key >> U64(64 - self.size)) & U64(63))) & U64(1) == 1

    def __getstate__(self) -> dict:
        return {"size": self.size, "bits": self.bits}


def _once(s: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each set of a batch once: shingles, firsts, names, sizes."""
    node, size = nodes(s, first)
    single = np.zeros(len(node), dtype=bool)
    single[np.unique(node, return_index=True)[1]] = True
    return s[single[owner(first)]], np.concatenate(([0], np.cumsum(size[single]))), node[single], size[single]


def _key_rows(docs: DataFrame, words: int, table: list[Band], num: int, den: int) -> DataFrame:
    """(key, node): all keys of all sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, s, first in shingles(b.column("t"), words):
                s, first, node, _ = _once(s, first)
                for _, doc, key, *_ in keys(s, first, table, num, den):
                    for a in range(0, len(key), 200_000):
                        yield pa.RecordBatch.from_arrays([pa.array(key[a : a + 200_000].view(np.int64)), pa.array(node[doc[a : a + 200_000]].view(np.int64))], names=["key", "node"])

    return mapped(docs, run, "key long, node long")


def _member_rows(docs: DataFrame, words: int, table: list[Band], num: int, den: int, chosen: Filter) -> DataFrame:
    """(key, node, size, below, segment, segments, need, limit) of the keys that others may
    share. A set with ``limit`` segments or more without such a key has no partner, since
    a partner differs in fewer segments, and is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, s, first in shingles(b.column("t"), words):
                s, first, node, size = _once(s, first)
                parts: dict[int, list] = {}
                for below, doc, key, nth, m, need, limit in keys(s, first, table, num, den):
                    near = chosen(key)
                    parts.setdefault(below, []).append((doc[near], key[near], nth[near], m, need, limit))
                for below, found in parts.items():
                    doc, key, nth = (np.concatenate([f[i] for f in found]) for i in range(3))
                    m, need, limit = found[0][3:]
                    base = np.cumsum(m) - m
                    shared = np.zeros(int(m.sum()), dtype=bool)
                    shared[base[doc] + nth] = True
                    lonely = m - np.bincount(np.repeat(np.arange(len(m)), m), shared, minlength=len(m)).astype(np.int64)
                    live = lonely[doc] < limit[doc]
                    doc, key, nth = doc[live], key[live], nth[live]
                    for a in range(0, len(key), 100_000):
                        d = doc[a : a + 100_000]
                        columns = [key[a : a + 100_000].view(np.int64), node[d].view(np.int64), size[d].astype(np.int32), np.full(len(d), below == 1), nth[a : a + 100_000].astype(np.int32), m[d].astype(np.int32), need[d].astype(np.int32), limit[d].astype(np.int32)]
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "node", "size", "below", "segment", "segments", "need", "limit"])

    return mapped(docs, run, "key long, node long, size int, below boolean, segment int, segments int, need int, limit int")


def lookups(members: DataFrame, shared: DataFrame) -> DataFrame:
    """(key, node, size, looked): sets that may have a partner, under their keys, and which
    of these they look up. ``shared``: (key, n).

    A set looks up ``need`` segments. Those that nobody shares are free, and ``limit`` of
    them rule a partner out; the others are taken from the least shared up."""
    role = ["node", "below"]
    rows = members.join(shared, "key")
    cost = rows.groupBy(*role, "segment").agg(F.sum("n").alias("cost"), F.first("need").alias("need"), F.first("segments").alias("segments"), F.first("limit").alias("limit"))
    all_of = W.partitionBy(*role)
    cost = cost.withColumn("lonely", F.col("segments") - F.count("*").over(all_of)).where(F.col("lonely") < F.col("limit"))
    cost = cost.withColumn("looked", F.row_number().over(all_of.orderBy("cost", "segment")) <= F.col("need") - F.col("lonely"))
    rows = rows.join(cost.select(*role, "segment", "looked"), [*role, "segment"]).where("looked or not below")
    return rows.groupBy("key", "node").agg(F.max("size").alias("size"), F.max("looked").alias("looked"))


def _sets(docs: DataFrame, words: int, chosen: Filter) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, s, first in shingles(b.column("t"), words):
                node, size = nodes(s, first)
                _, one = np.unique(node, return_index=True)
                one = one[chosen(node[one]) & (size[one] > 0)]
                for a in range(0, len(one), 500):
                    part = one[a : a + 500]
                    items = [s[first[i] : first[i + 1]] for i in part]
                    bits = parity(np.concatenate(items), np.concatenate(([0], np.cumsum([len(x) for x in items]))))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(node[part].view(np.int64)), pa.array([x.view(np.int64) for x in items], pa.list_(pa.int64())), pa.array(list(bits), pa.list_(pa.int64()))],
                        names=["node", "items", "bits"],
                    )

    return mapped(docs, run, "node long, items array<long>, bits array<long>")


def may_link(a: str, b: str, size_a: str, size_b: str, num: int, den: int) -> Column:
    """Bounds that every linked pair keeps: of the sizes, and of the differing parities."""
    differ = sum((F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(16)), F.lit(0))
    fits = F.lit(den) * F.least(size_a, size_b) >= F.lit(num) * F.greatest(size_a, size_b)
    return fits & (F.lit(den + num) * differ <= F.lit(den - num) * (F.col(size_a) + F.col(size_b)))


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold: bounds first, then the whole sets."""
    small = sets.select("node", F.size("items").alias("n"), "bits")
    a, b = (small.select(F.col("node").alias(x), F.col("n").alias(f"{x}_n"), F.col("bits").alias(f"{x}_bits")) for x in "ab")
    pairs = written(pairs.join(b, "b").join(a, "a").where(may_link("a_bits", "b_bits", "a_n", "b_n", num, den)).select("a", "b"), "jaccard-bounded")
    a, b = (sets.select(F.col("node").alias(x), F.col("items").alias(f"{x}_items")) for x in "ab")
    both = F.size(F.array_intersect("a_items", "b_items"))
    union = F.size("a_items") + F.size("b_items") - both
    return pairs.join(b, "b").join(a, "a").where(F.lit(den) * both >= F.lit(num) * union).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """(node, comp): the smallest node reachable, by alternating large and small stars;
    both sides of a join are spread, and no neighbourhood is gathered."""
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # A node's own smallest neighbour stays linked through its larger neighbours or itself.
        own = low.where("m < u").select("u", F.col("m").alias("v"))
        edges = written(large.unionByName(own).where("u <> v").distinct(), "edges")
        low = edges.groupBy("u").agg(F.min("v").alias("m"))
        small = edges.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(small.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before:
            return edges.groupBy("u").agg(F.min("v").alias("comp")).withColumnRenamed("u", "node")
        before = now


def link_components(docs: DataFrame, words: int, num: int, den: int, top: int, counts: dict[int, int]) -> DataFrame:
    """(node, comp) for all nodes with a link; ``docs``: a column t."""
    table = plan(counts, top, num, den)
    rows = _key_rows(docs, words, table, num, den)
    shared = written(rows.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("key", "n"), "jaccard-keys")
    members = written(_member_rows(docs, words, table, num, den, Filter(shared, "key")), "jaccard-members")
    # Equal sets of several batches are one.
    members = written(lookups(members.dropDuplicates(["key", "node", "below", "segment"]), shared), "jaccard-lookups")
    hubs = members.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("z"), F.max("looked").alias("any")).where("a < z and any").select("key", "a")
    near = written(members.join(hubs, "key").where("node <> a").select("a", F.col("node").alias("b")).distinct(), "jaccard-stars")
    wanted = written(members.join(hubs, "key", "left_semi").select("node").distinct(), "jaccard-wanted")
    sets = written(_sets(docs, words, Filter(wanted, "node")).dropDuplicates(["node"]), "jaccard-sets")
    links = written(verified(near, sets, num, den), "jaccard-links")
    comps = written(components(links), "jaccard-components")
    # What shares a key and is still apart.
    placed = members.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    split = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max("looked").alias("any")).where("lo < hi and any").select("key")
    bits = sets.select("node", "bits")
    apart = written(placed.join(split, "key", "left_semi").join(bits, "node"), "jaccard-apart")
    l, r = apart.where("looked").select("key", *(F.col(c).alias(f"l_{c}") for c in ("node", "size", "comp", "bits"))), apart
    pairs = l.join(r, (l["key"] == r["key"]) & (F.col("l_comp") != F.col("comp")) & may_link("l_bits", "bits", "l_size", "size", num, den))
    pairs = pairs.select(F.least("l_node", "node").alias("a"), F.greatest("l_node", "node").alias("b")).distinct().join(near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    more = written(verified(pairs, sets, num, den), "jaccard-more")
    if more.isEmpty():
        return comps
    return written(components(links.unionByName(more)), "jaccard-components")


def classes(docs: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row for each row of ``docs``: the key, ``n_shingles`` (the size of its set) and
    ``component_id``, the smallest key reachable by links, its own included. Two
    documents link when ``den`` * intersection >= ``num`` * union.

    Words are runs of bytes other than blank and \\x09 to \\x0D, A-Z lower-cased. Fewer
    than ``words`` words are one shingle; null texts and texts without words have an
    empty set, which links with nothing. Rows are documents each for itself: a repeated key
    does not link them. Null keys are never a component's id; a component of null keys
    alone has none. An empty table gives an empty result. Other columns are not read.
    """
    rows = written(grouped(docs, key, text, words, num, den), "jaccard-classes")
    # Both sides are read anew, so that a component of very many rows can be split in the join.
    least = written(rows.where("size > 0").groupBy("comp").agg(F.min("k").alias("least")), "jaccard-least")
    full = rows.where("size > 0").join(least, "comp")
    own = rows.where("size = 0").withColumn("least", F.col("k"))
    return full.select("k", "size", "least").unionByName(own.select("k", "size", "least")).toDF(key, "n_shingles", "component_id")


def grouped(docs: DataFrame, key: str, text: str, words: int, num: int, den: int) -> DataFrame:
    """(k, h, size, comp) for each row of ``docs``: its key, the hash of its text, the size of
    its set and the name of its component (of sets without shingles: none)."""
    inner = docs.select(F.col(key).alias("k"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("h"), F.col(text).alias("t"))
    schema = T.StructType([inner.schema["k"]]).add("h", "long").add("node", "long").add("size", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, size = [np.zeros(0, dtype=U64)], [np.zeros(0, dtype=np.int64)]
            for _, _, s, first in shingles(b.column("t"), words):
                x, y = nodes(s, first)
                node.append(x)
                size.append(y)
            yield pa.RecordBatch.from_arrays([b.column("k"), b.column("h"), pa.array(np.concatenate(node).view(np.int64)), pa.array(np.concatenate(size).astype(np.int64))], names=["k", "h", "node", "size"])

    rows = written(mapped(inner, run, schema), "jaccard-rows")
    sets = rows.where("size > 0").groupBy("node").agg(F.max("size").alias("size"))
    top = rows.agg(F.max("size")).first()[0]
    if not top:
        return rows.select("k", "h", "size", F.lit(None).cast("long").alias("comp"))
    starts = [lo for lo, _ in bands(top, num, den)]
    band = F.expr(f"size(filter(array({', '.join(map(str, starts))}), lo -> lo <= size)) - 1")
    counts = {r.band: r.n for r in sets.groupBy(band.alias("band")).agg(F.count("*").alias("n")).collect()}  # one row for each band
    comps = link_components(inner.select("t"), words, num, den, top, counts)
    out = rows.join(comps, "node", "left")
    return out.select("k", "h", "size", F.when(F.col("size") > 0, F.coalesce("comp", "node")).alias("comp"))


def representatives(docs: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row of ``docs`` for each group of linked documents, all columns as they are: the
    one with the smallest key, null keys last; of several with that key the one whose text
    has the smallest hash, and of equal texts under one key any one. Texts without words
    are alone and stay. A repeated key does not link its rows."""
    found = written(grouped(docs, key, text, words, num, den), "jaccard-classes")
    row = F.struct(F.col("k").isNull().alias("none"), "k", "h")
    first = found.where("comp is not null").groupBy("comp").agg(F.min(row).alias("r"))
    copies = found.where("comp is not null").groupBy("k", "h").agg(F.count("*").alias("rows"))
    same = F.col("r.k").eqNullSafe(F.col("k")) & (F.col("r.h") == F.col("h"))
    kept = written(first.join(copies, same).select("k", "h", "rows"), "jaccard-kept")
    kept = kept.unionByName(found.where("comp is null").select("k", "h", F.lit(1).cast("long").alias("rows")).distinct())
    names = free_names(docs.columns, 3)
    own = docs.withColumn(names[2], F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    kept = kept.select(F.col("k").alias(names[0]), F.col("h").alias(names[1]), "rows")
    on = F.col(names[0]).eqNullSafe(own[key]) & (F.col(names[1]) == F.col(names[2]))
    out = own.join(kept.where("rows = 1"), on, "left_semi")
    more = own.join(kept.where("rows > 1"), on, "left_semi")
    return out.unionByName(more.dropDuplicates([key, names[2]])).select(*docs.columns)
