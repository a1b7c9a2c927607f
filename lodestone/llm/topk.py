"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are sorted by length within a task and cut into buckets of similar
length. For a query with the threshold t (its k-th best score so far) a bucket
whose longest vector is L can be passed over where |q| L < t. In the others the
local cosine threshold t / (|q| L) chooses the pruning: near 1, by coordinates
(the products of the query's largest coordinates plus the Cauchy-Schwarz bound
of the rest); lower, by length (only vectors with |v| >= t / |q|). What stays is
verified by exact integer products. Bounds prune only below the threshold, so
ties survive to be broken by the smaller id.

Queries go in blocks of bounded size to all rows; thresholds start from the
longest vectors of the whole table, a bounded number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.llm.common import written

BUCKET = 1024
#: Queries that one pass over the table takes with it, and those in one block of products.
PASS, BLOCK = 32_768, 1024
#: Local cosine threshold from which coordinates prune.
STEEP = 0.75
FOCUS = 8


def clean(rows: DataFrame, key: str, vector: str, to_int: Column) -> DataFrame:
    """(id, v) with v an array of longs; rows with a null id, a null vector, or null or non-finite components are left out."""
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & ok).select(F.col(key).cast("long").alias("id"), to_int.alias("v"))


def dense(vectors: pa.Array, dim: int | None = None) -> np.ndarray:
    """A float64 matrix of integer vectors; shorter ones end in zeros."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    sizes = np.diff(np.asarray(vectors.offsets)) if len(vectors) else np.zeros(0, dtype=np.int64)
    width = max(int(sizes.max(initial=0)), dim or 0)
    flat = np.asarray(vectors.flatten()).astype(np.float64)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _widen(a: np.ndarray, d: int) -> np.ndarray:
    return a if a.shape[1] == d else np.pad(a, ((0, 0), (0, d - a.shape[1])))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact a b^T: in doubles while every sum is below 2**53, else in 64-bit integers."""
    if a.size == 0 or b.size == 0 or np.abs(a).max() * np.abs(b).max() * a.shape[1] < 2**53:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


class Best:
    """The k best (score, id) of each query so far, and each query's threshold."""

    def __init__(self, n: int, k: int, start: np.ndarray):
        self.k, self.limit = k, start.copy()
        self.q = self.s = self.i = np.zeros(0, dtype=np.int64)
        self.n = n

    def add(self, q: np.ndarray, s: np.ndarray, i: np.ndarray) -> None:
        q, s, i = np.concatenate((self.q, q)), np.concatenate((self.s, s)), np.concatenate((self.i, i))
        order = np.lexsort((i, -s, q))
        q, s, i = q[order], s[order], i[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        self.q, self.s, self.i = (x[rank < self.k] for x in (q, s, i))
        last = rank == self.k - 1
        self.limit[q[last]] = np.maximum(self.limit[q[last]], s[last])


def search(best: Best, ids: np.ndarray, vecs: np.ndarray, qids: np.ndarray, queries: np.ndarray) -> None:
    """All rows ``ids, vecs`` against all queries, into ``best``."""
    d = max(vecs.shape[1], queries.shape[1])
    vecs, queries = _widen(vecs, d), _widen(queries, d)
    length, qlen = np.sqrt((vecs**2).sum(axis=1)), np.sqrt((queries**2).sum(axis=1))
    order = np.argsort(-length, kind="stable")
    ids, vecs, length = ids[order], vecs[order], length[order]
    focus = np.argsort(-np.abs(queries), axis=1)[:, :FOCUS] if d else np.zeros((len(queries), 0), dtype=np.int64)
    for a in range(0, len(ids), BUCKET):
        bid, bvec, blen = ids[a : a + BUCKET], vecs[a : a + BUCKET], length[a : a + BUCKET]
        for c in range(0, len(qids), BLOCK):
            block = np.arange(c, min(c + BLOCK, len(qids)))
            bound = qlen[block] * blen[0] * (1 + 1e-12)
            limit = best.limit[block]
            block, limit, bound = (x[bound >= limit] for x in (block, limit, bound))
            if not len(block):
                continue
            local = np.where(bound > 0, limit / np.maximum(bound, 1e-300), -1)
            steep = local >= STEEP
            found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for q, t in zip(block[steep], limit[steep], strict=True):
                f = focus[q]
                rest = np.sqrt(np.maximum(qlen[q] ** 2 - (queries[q, f] ** 2).sum(), 0) * np.maximum(blen**2 - (bvec[:, f] ** 2).sum(axis=1), 0))
                near = np.flatnonzero(bvec[:, f] @ queries[q, f] + rest * (1 + 1e-9) + 1e-6 * abs(t) + 1 >= t)
                s = products(bvec[near], queries[q : q + 1])[:, 0]
                found.append((np.full(len(near), q), s, bid[near]))
            flat, t = block[~steep], limit[~steep]
            if len(flat):
                shortest = (t / np.maximum(qlen[flat], 1e-300)).min() * (1 - 1e-12)
                m = int(np.searchsorted(-blen, -shortest, side="right"))
                s = products(queries[flat], bvec[:m])
                x, y = np.nonzero(s >= t[:, None])
                found.append((flat[x], s[x, y], bid[y]))
            q, s, i = (np.concatenate(x) for x in zip(*found, strict=True))
            keep = (s >= best.limit[q]) & (qids[q] != i)
            if keep.any():
                best.add(q[keep], s[keep], i[keep])


def top_k(vectors: DataFrame, queries: DataFrame, *, k: int = 5) -> DataFrame:
    """``vectors`` and ``queries`` as :func:`clean` makes them. Returns query_id, rank (from
    1), vec_id and score: the k highest inner products of each query with the rows
    whose id is not its own (all of them, if fewer), ties to the smaller vec_id.

    A repeated query id is one query (its smallest vector); repeated vectors are rows
    each for itself. Shorter vectors count as if they ended in zeros. No queries or no
    other rows give an empty result."""
    spark = vectors.sparkSession
    queries = queries.groupBy("id").agg(F.min("v").alias("v"))
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    longest = vectors.orderBy(norm.desc(), "id").limit(BUCKET).toArrow()  # bounded
    passes = -(-queries.count() // PASS) or 1
    parts = []
    for i in range(passes):
        own = queries.where(F.pmod(F.xxhash64("id"), F.lit(passes)) == i).toArrow()  # about PASS rows
        qids, qs = np.asarray(own["id"]).astype(np.int64), dense(own["v"])
        start = np.full(len(qids), -np.inf)
        first = Best(len(qids), k, start)
        search(first, np.asarray(longest["id"]).astype(np.int64), dense(longest["v"]), qids, qs)
        handed = spark.sparkContext.broadcast((qids, qs, first.limit))

        def run(batches: Iterator[pa.RecordBatch], handed=handed) -> Iterator[pa.RecordBatch]:
            qids, qs, limit = handed.value
            best = Best(len(qids), k, limit)
            for b in batches:
                if b.num_rows and len(qids):
                    search(best, np.asarray(b.column("id")).astype(np.int64), dense(b.column("v")), qids, qs)
            yield pa.RecordBatch.from_arrays([pa.array(qids[best.q], pa.int64()), pa.array(best.i, pa.int64()), pa.array(best.s, pa.int64())], names=["query_id", "vec_id", "score"])

        found = vectors.mapInArrow(run, "query_id long, vec_id long, score long")
        parts.append(written(found, "topk") if passes > 1 else found)
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
