"""Clustering by summaries: N, SUM and SUMSQ for each cluster, Mahalanobis assignment.

Clusters live as summaries, which merge by addition. Their number is a parameter, so
the driver holds k and not n of them; points stay distributed and are assigned by
expressions over literal centroids, in one pass for each chunk.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.sources import numbered, written


def summaries(points: DataFrame, cluster: str, dims: int, vector: str = "features") -> DataFrame:
    """(cluster, n, s, ss): counts, sums and sums of squares, all dimensions in one pass."""
    x = [F.col(vector)[i].cast("double") for i in range(dims)]
    return points.groupBy(cluster).agg(F.count("*").alias("n"), F.array(*[F.sum(v) for v in x]).alias("s"), F.array(*[F.sum(v * v) for v in x]).alias("ss"))


def long_form(summary: DataFrame, cluster: str) -> DataFrame:
    """(cluster, dim, n, s, ss), dimensions from 0."""
    return summary.select(cluster, "n", F.posexplode(F.arrays_zip("s", "ss")).alias("dim", "z")).select(cluster, F.col("dim").cast("long").alias("dim"), "n", F.round("z.s", 4).alias("s"), F.round("z.ss", 4).alias("ss"))


@dataclass
class Summary:
    n: int
    s: np.ndarray
    ss: np.ndarray

    def __add__(self, other: Summary) -> Summary:
        return Summary(self.n + other.n, self.s + other.s, self.ss + other.ss)

    @property
    def centroid(self) -> np.ndarray:
        return self.s / self.n

    @property
    def std(self) -> np.ndarray:
        return np.sqrt(np.maximum(self.ss / self.n - self.centroid**2, 0))

    def distance(self, x: np.ndarray) -> float:
        """Of a point; dimensions without spread are left out."""
        std = self.std
        on = std > 1e-9
        return float(np.sqrt((((x - self.centroid)[on] / std[on]) ** 2).sum()))


def collect(summary: DataFrame, cluster: str) -> dict[int, Summary]:
    return {r[cluster]: Summary(r.n, np.array(r.s), np.array(r.ss)) for r in summary.orderBy(cluster).collect()}  # one row for each cluster


def assign(points: DataFrame, clusters: dict[int, Summary], limit: float, vector: str = "features", none: int = -1) -> DataFrame:
    """``points`` with ``cluster`` (the nearest, ties to the smaller, or ``none`` beyond
    ``limit``) and ``distance`` (rounded to 6 digits; null without clusters)."""
    if not clusters:
        return points.withColumn("cluster", F.lit(none).cast("long")).withColumn("distance", F.lit(None).cast("double"))
    ids = np.array(sorted(clusters))
    centres = np.stack([clusters[k].centroid for k in ids])
    scale = np.stack([np.where(clusters[k].std > 1e-9, 1 / np.maximum(clusters[k].std, 1e-9), 0) for k in ids])

    # One matrix of k rows for a batch of points: expressions would take k times d terms for each row.
    @F.pandas_udf("cluster long, distance double")
    def nearest(vectors: pd.Series) -> pd.DataFrame:
        x = np.stack(vectors.to_numpy()).astype(np.float64) if len(vectors) else np.zeros((0, centres.shape[1]))
        best, least = np.zeros(len(x), dtype=np.int64), np.full(len(x), np.inf)
        for i in range(len(ids)):
            d = np.round(np.sqrt((((x - centres[i]) * scale[i]) ** 2).sum(axis=1)), 6)
            closer = d < least
            best[closer], least[closer] = ids[i], d[closer]
        return pd.DataFrame({"cluster": np.where(least < limit, best, none), "distance": least})

    return points.withColumn("_near", nearest(vector)).withColumn("cluster", F.col("_near.cluster")).withColumn("distance", F.col("_near.distance")).drop("_near")


def chunked(points: DataFrame, key: str = "id", parts: int = 5) -> DataFrame:
    """``points`` with ``chunk`` from 1 to ``parts``: equal ranges of the key's order."""
    n = points.count()
    step = max(1, math.ceil(n / parts))
    return numbered(points, [F.col(key)]).withColumn("chunk", F.ceil(F.col("rn") / F.lit(step)).cast("long")).drop("rn")


def kmeans(points: DataFrame, k: int, seed: int = 0, vector: str = "features") -> DataFrame:
    """``points`` with ``cluster`` from 0; at most as many clusters as points."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    n = points.count()
    if n == 0:
        return points.withColumn("cluster", F.lit(0).cast("long"))
    if min(k, n) < 2:
        return points.withColumn("cluster", F.lit(0).cast("long"))
    ready = points.withColumn("_v", array_to_vector(vector))
    model = KMeans(k=min(k, n), seed=seed, featuresCol="_v", predictionCol="cluster").fit(ready)
    return model.transform(ready).drop("_v").withColumn("cluster", F.col("cluster").cast("long"))


def bfr(points: DataFrame, k: int, dims: int, *, seed: int = 0, parts: int = 5, fine: int = 10) -> tuple[DataFrame, list[tuple[int, int, int, int, int]]]:
    """Clusters of a point set that is read in ``parts`` chunks.

    Returns (id, cluster), -1 for outliers, and for each round (round, points in DS,
    number of CS, points in CS, points in RS). The first chunk is clustered finely
    (``fine`` * k), single points go aside, the rest makes the k discard sets; later
    chunks are assigned to the nearest discard set within 2 sqrt(d), else to the
    nearest compression set, else set aside; the points aside are clustered again
    each round. At last compression sets join discard sets within the limit.
    """
    limit = 2 * math.sqrt(dims)
    rows = written(chunked(points.select("id", F.col("features")), "id", parts), "bfr-points")
    first = rows.where("chunk = 1")
    rough = written(kmeans(first, fine * k, seed), "bfr-rough")
    lone = rough.groupBy("cluster").agg(F.count("*").alias("n")).where("n = 1").select("cluster")
    inner = rough.join(lone, "cluster", "left_anti").select("id", "features", "chunk")
    aside = written(rough.join(lone, "cluster", "left_semi").select("id", "features"), "bfr-aside")
    placed = written(kmeans(inner, k, seed).select("id", "features", "cluster"), "bfr-placed")
    discard = collect(summaries(placed, "cluster", dims), "cluster")
    done = placed.select("id", "cluster")
    compressed: dict[int, Summary] = {}
    in_sets = None
    next_id = 1_000_000
    rounds = []

    def condense(aside: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        """New compression sets from the points aside."""
        nonlocal next_id
        again = written(kmeans(aside, fine * k, seed).select("id", "features", (F.col("cluster") + next_id).alias("cluster")), "bfr-again")
        next_id += fine * k
        more = again.groupBy("cluster").agg(F.count("*").alias("n")).where("n > 1").select("cluster")
        grouped = written(again.join(more, "cluster", "left_semi"), "bfr-grouped")
        compressed.update(collect(summaries(grouped, "cluster", dims), "cluster"))
        return written(again.join(more, "cluster", "left_anti").select("id", "features"), "bfr-aside"), grouped.select("id", "cluster")

    def merge(renamed: dict[int, int]) -> None:
        """Joins compression sets that lie within the limit of each other."""
        while True:
            ids = sorted(compressed)
            near = min(((compressed[b].distance(compressed[a].centroid), a, b) for i, a in enumerate(ids) for b in ids[i + 1 :]), default=(math.inf, 0, 0))
            if near[0] >= limit:
                return
            _, a, b = near
            compressed[a] = compressed[a] + compressed.pop(b)
            renamed[b] = a

    renamed: dict[int, int] = {}
    for r in range(1, parts + 1):
        if r > 1:
            got = written(assign(rows.where(F.col("chunk") == r), discard, limit).select("id", "features", "cluster"), "bfr-got")
            new = got.where("cluster >= 0").select("id", "cluster")
            for c, s in collect(summaries(got.where("cluster >= 0"), "cluster", dims), "cluster").items():
                discard[c] = discard[c] + s
            done = done.unionByName(new)
            left = got.where("cluster < 0").select("id", "features")
            held = written(assign(left, compressed, limit).select("id", "features", "cluster"), "bfr-held")
            for c, s in collect(summaries(held.where("cluster >= 0"), "cluster", dims), "cluster").items():
                compressed[c] = compressed[c] + s
            kept = held.where("cluster >= 0").select("id", "cluster")
            in_sets = kept if in_sets is None else in_sets.unionByName(kept)
            aside = written(aside.unionByName(held.where("cluster < 0").select("id", "features")), "bfr-aside")
        aside, grouped = condense(aside)
        in_sets = grouped if in_sets is None else in_sets.unionByName(grouped)
        merge(renamed)
        if r == parts:
            for c in sorted(compressed):
                d, best = min(((s.distance(compressed[c].centroid), i) for i, s in discard.items()), default=(math.inf, 0))
                if d < limit:
                    discard[best] = discard[best] + compressed.pop(c)
                    renamed[c] = best
        rounds.append((r, sum(s.n for s in discard.values()), len(compressed), sum(s.n for s in compressed.values()), aside.count()))

    def final(c: int) -> int:
        while c in renamed:
            c = renamed[c]
        return c

    names = {c: final(c) for c in {r["cluster"] for r in in_sets.select("cluster").distinct().collect()}}
    moved = F.col("cluster")
    if names:
        table = F.create_map(*[F.lit(int(x)).cast("long") for pair in names.items() for x in pair])
        moved = table[F.col("cluster")]
    # What is still in a compression set at the end, or aside, is an outlier.
    rest = in_sets.select("id", F.when(moved < 1_000_000, moved).otherwise(F.lit(-1).cast("long")).alias("cluster"))
    return done.unionByName(rest).unionByName(aside.select("id", F.lit(-1).cast("long").alias("cluster"))), rounds
