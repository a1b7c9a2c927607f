"""Sketches over event streams in closed form: Bloom filter, distinct counts, reservoir."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions import HASHES, linear_hash, string_mod, trailing_zeros

#: Prime of the hash families.
P = 65537


def slots(value: Column, m: int = 199) -> Column:
    """The filter's positions of a value, one for each hash."""
    x = string_mod(value, P)
    return F.array(*[linear_hash(x, a, b, p, m) for a, b, p in HASHES])


def bloom_marks(arrivals: DataFrame, value: str, at: str, m: int = 199) -> DataFrame:
    """(value, first, fp): whether a value's first arrival finds all its positions set.

    A position is set from the least first arrival of the values that it belongs to, so
    no state is carried: a value is a false positive when all its positions were set
    strictly before it came. Such a value is never recorded, and all its arrivals count."""
    firsts = arrivals.groupBy(value).agg(F.min(at).alias("first"))
    bits = firsts.select(value, "first", F.explode(F.array_distinct(slots(F.col(value), m))).alias("bit"))
    since = bits.groupBy("bit").agg(F.min("first").alias("since"))
    full = bits.join(F.broadcast(since), "bit")  # at most m rows
    return full.groupBy(value).agg(F.first("first").alias("first"), (F.max("since") < F.first("first")).alias("fp"))


def bloom_rate(arrivals: DataFrame, marks: DataFrame, value: str, period: Column) -> DataFrame:
    """(period, n, fp, fpr): running false positives over running arrivals."""
    per = arrivals.select(value, period.alias("period")).join(marks.select(value, "fp"), value).groupBy("period").agg(F.count("*").alias("n"), F.sum(F.col("fp").cast("long")).alias("fp"))
    return running_rate(per)


def running_rate(per: DataFrame) -> DataFrame:
    so_far = W.orderBy("period").rowsBetween(W.unboundedPreceding, 0)  # one row for each period
    return per.select("period", "n", "fp", F.round(F.sum("fp").over(so_far) / F.sum("n").over(so_far), 6).alias("fpr"))


def zero_runs(value: Column, m: int = 65536) -> list[Column]:
    x = string_mod(value, P)
    return [trailing_zeros(linear_hash(x, a, b, p, m)) for a, b, p in HASHES]


def flajolet_martin(rows: DataFrame, ts: str, value: str, length: str, slide: str, m: int = 65536, groups: int = 3) -> DataFrame:
    """(window_start, truth, estimate) over sliding windows, on tables and on streams: the
    largest run of zeros for each hash; means of 2**run in each group of hashes; the median
    of the groups, rounded down. The truth counts a window's distinct values, one row each;
    no task gathers a window's values."""
    seen = rows.select(F.window(ts, length, slide).alias("window"), F.col(value).alias("v"))
    seen = seen.dropDuplicates(["window", "v"]).withColumn("z", F.array(*zero_runs(F.col("v"), m)))
    n = len(HASHES)
    agg = seen.groupBy("window").agg(F.count("v").alias("truth"), *[F.max(F.col("z")[i]).alias(f"z{i}") for i in range(n)])
    size = n // groups
    means = []
    for g in range(groups):
        total = sum((F.pow(F.lit(2.0), F.col(f"z{g * size + i}")) for i in range(size)), F.lit(0.0))
        means.append(total / size)
    middle = F.array_sort(F.array(*means))[groups // 2]
    return agg.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), F.col("truth").cast("long").alias("truth"), F.floor(middle).cast("long").alias("estimate"))


def priority(key: Column, a: int = 48271, b: int = 11, p: int = 2147483647) -> Column:
    return (F.pmod(key, F.lit(p)) * F.lit(a) + F.lit(b)) % F.lit(p)


def reservoir(rows: DataFrame, key: str, size: int = 100) -> DataFrame:
    """The ``size`` rows of the least priorities: a uniform sample that merges and repeats."""
    return rows.withColumn("priority", priority(F.col(key))).orderBy("priority", key).limit(size)


def top_tags(sample: DataFrame, tag: str, ranks: int = 3) -> DataFrame:
    """(tag, n, rank): all tags whose count is among the ``ranks`` highest counts; empty tags do not count."""
    counts = sample.where(F.length(tag) > 0).groupBy(F.col(tag).alias("tag")).agg(F.count("*").alias("n"))
    rank = F.dense_rank().over(W.orderBy(F.desc("n")))  # at most as many rows as the sample
    return counts.withColumn("rank", rank.cast("long")).where(F.col("rank") <= ranks)
