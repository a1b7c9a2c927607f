"""Sharding by a hypergeometric communication matrix, in DataFrame functions only.

A uniform shuffle of all rows into shards of exact sizes: rows are counted by
partition; the number of rows that each partition sends to each shard is drawn
from the multivariate hypergeometric distribution, so that rows and columns of
this matrix have exact sums; each partition permutes its rows and cuts them by
its row of the matrix; after the exchange each shard permutes again.

Only counts come to the driver: one number for each partition. Permutations are
orders by a hash of a row number, so that a task which is run again finds the
same. No task sorts a whole shard: slots are dealt by ranges of the hash.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.llm.common import written

#: Rows that one task orders at a time, about.
RANGE_ROWS = 1 << 16


def matrix(counts: list[int], shards: int, seed: int) -> list[list[int]]:
    """Rows for each partition (its sum: the partition's count), columns for each shard
    (sums at most one apart), drawn as a uniform shuffle would fill them."""
    total, rng = sum(counts), np.random.default_rng(seed)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    out = []
    for n in counts:
        row, left = [], sum(room)
        for size in room:
            left -= size
            row.append(drawn(rng, size, left, n))
            n -= row[-1]
        room = [size - got for size, got in zip(room, row, strict=True)]
        out.append(row)
    return out


def drawn(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of ``n`` drawn without return from ``good`` and ``bad`` are good, at any size.

    The hypergeometric law is inverted: its probabilities follow from the mode by the exact
    ratios of neighbours, as far as 12 standard deviations on both sides, beyond which
    less than 1e-30 lies; the sum of what they are makes them probabilities."""
    least, most = max(0, n - bad), min(n, good)
    if least == most:
        return least
    total = good + bad
    mode = min(most, max(least, (n + 1) * (good + 1) // (total + 2)))
    wide = 32 + int(12 * math.sqrt(n * (good / total) * (bad / total) * ((total - n) / max(1, total - 1))))
    first, last = max(least, mode - wide), min(most, mode + wide)
    k = np.arange(first, last, dtype=np.float64)
    up = np.log(good - k) + np.log(n - k) - np.log(k + 1) - np.log(bad - n + k + 1)
    weight = np.concatenate(([0.0], np.cumsum(up)))
    below = np.cumsum(np.exp(weight - weight.max()))
    return first + int(np.searchsorted(below, rng.random() * below[-1], side="right"))


def shuffle(docs: DataFrame, *, key: str = "doc_id", text: str = "text", shards: int = 24, seed: int = 17) -> DataFrame:
    """One row for each row of ``docs``: the key, ``size`` (UTF-8 bytes of the text, null:
    none, plus 8), ``text_crc32`` (null text: that of no bytes), ``law`` ("rows"),
    ``shard`` (0 to ``shards`` - 1, counts at most one apart), ``slot`` (gapless from 0 in
    its shard) and ``grown_shard`` (null under this law).

    Null keys and repeated rows are rows like others; fewer rows than shards leave
    shards empty; an empty table gives an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    # Written once: the row number u, whose upper bits are the partition, must not change between the passes.
    rows = written(docs.select(F.col(key).alias("k"), (F.octet_length(body).cast("long") + 8).alias("size"), F.crc32(body).alias("text_crc32"), F.monotonically_increasing_id().alias("u")), "sharding-rows")
    part = F.shiftright("u", 33)
    counts = sorted((r.p, r.n) for r in rows.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())  # one row for each partition
    total = sum(n for _, n in counts)
    sent = matrix([n for _, n in counts], shards, seed)
    cuts = spark.createDataFrame([(p, [int(x) for x in np.cumsum(row)]) for (p, _), row in zip(counts, sent, strict=True)], "p long, cuts array<long>")
    local = W.partitionBy("p").orderBy(F.xxhash64(F.lit(seed), "u"), "u")
    dealt = rows.withColumn("p", part).join(cuts, "p").withColumn("at", F.row_number().over(local)).withColumn("shard", F.expr("cast(size(filter(cuts, c -> c < at)) as int)"))
    # Ranges of a second hash order each shard: counts before a range, then the rank in it.
    bits = max(0, (total // (shards * RANGE_ROWS)).bit_length())
    r2 = F.xxhash64(F.lit(seed + 1), "u")
    dealt = dealt.select("k", "size", "text_crc32", "u", "shard", (F.shiftrightunsigned(r2, 64 - bits) if bits else F.lit(0).cast("long")).alias("range"))
    before = dealt.groupBy("shard", "range").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(W.partitionBy("shard").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    rank = F.row_number().over(W.partitionBy("shard", "range").orderBy(r2, "u"))
    out = dealt.join(before.drop("n"), ["shard", "range"]).withColumn("slot", (F.col("before") + rank - 1).cast("long"))
    return out.select(F.col("k").alias(key), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
