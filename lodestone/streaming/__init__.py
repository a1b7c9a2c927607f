"""Structured Streaming forms of the sketches.

State that Spark's operators cannot hold (a filter's positions, a sample) is a small
table in the stream's home, renewed by each batch. The batch number names it: a batch that
is run again, after a restart too, starts from the state before it. A stream whose home is
given goes on where it stopped; otherwise its home is a new folder of the shared one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import sketches
from lodestone.sources import shared_dir


def home_of(spark: SparkSession, kind: str, home: str | None) -> str:
    return home or f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def run(stream: DataFrame, each: Callable[[DataFrame, int], None], home: str, mode: str = "append", trigger: str | None = None) -> None:
    """Runs a query over what is there (or at an interval such as "10 seconds", until stopped)."""
    writer = stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", f"{home}/checkpoint")
    writer = writer.trigger(availableNow=True) if trigger is None else writer.trigger(processingTime=trigger)
    writer.start().awaitTermination()


class State:
    """Tables by name and batch in a stream's home; of each the last two batches stay."""

    def __init__(self, spark: SparkSession, home: str):
        self.spark, self.home = spark, home
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(home).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _batches(self, name: str) -> list[int]:
        folder = self.path(f"{self.home}/{name}")
        if not self.fs.exists(folder):
            return []
        found = [s.getPath().getName() for s in self.fs.listStatus(folder)]
        return sorted(int(b) for b in found if b.isdigit() and self.fs.exists(self.path(f"{self.home}/{name}/{b}/_SUCCESS")))

    def put(self, name: str, batch: int, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.home}/{name}/{batch}")
        for old in [b for b in self._batches(name) if b < batch - 1]:
            self.fs.delete(self.path(f"{self.home}/{name}/{old}"), True)
        return self.spark.read.schema(df.schema).parquet(f"{self.home}/{name}/{batch}")

    def get(self, name: str, before: int | None = None) -> DataFrame | None:
        """The table of the last batch, or of the last one before a batch."""
        have = [b for b in self._batches(name) if before is None or b < before]
        return self.spark.read.parquet(f"{self.home}/{name}/{have[-1]}") if have else None


def fm(stream: DataFrame, ts: str, value: str, length: str, slide: str, late: str = "60 days", home: str | None = None) -> DataFrame:
    """The windows' estimates after all that the stream has; late rows up to ``late`` count."""
    home = home_of(stream.sparkSession, "stream-fm", home)
    state = State(stream.sparkSession, home)
    marked = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    run(sketches.flajolet_martin(marked, ts, value, length, slide), lambda df, b: state.put("windows", b, df) and None, home, "complete")
    return state.get("windows")


def bloom_batch(state: State, df: DataFrame, batch: int, value: str, order: list[str], period: str, m: int = 199) -> DataFrame:
    """Takes a batch into the filter's state; (period, n, fp) so far. Only the batch's rows and
    the values and positions seen before are read, never earlier arrivals."""
    df = df.select(F.col(value).alias("v"), F.struct(F.lit(batch).alias("batch"), *order).alias("at"), F.col(period).alias("period"))
    known, since, old = (state.get(x, batch) for x in ("values", "since", "periods"))
    firsts = df.groupBy("v").agg(F.min("at").alias("first"))
    if known is not None:
        firsts = firsts.join(known.select("v"), "v", "left_anti")
    bits = firsts.select("v", "first", F.explode(F.array_distinct(sketches.slots(F.col("v"), m))).alias("bit"))
    now = bits.groupBy("bit").agg(F.min("first").alias("since"))
    if since is not None:
        now = now.unionByName(since).groupBy("bit").agg(F.min("since").alias("since"))
    now = state.put("since", batch, now)
    new = bits.join(F.broadcast(now), "bit").groupBy("v").agg((F.max("since") < F.first("first")).alias("fp"))  # m rows at most
    seen = state.put("values", batch, new if known is None else known.unionByName(new))
    per = df.join(seen, "v").groupBy("period").agg(F.count("*").alias("n"), F.sum(F.col("fp").cast("long")).alias("fp"))
    return state.put("periods", batch, per if old is None else old.unionByName(per).groupBy("period").agg(F.sum("n").alias("n"), F.sum("fp").alias("fp")))


def bloom(stream: DataFrame, value: str, order: list[str], period: str, m: int = 199, home: str | None = None) -> DataFrame:
    """(period, n, fp, fpr) as :func:`sketches.bloom_rate`; arrival is by batch, then ``order``."""
    home = home_of(stream.sparkSession, "stream-bloom", home)
    state = State(stream.sparkSession, home)
    run(stream, lambda df, batch: bloom_batch(state, df, batch, value, order, period, m) and None, home)
    return sketches.running_rate(state.get("periods"))


def sample_batch(state: State, df: DataFrame, batch: int, key: str, columns: list[str], size: int = 100) -> DataFrame:
    """The uniform sample of all rows so far, a batch taken in."""
    old = state.get("sample", batch)
    df = df.select(key, *columns)
    return state.put("sample", batch, sketches.reservoir(df if old is None else df.unionByName(old), key, size).select(key, *columns))


def reservoir(stream: DataFrame, key: str, tag: str, size: int = 100, ranks: int = 3, home: str | None = None) -> DataFrame:
    """The most frequent tags of a uniform sample of the stream."""
    home = home_of(stream.sparkSession, "stream-reservoir", home)
    state = State(stream.sparkSession, home)
    run(stream, lambda df, batch: sample_batch(state, df, batch, key, [tag], size) and None, home)
    return sketches.top_tags(state.get("sample"), tag, ranks)


def hashtags(tweets: DataFrame, each: Callable[[int, DataFrame], None], *, size: int = 100, ranks: int = 3, home: str | None = None, trigger: str | None = None) -> None:
    """Of tweets (text, tags): after each batch ``each`` gets the number of tweets with tags so
    far and the most frequent tags, (tag, n, rank), of a uniform sample of these tweets."""
    spark = tweets.sparkSession
    home = home_of(spark, "stream-hashtags", home)
    state = State(spark, home)

    def one(df: DataFrame, batch: int) -> None:
        # A tweet's place in the stream, hashed: a priority that no other tweet has.
        df = df.where("size(tags) > 0").withColumn("id", F.xxhash64(F.lit(batch), F.monotonically_increasing_id(), "text"))
        df = state.put("arrived", batch, df.select("id", "tags"))
        before = state.get("total", batch)
        total = df.count() + (before.first()["n"] if before is not None else 0)
        state.put("total", batch, spark.range(1).select(F.lit(total).cast("long").alias("n")))
        sample = sample_batch(state, df, batch, "id", ["tags"], size)
        each(total, sketches.top_tags(sample.select(F.explode("tags").alias("tag")), "tag", ranks).orderBy("rank", "tag"))

    run(tweets, one, home, trigger=trigger)
