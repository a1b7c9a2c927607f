"""Readers and writers: the standard tables, reviews, interactions, points and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

REVIEW = "user_id string, business_id string, date string, stars double"
BUSINESS = "business_id string, city string"
INTERACTION = "user_id string, business_id string"
RATING = "user_id string, business_id string, stars double"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def json_lines(spark: SparkSession, path: str, schema: str = REVIEW) -> DataFrame:
    """JSON-lines files under an explicit schema; fields outside it are not parsed."""
    return spark.read.schema(schema).json(path)


def csv_table(spark: SparkSession, path: str, schema: str = INTERACTION) -> DataFrame:
    """CSV with a header, quote-aware; only real header lines go, not rows that equal them."""
    return spark.read.schema(schema).csv(path, header=True)


def points(spark: SparkSession, path: str, dims: int) -> DataFrame:
    """(id, label, features) from CSV without header: index, label, then ``dims`` numbers."""
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("label", T.IntegerType()), *(T.StructField(f"x{i}", T.DoubleType()) for i in range(dims))])
    return spark.read.schema(schema).csv(path).select("id", "label", F.array(*[f"x{i}" for i in range(dims)]).alias("features"))


def socket_stream(spark: SparkSession, host: str, port: int) -> DataFrame:
    """Lines of a text socket as a stream, column ``value``."""
    return spark.readStream.format("socket").option("host", host).option("port", port).load()


def file_stream(spark: SparkSession, path: str, schema: str | T.StructType, files_per_batch: int = 1) -> DataFrame:
    """Parquet files of a folder or pattern as a stream, the oldest first."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def json_field(stream: DataFrame, field: str, column: str = "value") -> DataFrame:
    """One string field of JSON lines, lines without it dropped."""
    return stream.select(F.get_json_object(column, f"$.{field}").alias(field)).where(F.col(field).isNotNull())


def tracked(stream: DataFrame, words: list[str], language: str = "en", text: str = "text", lang: str = "lang") -> DataFrame:
    """Rows in a language whose text holds any of the words, whatever their case."""
    low = F.lower(F.col(text))
    hit = F.lit(False)
    for w in words:
        hit = hit | low.contains(w.lower())
    return stream.where((F.col(lang) == language) & hit)


def tweets(stream: DataFrame, column: str = "value") -> DataFrame:
    """(text, lang, tags) of JSON lines with ``text``, ``lang`` and ``entities.hashtags[].text``."""
    parsed = F.from_json(column, "text string, lang string, entities struct<hashtags: array<struct<text: string>>>")
    row = stream.select(parsed.alias("t"))
    tags = F.filter(F.coalesce(F.col("t.entities.hashtags.text"), F.array().cast("array<string>")), lambda x: F.length(x) > 0)
    return row.select("t.text", "t.lang", tags.alias("tags")).where("text is not null")


def write_json(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str, sep: str = ",", header: bool = True) -> None:
    df.write.mode("overwrite").csv(path, sep=sep, header=header)


def append_csv(df: DataFrame, path: str) -> None:
    """One batch's rows added to a CSV folder, for use in ``foreachBatch``."""
    df.write.mode("append").csv(path, header=True)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Only a session on one
    machine gets one beside its warehouse where that is unset; a cluster must name it."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/lodestone-checkpoints")
    return context._jsc.sc().getCheckpointDir().get()


#: Paths of the tables that this process has settled and not released.
_settled: list[str] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: lineage ends here and any executor can read it again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _settled.append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Removes all tables that :func:`written` has settled so far, once no result that reads them is
    needed any more; how many there were. Until then they stay, so that any lost task can read them."""
    conf, n = spark.sparkContext._jsc.hadoopConfiguration(), len(_settled)
    while _settled:
        path = spark._jvm.org.apache.hadoop.fs.Path(_settled.pop())
        path.getFileSystem(conf).delete(path, True)
    return n


def numbered(df: DataFrame, order: list[Column], name: str = "rn") -> DataFrame:
    """Rows numbered from 1 in a total order, without gathering them: ranges are sorted
    apart, and a range's rows start after the counts of those before it."""
    spark = df.sparkSession
    ranged = written(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_at", 33)
    counts = sorted((r.p, r.n) for r in ranged.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())  # one row for each range
    before, rows = 0, []
    for p, n in counts:
        rows.append((p, before - (p << 33)))
        before += n
    shift = spark.createDataFrame(rows, "_p long, _shift long")
    return ranged.withColumn("_p", part).join(F.broadcast(shift), "_p").withColumn(name, F.col("_at") + F.col("_shift") + 1).drop("_p", "_at", "_shift")


def dense(df: DataFrame, column: str, name: str = "dense_id") -> DataFrame:
    """``df`` with the rank of each value of a column among the distinct ones, from 0 without gaps; null values have none."""
    ids = numbered(df.select(column).where(F.col(column).isNotNull()).distinct(), [F.col(column)], "_rank")
    return df.join(ids.select(column, (F.col("_rank") - 1).alias(name)), column, "left").select(*df.columns, name)
