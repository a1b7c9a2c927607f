"""One query for each operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import decontaminate, jaccard_join, language_id, license_scan, lm_score, packing, quality, sharding, topk, toxicity
from lodestone.llm.common import fold
from lodestone.llm.oracle import ORACLE_SQL

__all__ = ["ORACLE_SQL", "QUERIES"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", fold(F.col("doc_id"), 5) == 0)
    model = language_id.train(docs.where(~F.col("held_out")))
    return language_id.predict(docs, model, carry=["doc_id", "held_out"])


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", fold(F.col("doc_id"), 10) == 0)
    return lm_score.score(docs, ~F.col("held_out"), carry=["doc_id", "held_out"])


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.classes(table(spark, sf_dir, "documents"), words=3, num=90, den=100)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", fold(F.col("doc_id"), 5) == 0)
    labels = table(spark, sf_dir, "labels").where(fold(F.col("doc_id"), 5) != 0)
    return toxicity.score(docs, toxicity.train(docs, labels), carry=["doc_id", "held_out"])


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("long"))
    vectors = topk.clean(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", whole)
    return topk.top_k(vectors, vectors.where(F.col("id") % 50 == 0), k=5)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A page's file is its address without scheme, query and fragment; its text is what stands between tags.
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    return license_scan.scan(table(spark, sf_dir, "pages"), key="page_id", path=path, text=F.regexp_replace("html", "<[^>]*>", "\n"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shuffle(table(spark, sf_dir, "documents"), shards=24)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_quality": op2_quality,
    "op3_lm_score": op3_lm_score,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_decontaminate": op5_decontaminate,
    "op6_toxicity": op6_toxicity,
    "op7_topk": op7_topk,
    "op8_license_scan": op8_license_scan,
    "op9_packing": op9_packing,
    "op10_sharding": op10_sharding,
}
