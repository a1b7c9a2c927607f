"""Exploration of reviews: counts, rankings, partition sizes, joined averages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def overview(reviews: DataFrame, year: int, user: str = "user_id", item: str = "business_id", date: str = "date") -> DataFrame:
    """(metric, value): rows, rows of a year, distinct users and items, in one pass."""
    of_year = F.substring(F.col(date).cast("string"), 1, 4) == str(year)
    one = reviews.agg(
        F.count("*").alias("n_review"),
        F.coalesce(F.sum(of_year.cast("long")), F.lit(0)).alias("n_review_year"),
        F.countDistinct(user).alias("n_user"),
        F.countDistinct(item).alias("n_business"),
    )
    return one.unpivot([], ["n_review", "n_review_year", "n_user", "n_business"], "metric", "value")


def top(rows: DataFrame, key: str, k: int = 10, count: str = "n") -> DataFrame:
    """The k keys with the most rows, ties by key."""
    return rows.groupBy(key).agg(F.count("*").alias(count)).orderBy(F.desc(count), F.asc(key)).limit(k)


def group_average(facts: DataFrame, dim: DataFrame, on: str, group: str, value: str, name: str = "avg_stars") -> DataFrame:
    """Average of ``value`` by the dimension's group. Facts are summed by the join key
    first, so that what is joined is one row for each key."""
    sums = facts.groupBy(on).agg(F.sum(value).alias("s"), F.count(value).alias("c"))
    both = sums.join(dim.select(on, group), on)
    return both.groupBy(group).agg(F.round(F.sum("s") / F.sum("c"), 6).alias(name))


def ranked_average(averages: DataFrame, group: str, name: str = "avg_stars") -> DataFrame:
    return averages.orderBy(F.desc(name), F.asc(group))


def partition_sizes(rows: DataFrame, key: Column | None = None, n: int | None = None) -> DataFrame:
    """(partition, n_items): as the rows lie, or dealt by ``key`` modulo ``n``."""
    part = F.spark_partition_id() if key is None else F.pmod(key, F.lit(n))
    return rows.groupBy(part.cast("long").alias("partition")).agg(F.count("*").alias("n_items"))
