"""Command line: ``python -m lodestone COMMAND ARGUMENTS``, one command for each analysis.

    explore REVIEWS_JSON OUT [YEAR]                  counts and rankings
    partitions REVIEWS_JSON OUT N                    rows of each partition, as read and dealt by key
    cities REVIEWS_JSON BUSINESS_JSON OUT [TIMES]    average stars of each city; seconds for all and for ten
    itemsets CASE SUPPORT CSV OUT                    candidates and frequent itemsets; case 1: baskets are users, 2: businesses
    active-itemsets MORE_THAN SUPPORT CSV OUT        the same, of users with more rows than that
    similar CSV OUT                                  pairs of businesses by Jaccard similarity
    recommend TRAIN_CSV TEST_CSV CASE OUT            1 factorisation, 2 users, 3 items, 4 items by LSH
    communities CSV OUT [LEAST]                      label propagation
    betweenness LEAST CSV OUT_EDGES OUT_COMMUNITIES  edge betweenness and modularity
    cluster CSV CLUSTERS DIMS OUT                    clustering by summaries
    bloom PORT OUT [HOME]                            false positives of a socket stream of {"city": ...}
    distinct PORT OUT [HOME]                         distinct cities of sliding windows of such a stream
    hashtags PORT [WORD...]                          hashtags of a sample of a socket stream of tweets that hold a word

A stream with a HOME goes on there after a restart.
"""

from __future__ import annotations

import sys
import time
from collections.abc import Callable

from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F

from lodestone import streaming
from lodestone.operators import clustering, explore, graph, itemsets, recommend, similarity, sketches
from lodestone.sources import BUSINESS, RATING, append_csv, csv_table, json_field, json_lines, points, socket_stream, tracked, tweets, write_csv, write_json, written

#: Baskets in a chunk of the two-phase algorithm, at most.
CHUNK_BASKETS = 25_000
#: Words that tweets are tracked by, if none are given.
TRACKED = ["data", "ML", "USA", "France", "India"]


def _counted(key: str):
    return lambda x: F.struct(x[key].alias(key), (-x["n"]).alias("n"))


def _explore(s: SparkSession, reviews: str, out: str, year: str = "2018") -> None:
    r = written(json_lines(s, reviews), "reviews")
    one = explore.overview(r, int(year)).groupBy().pivot("metric", ["n_review", "n_review_year", "n_user", "n_business"]).agg(F.first("value"))
    for name, key in (("top10_user", "user_id"), ("top10_business", "business_id")):
        best = explore.top(r, key).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), key))).alias(name))
        one = one.join(F.broadcast(best.select(F.transform(name, _counted(key)).alias(name))))  # one row each
    write_json(one, out)


def _partitions(s: SparkSession, reviews: str, out: str, n: str) -> None:
    """For the partitions as read and as dealt by key: their number, their rows, and the seconds of the top ten."""
    found = {}
    as_read = json_lines(s, reviews).select("business_id")
    for kind, rows in (("default", as_read), ("customized", as_read.repartition(int(n), "business_id"))):
        began = time.perf_counter()
        explore.top(rows, "business_id").collect()  # ten rows
        took = time.perf_counter() - began
        have = {r["partition"]: r["n_items"] for r in explore.partition_sizes(rows).collect()}  # one row for each partition
        number = int(n) if kind == "customized" else rows.rdd.getNumPartitions()
        found[kind] = {"n_partitions": number, "n_items": [have.get(i, 0) for i in range(number)], "exe_time": took}
    write_json(s.createDataFrame([Row(**{k: Row(**v) for k, v in found.items()})]), out)


def _cities(s: SparkSession, reviews: str, business: str, out: str, times: str = "") -> None:
    averages = explore.group_average(json_lines(s, reviews), json_lines(s, business, BUSINESS), "business_id", "city", "stars")
    ranked = explore.ranked_average(averages, "city")
    began = time.perf_counter()
    write_csv(ranked, out, sep="\t")
    whole = time.perf_counter() - began
    if times:  # all cities against the first ten alone
        began = time.perf_counter()
        ranked.take(10)
        write_json(s.createDataFrame([Row(m1=whole, m2=time.perf_counter() - began, explanation="m1 writes all cities; m2 takes ten, which needs no total order")]), times)


def _mined(rows, support: int, out: str) -> None:
    """Candidates of chunks of baskets, then the itemsets, as text."""
    rows = written(rows, "baskets")
    chunks = max(2, -(-rows.select("basket").distinct().count() // CHUNK_BASKETS))
    chunk = F.pmod(F.xxhash64("basket"), F.lit(chunks))
    report = itemsets.full_report(itemsets.local_candidates(rows, chunk, support), itemsets.frequent_itemsets(rows, support))
    report.coalesce(1).write.mode("overwrite").text(out)


def _itemsets(s: SparkSession, case: str, support: str, path: str, out: str) -> None:
    user, item = F.col("user_id"), F.col("business_id")
    _mined(itemsets.baskets(csv_table(s, path), *((user, item) if case == "1" else (item, user))), int(support), out)


def _active(s: SparkSession, more_than: str, support: str, path: str, out: str) -> None:
    _mined(itemsets.baskets(itemsets.active(csv_table(s, path), "user_id", int(more_than)), F.col("user_id"), F.col("business_id")), int(support), out)


def _numbered_users(s: SparkSession, path: str, schema: str):
    """Users and items as numbers by a hash of 31 bits, beside their names."""
    rows = csv_table(s, path, schema) if schema else csv_table(s, path)
    number = lambda c: F.xxhash64(c).bitwiseAND(0x7FFFFFFF)
    return rows.withColumn("user", number("user_id")).withColumn("item", number("business_id"))


def _similar(s: SparkSession, path: str, out: str) -> None:
    sets = written(_numbered_users(s, path, "").select("business_id", "user").distinct(), "sets")
    signed = similarity.signatures(sets, "business_id", "user", 120, similarity.spread_value)
    got = similarity.verify(similarity.candidates(signed, "business_id"), sets, "business_id", "user")
    write_csv(got.select(F.col("a").alias("business_id_1"), F.col("b").alias("business_id_2"), "similarity").orderBy("business_id_1", "business_id_2"), out)


def _recommend(s: SparkSession, train: str, test: str, case: str, out: str) -> None:
    tables = [written(_numbered_users(s, p, RATING).select(F.col("user").alias("user_id"), F.col("item").alias("item_id"), F.col("stars").alias("rating"), F.struct("user_id", "business_id").alias("names")), "ratings") for p in (train, test)]
    a, b = tables
    got = {"1": lambda: recommend.als(a.withColumns({c: F.col(c).cast("int") for c in ("user_id", "item_id")}), b.withColumns({c: F.col(c).cast("int") for c in ("user_id", "item_id")})), "2": lambda: recommend.user_based(a, b), "3": lambda: recommend.item_based(a, b), "4": lambda: recommend.lsh_item_based(a, b, recommend.similar_items(a, "user_id"))}[case]()
    got = written(got.join(b.select("user_id", "item_id", "names", "rating"), ["user_id", "item_id"]), "predicted")
    write_csv(got.select("names.user_id", "names.business_id", "prediction"), out)
    print("RMSE", recommend.rmse(got.drop("rating"), b).first()["rmse"])


def _graph(s: SparkSession, path: str, least: int):
    return written(graph.cooccurrence(csv_table(s, path), "user_id", "business_id", least), "edges")


def _communities(s: SparkSession, path: str, out: str, least: str = "7") -> None:
    write_csv(graph.communities(graph.label_propagation(_graph(s, path, int(least)))).select("members"), out, header=False)


def _betweenness(s: SparkSession, least: str, path: str, out_edges: str, out_communities: str) -> None:
    ranked = written(graph.edge_betweenness(_graph(s, path, int(least))), "betweenness")
    write_csv(ranked.orderBy(F.desc("betweenness"), "a", "b"), out_edges)
    _, groups = graph.modularity_cuts(ranked)
    write_csv(graph.communities(s.createDataFrame(sorted(groups.items()), "node string, label string")).select("members"), out_communities, header=False)


def _cluster(s: SparkSession, path: str, k: str, dims: str, out: str) -> None:
    got, rounds = clustering.bfr(points(s, path, int(dims)), int(k), int(dims))
    for r in rounds:
        print("Round {}: {}, {}, {}, {}".format(*r))
    write_csv(got.orderBy("id"), out)


def _bloom(s: SparkSession, port: str, out: str, home: str = "") -> None:
    bloom_rates(json_field(socket_stream(s, "localhost", int(port)), "city"), out, home, "10 seconds")


def bloom_rates(cities, out: str, home: str = "", trigger: str | None = None) -> None:
    """After each batch the rate of false positives of all arrivals so far is appended."""
    home = streaming.home_of(cities.sparkSession, "bloom", home)
    state = streaming.State(cities.sparkSession, home)

    def each(df, batch: int) -> None:
        arrived = state.put("arrived", batch, df.select("city", F.monotonically_increasing_id().alias("i"), F.lit(0).alias("all")))
        total = streaming.bloom_batch(state, arrived, batch, "city", ["i"], "all")
        now = F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")
        append_csv(total.select(now.alias("Time"), F.round(F.col("fp") / F.col("n"), 6).alias("FPR")), out)

    streaming.run(cities, each, home, trigger=trigger)


def _distinct(s: SparkSession, port: str, out: str, home: str = "") -> None:
    rows = json_field(socket_stream(s, "localhost", int(port)), "city").withColumn("ts", F.current_timestamp())
    distinct_counts(rows, out, home, "5 seconds")


def distinct_counts(rows, out: str, home: str = "", trigger: str | None = None, late: str = "1 minute") -> None:
    """Each window's distinct values and their estimate are appended once it is over."""
    home = streaming.home_of(rows.sparkSession, "distinct", home)
    names = {"window_start": "Time", "truth": "Ground Truth", "estimate": "Estimation"}
    found = sketches.flajolet_martin(rows.withWatermark("ts", late), "ts", "city", "30 seconds", "10 seconds")
    streaming.run(found, lambda df, batch: append_csv(df.withColumnsRenamed(names), out), home, trigger=trigger)


def _hashtags(s: SparkSession, port: str, *words: str) -> None:
    found = tracked(tweets(socket_stream(s, "localhost", int(port))), [*words] or TRACKED)
    streaming.hashtags(found, told, trigger="10 seconds")


def told(total: int, top) -> None:
    print(f"The number of tweets with tags from the beginning: {total}")
    for r in top.collect():  # three ranks of a sample
        print(f"{r['tag']}:{r['n']}")


COMMANDS: dict[str, Callable[..., None]] = {
    "explore": _explore, "partitions": _partitions, "cities": _cities, "itemsets": _itemsets, "active-itemsets": _active, "similar": _similar, "recommend": _recommend,
    "communities": _communities, "betweenness": _betweenness, "cluster": _cluster, "bloom": _bloom, "distinct": _distinct, "hashtags": _hashtags,
}


def main(args: list[str]) -> int:
    if not args or args[0] not in COMMANDS:
        print(__doc__)
        return 2
    COMMANDS[args[0]](SparkSession.builder.appName(f"lodestone {args[0]}").getOrCreate(), *args[1:])
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
