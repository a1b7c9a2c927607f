"""The queries: operators applied to the standard tables, over all their rows."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone import streaming
from lodestone.operators import clustering, explore, graph, itemsets, recommend, similarity, sketches
from lodestone.sources import file_stream, load, written

YEAR = 1998
#: Baskets in a chunk of the two-phase algorithm, at most.
CHUNK_BASKETS = 25_000
BANDS, ROWS = 30, 4
#: Parts that are handed to all executors, at most (some 60 bytes for each); more are joined by a shuffle.
PARTS = 2_000_000
#: Items that the two users of an edge share, at least.
SHARED = 2


def reviews(spark: SparkSession, d: str) -> DataFrame:
    orders, lines = load(spark, d, "orders"), load(spark, d, "lineitem")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("business_id"), (F.col("l_quantity") / 10).alias("stars"), F.col("o_orderdate").alias("date"))


def review_overview(spark: SparkSession, d: str) -> DataFrame:
    return explore.overview(reviews(spark, d), YEAR)


def top10_users(spark: SparkSession, d: str) -> DataFrame:
    return explore.top(reviews(spark, d), "user_id")


def top10_items(spark: SparkSession, d: str) -> DataFrame:
    return explore.top(load(spark, d, "lineitem").select(F.col("l_partkey").alias("business_id")), "business_id")


def city_averages(spark: SparkSession, d: str) -> DataFrame:
    nation = load(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("city"))
    dim = load(spark, d, "supplier").join(nation, "s_nationkey").select(F.col("s_suppkey").alias("l_suppkey"), "city")
    return explore.group_average(load(spark, d, "lineitem"), dim, "l_suppkey", "city", "l_quantity")


def city_avg_stars(spark: SparkSession, d: str) -> DataFrame:
    return explore.ranked_average(city_averages(spark, d), "city")


def city_top10(spark: SparkSession, d: str) -> DataFrame:
    return explore.ranked_average(city_averages(spark, d), "city").limit(10)


def partition_sizes(spark: SparkSession, d: str) -> DataFrame:
    return explore.partition_sizes(load(spark, d, "lineitem"), F.col("l_orderkey"), 8)


def brand_baskets(spark: SparkSession, d: str) -> DataFrame:
    lines, part = load(spark, d, "lineitem"), load(spark, d, "part")
    return itemsets.baskets(lines.join(part, lines.l_partkey == part.p_partkey), F.col("l_orderkey"), F.col("p_brand"))


def event_items(spark: SparkSession, d: str) -> DataFrame:
    """(user, item): an item is a day and a type of event."""
    return load(spark, d, "events").select(F.col("user_id").alias("user"), F.concat_ws("-", F.date_format("ts", "yyyyMMdd"), "event_type").alias("item"))


def _support(rows: DataFrame, share: float) -> int:
    return max(1, math.ceil(rows.select("basket").distinct().count() * share))


def son_frequent_itemsets_case1(spark: SparkSession, d: str) -> DataFrame:
    rows = written(brand_baskets(spark, d), "baskets")
    return itemsets.frequent_itemsets(rows, _support(rows, 0.004))


def son_frequent_itemsets_case2(spark: SparkSession, d: str) -> DataFrame:
    rows = written(itemsets.baskets(event_items(spark, d), F.col("item"), F.col("user").cast("string")), "baskets")
    return itemsets.frequent_itemsets(rows, _support(rows, 0.2))


def son_active_users(spark: SparkSession, d: str) -> DataFrame:
    rows = written(itemsets.baskets(itemsets.active(event_items(spark, d), "user", 60), F.col("user"), F.col("item")), "baskets")
    return itemsets.frequent_itemsets(rows, _support(rows, 0.2))


def son_local_candidates(spark: SparkSession, d: str) -> DataFrame:
    rows = written(brand_baskets(spark, d), "baskets")
    chunks = max(4, -(-rows.select("basket").distinct().count() // CHUNK_BASKETS))
    return itemsets.local_candidates(rows, F.col("basket") % chunks, _support(rows, 0.01))


def minhash_signature(spark: SparkSession, d: str) -> DataFrame:
    signed = similarity.signatures(event_items(spark, d), "item", "user", 120)
    return signed.select("item", F.posexplode("signature").alias("v", "minhash")).select("item", F.col("v").cast("long").alias("v"), "minhash")


def doc_tokens(spark: SparkSession, d: str) -> DataFrame:
    words = load(spark, d, "documents").select("doc_id", F.explode(F.split(F.lower("text"), "[ \\t\\n\\r\\f]+")).alias("token"))
    return words.where("token <> ''").distinct().select("doc_id", "token", F.conv(F.substring(F.md5("token"), 1, 7), 16, 10).cast("long").alias("token_id"))


def doc_sets(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, tokens): each document's distinct tokens as one row; rows of one id are one set."""
    rows = load(spark, d, "documents").select("doc_id", F.array_remove(F.array_distinct(F.split(F.lower("text"), "[ \\t\\n\\r\\f]+")), "").alias("tokens"))
    return similarity.merged(rows.where(F.size("tokens") > 0), load(spark, d, "documents").select("doc_id"), "doc_id", "tokens")


def _lsh_candidates(tokens: DataFrame) -> DataFrame:
    signed = similarity.signatures(tokens, "doc_id", "token_id", BANDS * ROWS, similarity.spread_value)
    return similarity.candidates(signed, "doc_id", BANDS, ROWS)


def lsh_candidate_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _lsh_candidates(doc_tokens(spark, d))


def lsh_jaccard_pairs(spark: SparkSession, d: str) -> DataFrame:
    return similarity.similar_sets(doc_sets(spark, d), "doc_id", "tokens", BANDS, ROWS, 0.5)


def exact_jaccard_pairs(spark: SparkSession, d: str) -> DataFrame:
    return similarity.exact_sets(doc_sets(spark, d), "doc_id", "tokens", 0.5)


def ratings(spark: SparkSession, d: str) -> DataFrame:
    """(user_id, item_id, rating, held): suppliers rate brands; a tenth of the cells is held out."""
    lines, part = load(spark, d, "lineitem"), load(spark, d, "part").select("p_partkey", "p_brand")
    part = F.broadcast(part) if part.count() <= PARTS else part
    cells = lines.join(part, lines.l_partkey == part.p_partkey).groupBy(F.col("l_suppkey").alias("user_id"), F.col("p_brand").alias("brand")).agg(F.round(F.avg("l_quantity") / 10, 4).alias("rating"))
    number = F.regexp_extract("brand", "([0-9]+)$", 1).cast("int")
    return cells.select("user_id", number.alias("item_id"), "rating", ((F.col("user_id") * 31 + number) % 10 == 0).alias("held"))


def _split(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = written(ratings(spark, d), "ratings")
    return rows.where("not held").drop("held"), rows.where("held").drop("held")


def pearson_user_pairs(spark: SparkSession, d: str) -> DataFrame:
    return recommend.pearson_pairs(written(ratings(spark, d), "ratings"), "user_id", "item_id", 5)


def pearson_item_pairs(spark: SparkSession, d: str) -> DataFrame:
    return recommend.pearson_pairs(written(ratings(spark, d), "ratings"), "item_id", "user_id", 2)


def user_cf_predict(spark: SparkSession, d: str) -> DataFrame:
    train, test = _split(spark, d)
    return recommend.user_based(train, test, neighbour_ratings=10)


def user_cf_rmse(spark: SparkSession, d: str) -> DataFrame:
    train, test = _split(spark, d)
    return recommend.rmse(recommend.user_based(train, test, neighbour_ratings=10), test)


def item_cf_predict(spark: SparkSession, d: str) -> DataFrame:
    train, test = _split(spark, d)
    return recommend.item_based(train, test, user_ratings=10)


def item_cf_rmse(spark: SparkSession, d: str) -> DataFrame:
    train, test = _split(spark, d)
    return recommend.rmse(recommend.item_based(train, test, user_ratings=10), test)


def lsh_item_cf_predict(spark: SparkSession, d: str) -> DataFrame:
    train, test = _split(spark, d)
    return recommend.lsh_item_based(train, test, recommend.similar_items(train, "user_id"))


def lsh_item_cf_rmse(spark: SparkSession, d: str) -> DataFrame:
    train, test = _split(spark, d)
    return recommend.rmse(recommend.lsh_item_based(train, test, recommend.similar_items(train, "user_id")), test)


def als_predict(spark: SparkSession, d: str) -> DataFrame:
    train, test = _split(spark, d)
    return recommend.als(train, test)


def _hours(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").select("user_id", F.concat_ws("-", F.date_format("ts", "yyyyMMddHH"), "event_type").alias("item"))


def _edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges of users that share the more items, the more users there are; :func:`coreview_edges` has all, whatever their number."""
    hours = _hours(spark, d)
    users = max(1, hours.select("user_id").distinct().count())
    return written(graph.cooccurrence(hours, "user_id", "item", SHARED + int(math.log10(users))), "edges")


def coreview_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.cooccurrence(_hours(spark, d), "user_id", "item", SHARED)


def vertex_degrees(spark: SparkSession, d: str) -> DataFrame:
    return graph.cooccurrence_degrees(_hours(spark, d), "user_id", "item", SHARED)


def label_propagation(spark: SparkSession, d: str) -> DataFrame:
    return graph.cooccurrence_labels(_hours(spark, d), "user_id", "item", SHARED)


def label_communities(spark: SparkSession, d: str) -> DataFrame:
    return graph.communities(graph.label_propagation(_edges(spark, d)))


def connected_components(spark: SparkSession, d: str) -> DataFrame:
    return graph.cooccurrence_components(_hours(spark, d), "user_id", "item", SHARED)


def edge_betweenness(spark: SparkSession, d: str) -> DataFrame:
    return graph.edge_betweenness(_edges(spark, d))


def modularity_curve(spark: SparkSession, d: str) -> DataFrame:
    edges = written(coreview_edges(spark, d), "edges")
    curve, _ = graph.modularity_cuts(written(graph.edge_betweenness(edges), "betweenness"))
    return spark.createDataFrame([(int(i), int(n), round(q, 6)) for i, n, q in curve], "removed long, communities long, modularity double")


def modularity_communities(spark: SparkSession, d: str) -> DataFrame:
    _, groups = graph.modularity_cuts(written(graph.edge_betweenness(_edges(spark, d)), "betweenness"))
    return graph.communities(spark.createDataFrame(sorted(groups.items()), "node long, label long"))


def points(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("features"))


def bfr_summary(spark: SparkSession, d: str) -> DataFrame:
    return clustering.long_form(clustering.summaries(points(spark, d), "label", 64), "label")


def bfr_mahalanobis_assign(spark: SparkSession, d: str) -> DataFrame:
    rows = written(clustering.chunked(points(spark, d)), "points")
    clusters = clustering.collect(clustering.summaries(rows.where("chunk = 1"), "label", 64), "label")
    got = clustering.assign(rows.where("chunk > 1"), clusters, 2 * math.sqrt(64))
    return got.select("id", "cluster", F.round("distance", 4).alias("distance"))


def bfr_cluster(spark: SparkSession, d: str) -> DataFrame:
    return clustering.bfr(points(spark, d), 10, 64)[0]


def bfr_rounds(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(clustering.bfr(points(spark, d), 10, 64)[1], "round long, ds_points long, cs long, cs_points long, rs_points long")


def arrivals(events: DataFrame) -> DataFrame:
    return events.select(F.col("user_id").cast("string").alias("v"), F.struct("ts", "event_id").alias("at"), F.date_format("ts", "yyyy-MM-dd").alias("day"))


def bloom_fpr_by_day(spark: SparkSession, d: str) -> DataFrame:
    rows = arrivals(load(spark, d, "events"))
    return sketches.bloom_rate(rows, sketches.bloom_marks(rows, "v", "at"), "v", F.col("day"))


def fm_sliding_distinct(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "events").select("ts", F.col("user_id").cast("string").alias("v"))
    return sketches.flajolet_martin(rows, "ts", "v", "3 days", "1 day")


def reservoir_top_tags(spark: SparkSession, d: str) -> DataFrame:
    return sketches.top_tags(sketches.reservoir(load(spark, d, "events"), "event_id"), "event_type")


def _stream(spark: SparkSession, d: str) -> DataFrame:
    return file_stream(spark, f"{d}/events.parquet*", load(spark, d, "events").schema)


def stream_fm(spark: SparkSession, d: str) -> DataFrame:
    return streaming.fm(_stream(spark, d).select("ts", F.col("user_id").cast("string").alias("v")), "ts", "v", "3 days", "1 day")


def stream_bloom(spark: SparkSession, d: str) -> DataFrame:
    rows = _stream(spark, d).select(F.col("user_id").cast("string").alias("v"), "ts", "event_id", F.date_format("ts", "yyyy-MM-dd").alias("period"))
    return streaming.bloom(rows, "v", ["ts", "event_id"], "period")


def stream_reservoir(spark: SparkSession, d: str) -> DataFrame:
    return streaming.reservoir(_stream(spark, d), "event_id", "event_type")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        review_overview, top10_users, top10_items, city_avg_stars, city_top10, partition_sizes,
        son_frequent_itemsets_case1, son_frequent_itemsets_case2, son_active_users, son_local_candidates,
        minhash_signature, lsh_candidate_pairs, lsh_jaccard_pairs, exact_jaccard_pairs,
        pearson_user_pairs, pearson_item_pairs, user_cf_predict, user_cf_rmse, item_cf_predict, item_cf_rmse,
        lsh_item_cf_predict, lsh_item_cf_rmse, als_predict,
        coreview_edges, vertex_degrees, label_propagation, label_communities, connected_components, edge_betweenness, modularity_curve, modularity_communities,
        bfr_summary, bfr_mahalanobis_assign, bfr_cluster, bfr_rounds,
        bloom_fpr_by_day, fm_sliding_distinct, reservoir_top_tags, stream_fm, stream_bloom, stream_reservoir,
    )
}
