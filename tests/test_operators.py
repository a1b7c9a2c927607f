"""Hand-checked fixtures and invariants."""

import hashlib
import itertools
import math
import random
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone import streaming
from lodestone.functions import HASHES, jaccard, linear_hash, mahalanobis, string_mod, subset, trailing_zeros
from lodestone.operators import blocks, clustering, explore, graph, itemsets, recommend, similarity, sketches
from lodestone.operators.blocks import over_pairs
from lodestone.sources import append_csv, csv_table, dense, file_stream, json_field, json_lines, load, numbered, points, release, tracked, write_csv, write_json, written


def test_overview_and_tops(spark):
    r = spark.createDataFrame([("u1", "a", "2018-01-02", 5.0), ("u1", "b", "2018-03-01", 3.0), ("u2", "a", "2017-05-05", 4.0), ("u3", "c", "2018-07-07", 1.0)], "user_id string, business_id string, date string, stars double")
    assert dict(map(tuple, explore.overview(r, 2018).collect())) == {"n_review": 4, "n_review_year": 3, "n_user": 3, "n_business": 3}
    assert [tuple(x) for x in explore.top(r, "user_id").collect()] == [("u1", 2), ("u2", 1), ("u3", 1)]
    cities = spark.createDataFrame([("a", "Tempe"), ("b", "Tempe "), ("c", ""), ("d", "Mesa")], "business_id string, city string")
    got = explore.ranked_average(explore.group_average(r, cities, "business_id", "city", "stars"), "city").collect()
    assert [tuple(x) for x in got] == [("Tempe", 4.5), ("Tempe ", 3.0), ("", 1.0)]
    assert sum(x.n_items for x in explore.partition_sizes(r.repartition(3)).collect()) == 4


def test_itemsets_by_hand(spark):
    b = spark.createDataFrame([(0, "ab"), (0, "cd"), (1, "ab"), (1, "cd"), (1, "ef"), (2, "ab"), (2, "ef"), (3, "cd")], "basket int, item string")
    got = {(r.size, r.itemset): r.support for r in itemsets.frequent_itemsets(b, 2).collect()}
    assert got == {(1, "ab"): 3, (1, "cd"): 3, (1, "ef"): 2, (2, "ab,cd"): 2, (2, "ab,ef"): 2}
    assert [r.basket for r in itemsets.active(b, "basket", 2).select("basket").distinct().collect()] == [1]
    assert [r.line for r in itemsets.text_report(itemsets.frequent_itemsets(b, 2)).collect()] == ["('ab'),('cd'),('ef')", "('ab', 'cd'),('ab', 'ef')"]


def test_itemsets_equal_fpgrowth_and_are_monotone(spark):
    from pyspark.ml.fpm import FPGrowth

    rng = random.Random(1)
    rows = sorted({(i, f"i{rng.choice('aabbccdefg')}") for i in range(200) for _ in range(5)})
    b = spark.createDataFrame(rows, "basket int, item string")
    got = {r.itemset: r.support for r in itemsets.frequent_itemsets(b, 20).collect()}
    model = FPGrowth(itemsCol="items", minSupport=20 / 200).fit(b.groupBy("basket").agg(F.collect_list("item").alias("items")))
    assert got == {",".join(sorted(r["items"])): r.freq for r in model.freqItemsets.collect()}
    chunked = {r.itemset for r in itemsets.local_candidates(b, F.col("basket") % 3, 20).collect()}
    assert set(got) <= chunked


def test_itemsets_of_any_size_by_brute_force(spark, monkeypatch):
    """No cap on the size: baskets that share twelve items have all 4,095 subsets."""
    items = [f"i{j:02}" for j in range(12)]
    held = [set(items), set(items), set(items[:3]), set(items[2:5]), {"z"}]
    b = spark.createDataFrame([(i, x) for i, s in enumerate(held) for x in s], "basket int, item string")
    want = {}
    for n in range(1, 13):
        for c in itertools.combinations(items, n):
            k = sum(set(c) <= s for s in held)
            if k >= 2:
                want[",".join(c)] = (n, k)
    assert {r.itemset: (r.size, r.support) for r in itemsets.frequent_itemsets(b, 2).collect()} == want
    few = b.where("item < 'i06' or item = 'z'")
    monkeypatch.setattr(itemsets, "LONGEST", 2)  # baskets that are too long for trees
    assert {r.itemset: (r.size, r.support) for r in itemsets.frequent_itemsets(few, 2).collect()} == {k: v for k, v in want.items() if set(k.split(",")) <= set(items[:6])}
    assert {r.itemset: r.size for r in itemsets.local_candidates(b, F.lit(0), 2).collect()} == {k: n for k, (n, _) in want.items()}
    assert itemsets.frequent_itemsets(b.where("false"), 2).count() == itemsets.local_candidates(b.where("false"), F.lit(0), 2).count() == 0


def test_long_baskets_grow_from_bits_as_by_levels(spark, monkeypatch):
    """Baskets that are too long for trees: bits, in short and long stacks, give what the levels give, without their joins."""
    rng = random.Random(12)
    b = spark.createDataFrame([(f"b{i}", f"i{j}") for i in range(90) for j in range(14) if rng.random() < 0.6], "basket string, item string")
    monkeypatch.setattr(itemsets, "LONGEST", 2)

    def result():
        got = [tuple(r) for r in itemsets.frequent_itemsets(b, 20).select("size", "itemset", "support").collect()]
        assert len(got) == len(set(got))
        return set(got)

    with monkeypatch.context() as m:
        m.setattr(itemsets, "_levels", None)
        grown = result()
        m.setattr(itemsets, "PAIRS", 3)
        assert result() == grown
    monkeypatch.setattr(itemsets, "HANDED", 0)
    assert result() == grown and max(size for size, *_ in grown) > 2


def test_hot_items_are_not_paired(spark, monkeypatch):
    rng = random.Random(4)
    held = {(u, i) for u in range(30) for i in (0, 1, 2) if rng.random() < 0.9} | {(u, rng.randrange(3, 40)) for u in range(30) for _ in range(6)}
    rows = spark.createDataFrame(sorted(held), "u long, i long")
    want = {}
    for a, b in itertools.combinations(range(30), 2):
        n = sum((a, i) in held and (b, i) in held for i in range(40))
        if n >= 4:
            want[a, b] = n
    for hot in (1_000, 10, 1):
        monkeypatch.setattr(graph, "HOT_NODES", hot)
        assert {(r.a, r.b): r.common for r in graph.cooccurrence(rows, "u", "i", 4).collect()} == want and want


@pytest.mark.parametrize("kind", [int, str])
def test_edges_by_blocks_equal_brute_force(spark, monkeypatch, kind):
    """Items that all nodes share make no row for each pair; nodes of any type, several blocks."""
    rng = random.Random(5)
    held = {(kind(u), i) for u in range(40) for i in (0, 1) if u % 7} | {(kind(u), rng.randrange(2, 30)) for u in range(40) for _ in range(7)}
    want = {}
    for a, b in itertools.combinations(sorted({u for u, _ in held}), 2):
        n = sum((a, i) in held and (b, i) in held for i in range(30))
        if n >= 4:
            want[a, b] = n
    rows = spark.createDataFrame([(u, f"x{i}") for u, i in sorted(held)], f"u {'long' if kind is int else 'string'}, i string")
    monkeypatch.setattr(graph, "JOINED", 0)
    for width in (3, 4_096):
        monkeypatch.setattr(graph.blocks, "WIDTH", width)
        got = graph.cooccurrence(rows, "u", "i", 4)
        assert got.dtypes == [("a", rows.dtypes[0][1]), ("b", rows.dtypes[0][1]), ("common", "bigint")]
        assert {(r.a, r.b): r.common for r in got.collect()} == want and want


@pytest.mark.parametrize("kind", [int, str])
def test_rows_are_packed_before_they_are_dealt(spark, monkeypatch, kind):
    """No table of rows is settled for blocks; repeats and nulls make no edge, and all three ways give the same."""
    rng = random.Random(23)
    held = {(kind(u), f"x{i}") for u in range(40) for i in rng.sample(range(30), rng.randrange(1, 12))}
    want = {}
    for a, b in itertools.combinations(sorted({u for u, _ in held}), 2):
        if (n := sum((a, f"x{i}") in held and (b, f"x{i}") in held for i in range(30))) >= 4:
            want[a, b] = n
    nulls = [(None, f"x{i}") for i in range(9)] + [(kind(1), None), (None, None)]
    given = [*sorted(held) * 2, *nulls]
    rng.shuffle(given)
    rows = spark.createDataFrame(given, f"u {'long' if kind is int else 'string'}, i string").repartition(3)
    settled, real = [], graph.written

    def written(df, name):
        settled.append(name)
        return real(df, name)

    monkeypatch.setattr(graph, "written", written)
    monkeypatch.setattr(graph.blocks, "written", written)
    monkeypatch.setattr(graph.blocks, "PACK_ROWS", 50)
    for joined, dealt, names in ((0, 256, ["items", "blocks"]), (1e9, 256, ["items", "blocks", "held"]), (1e9, 0, ["held"])):
        monkeypatch.setattr(graph, "JOINED", joined)
        monkeypatch.setattr(graph, "DEALT", dealt)
        settled.clear()
        assert {(r.a, r.b): r.common for r in graph.cooccurrence(rows, "u", "i", 4).collect()} == want and want
        assert settled == names
    monkeypatch.setattr(graph, "DEALT", 256)
    assert graph.cooccurrence(rows.where("false"), "u", "i", 4).count() == graph.cooccurrence(rows.limit(1), "u", "i", 4).count() == 0


def test_correlations_by_blocks_equal_joins(spark, monkeypatch):
    """Pairs and predictions in blocks, with repeated cells, users without variance and several parts of items."""
    rng = random.Random(8)
    cells = [(u, i, round(rng.uniform(0.5, 5), 4) if u % 9 else 3.0) for u in range(40) for i in range(30) if rng.random() < 0.6]
    cells += cells[:20]
    train, wanted = _ratings(spark, cells), _ratings(spark, [(u, i, 0.0) for u in range(45) for i in range(34) if (u * 7 + i) % 5 == 0])

    def results():
        pairs = {(r.a, r.b): (r.n, r.weight) for r in recommend.pearson_pairs(train, "user_id", "item_id", 5).collect()}
        return pairs, {(r.user_id, r.item_id): r.prediction for r in recommend.user_based(train, wanted, neighbour_ratings=15, common=4).collect()}

    pairs, predicted = results()
    monkeypatch.setattr(recommend, "JOINED", 0)
    monkeypatch.setattr(recommend, "CELLS_A_ROW", 1e9)
    for width, rows, columns in ((4_096, 256, 256), (7, 3, 8)):
        for name, value in (("WIDTH", width), ("ROWS", rows), ("COLUMNS", columns)):
            monkeypatch.setattr(recommend.blocks, name, value)
        calls = []
        monkeypatch.setattr(recommend.blocks, "over_pairs", lambda *a, met=over_pairs: calls.append(1) or met(*a))
        some, other = results()
        assert len(calls) == 2 and some == pairs and pairs and other.keys() == predicted.keys()
        assert all(math.isclose(other[k], v, abs_tol=2e-6) for k, v in predicted.items())


def test_walks_equal_joined_levels(spark, monkeypatch):
    """Workers that hold the graph carry what the joins of all roots' levels carry; no edges, no rows."""
    rng = random.Random(11)
    pairs = sorted({tuple(sorted(rng.sample(range(24), 2))) for _ in range(40)} | {(30, 31), (31, 32)})
    edges = _edges(spark, pairs)

    def result(of):
        return {(r.a, r.b): r.betweenness for r in graph.edge_betweenness(of).collect()}

    with monkeypatch.context() as m:
        m.setattr(graph, "distances", None)  # the walks need none
        walked = result(edges)
    none = result(edges.where("false"))
    monkeypatch.setattr(graph, "HANDED", 0)
    joined = result(edges)
    assert none == {} and walked.keys() == joined.keys() == set(pairs)
    assert all(math.isclose(walked[k], v, abs_tol=1e-4) for k, v in joined.items())


def test_alike_nodes_walk_once(spark, monkeypatch):
    """Of nodes with the same neighbours, joined to each other or not, one walks: the same as the joins of all roots' levels."""
    rng = random.Random(29)
    base = sorted({tuple(sorted(rng.sample(range(12), 2))) for _ in range(16)})
    nodes = sorted({x for p in base for x in p})
    like = {x: [100 * k + x for k in range(1 + x % 4)] for x in nodes}  # 1 to 4 of each, those of even ones joined
    pairs = {(p, q) for a, b in base for p in like[a] for q in like[b]} | {p for x in nodes if x % 2 == 0 for p in itertools.combinations(like[x], 2)}
    pairs |= {(900, 901)} | set(itertools.combinations(range(910, 914), 2)) | {(920, x) for x in range(921, 925)}  # a pair, a clique, a star
    pairs = sorted(tuple(sorted(p)) for p in pairs)
    edges = _edges(spark, pairs)

    ends = np.unique(np.array(pairs), return_inverse=True)[1].reshape(-1, 2)
    of, apart = graph._folded(ends[:, 0], ends[:, 1], ends.max() + 1)
    assert len(apart) <= len(nodes) + 4 and len(of) > 2 * len(apart) and apart.any()
    repeated, none = graph._folded(np.array([0, 0, 0]), np.array([1, 1, 2]), 3)
    assert repeated.tolist() == [0, 1, 2] and not none.any()

    def result(of):
        return {(r.a, r.b): r.betweenness for r in graph.edge_betweenness(of).collect()}

    folded, clique = result(edges), result(edges.where("a between 910 and 913"))
    monkeypatch.setattr(graph, "HANDED", 0)
    joined = result(edges)
    assert folded.keys() == joined.keys() == set(pairs) and set(clique.values()) == {1.0} and len(clique) == 6
    assert all(math.isclose(folded[k], v, abs_tol=1e-4) for k, v in joined.items())


@pytest.mark.parametrize("kind", [int, str])
def test_handed_labels_equal_joined_labels(spark, monkeypatch, kind):
    """Rounds over a packed graph settle no table of labels of their own; nodes of any type, a long chain, repeats, no edges."""
    rng = random.Random(17)
    chain = rng.sample(range(100, 140), 40)
    pairs = [tuple(sorted(map(kind, rng.sample(range(24), 2)))) for _ in range(60)] + [tuple(sorted(map(kind, x))) for x in itertools.pairwise(chain)]
    edges = spark.createDataFrame(pairs, f"a {'long' if kind is int else 'string'}, b {'long' if kind is int else 'string'}").repartition(3)
    settled, real = [], graph.written

    def written(df, name):
        settled.append(name)
        return real(df, name)

    def results(of):
        found = graph.label_propagation(of, 3), graph.connected(of)
        assert [x.dtypes for x in found] == [[("node", edges.dtypes[0][1]), (c, edges.dtypes[0][1])] for c in ("label", "component")]
        return [sorted(map(tuple, x.collect())) for x in found]

    monkeypatch.setattr(graph, "written", written)
    monkeypatch.setattr(graph, "PACKED", 7)
    handed = results(edges)
    assert settled == ["nodes", "graph", "labels"] * 2 and results(edges.where("false")) == [[], []]
    monkeypatch.setattr(graph, "LABELLED", 10)
    assert results(edges) == handed and len(handed[0]) > 50


def test_handed_components_give_the_joined_forest(spark, monkeypatch):
    """The same curve and communities, and no round settles tables; nodes with names, several components, no edges."""
    rng = random.Random(19)
    pairs = sorted({tuple(sorted(rng.sample([f"n{i}" for i in range(30)], 2))) for _ in range(70)} | {("x", "y"), ("y", "z")})
    ranked = spark.createDataFrame([(a, b, float(rng.randrange(9))) for a, b in pairs], "a string, b string, betweenness double").repartition(3)
    settled, real = [], graph.written

    def written(df, name):
        settled.append(name)
        return real(df, name)

    monkeypatch.setattr(graph, "written", written)
    handed = graph.modularity_cuts(ranked)
    assert settled == ["ranked", "forest-edges"] and graph.modularity_cuts(ranked.where("false")) == ([], {})
    monkeypatch.setattr(graph, "LABELLED", 10)
    assert graph.modularity_cuts(ranked) == handed and len(handed[0]) > 20


def test_walks_end_when_all_is_reached():
    """The edges of the last level are not looked at: they lead to no new node."""
    import numpy as np

    class Looked(np.ndarray):
        seen = 0

        def __getitem__(self, at):
            Looked.seen += np.size(at)
            return np.asarray(super().__getitem__(at))

    star = sorted([(0, i) for i in range(1, 9)] + [(i, 0) for i in range(1, 9)])
    start, target = np.searchsorted([a for a, _ in star], np.arange(10)), np.array([b for _, b in star])
    edge = np.array([max(x) - 1 for x in star])
    looked = []
    for whole in (None, 9):
        Looked.seen, total = 0, np.zeros(8)
        graph._flow(0, start, target.view(Looked), edge, total, whole)
        looked.append(Looked.seen)
        assert total.tolist() == [1.0] * 8
    assert looked == [16, 8]


def test_blocks_of_ratings_are_small(spark, monkeypatch):
    """What is dealt to all blocks of users compresses: no value of its own for each row but the rating."""
    rng = random.Random(23)
    train = spark.createDataFrame([(u, i, round(rng.uniform(1.5, 3.5), 2)) for u in range(500) for i in range(25)], "user_id long, item_id long, rating double")
    sizes, real = [], blocks.written

    def kept(df, name):
        out = real(df, name)
        sizes.append(out.agg(F.sum(F.octet_length("data"))).first()[0])
        return out

    monkeypatch.setattr(blocks, "written", kept)
    monkeypatch.setattr(recommend, "_in_blocks", lambda *a: True)
    assert recommend.user_based(train, train.where("user_id < 20"), neighbour_ratings=5).count() == 500
    assert sizes[0] < 6 * 13_000


def test_parts_are_handed_out_up_to_a_bound(spark, data, monkeypatch):
    """Ratings do not shuffle the lines to meet a part table of bounded size, whatever Spark's threshold."""
    from lodestone.plans import queries

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plans, found = [], []
        for most in (2_000_000, 0):
            monkeypatch.setattr(queries, "PARTS", most)
            df = queries.ratings(spark, data)
            plans.append("BroadcastHashJoin" in df._jdf.queryExecution().toString())
            found.append(sorted(map(tuple, df.collect())))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plans == [True, False] and found[0] == found[1] and found[0]


def test_wide_blocks_are_dealt_less_often(spark, monkeypatch):
    """A block of common items holds several widths of nodes, and so many rows at most, about."""
    rows = spark.createDataFrame([(u, i) for u in range(60) for i in range(8)], "u long, i long")
    dealt = []
    monkeypatch.setattr(graph, "JOINED", 0)
    monkeypatch.setattr(graph.blocks, "WIDTH", 4)
    monkeypatch.setattr(graph.blocks, "over_pairs", lambda rows, node, n, *a, met=graph.blocks.over_pairs: dealt.append(n) or met(rows, node, n, *a))
    for most in (1_500_000, 48):
        monkeypatch.setattr(graph, "BLOCK_ROWS", most)
        assert graph.cooccurrence(rows, "u", "i", 4).count() == 60 * 59 // 2
    assert dealt == [5, 10]


def test_exact_pairs_by_blocks_equal_brute_force(spark, monkeypatch):
    rng = random.Random(13)
    sets = {f"d{i:02}": {f"w{rng.randrange(12)}" for _ in range(rng.randrange(1, 12))} for i in range(40)}
    rows = spark.createDataFrame([(i, x) for i, s in sets.items() for x in sorted(s)], "item string, member string")
    want = {(a, b): round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 6) for a, b in itertools.combinations(sorted(sets), 2) if 2 * len(sets[a] & sets[b]) >= len(sets[a] | sets[b])}
    monkeypatch.setattr(similarity, "JOINED", 0)
    monkeypatch.setattr(similarity, "verify", None)  # no candidates, so none to verify
    for width in (5, 4_096):
        monkeypatch.setattr(similarity.blocks, "WIDTH", width)
        assert {(r.a, r.b): r.similarity for r in similarity.exact_pairs(rows, "item", "member", 0.5).collect()} == want and want


def test_similar_sets_equal_brute_force(spark, monkeypatch):
    """Bands and similarities of whole sets, with copies, near copies, repeated ids, empty sets and tiles of two."""
    rng = random.Random(17)
    sets = {i: {f"w{rng.randrange(40)}" for _ in range(rng.randrange(1, 30))} for i in range(30)}
    sets |= {30 + i: (sets[i] | {f"x{i}"}) - {"w1"} for i in range(6)} | {40 + i: set(sets[7]) for i in range(3)} | {50 + i: sets[8] | {f"y{i}"} for i in range(6)}
    p = similarity.PRIME
    number = {w: int(hashlib.md5(w.encode()).hexdigest()[:7], 16) for s in sets.values() for w in s}
    signed = {i: [min((((48271 * (v + 1) * (v + 7)) % p + 1) * number[w] + (69621 * (v + 3)) % p) % p for w in s) for v in range(20)] for i, s in sets.items()}
    want = {}
    for a, b in itertools.combinations(sorted(sets), 2):
        common, either = len(sets[a] & sets[b]), len(sets[a] | sets[b])
        if 2 * common >= either and any(signed[a][k : k + 2] == signed[b][k : k + 2] for k in range(0, 20, 2)):
            want[a, b] = round(common / either, 6)
    rows = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items() if i != 5] + [(5, sorted(sets[5])[:2]), (5, sorted(sets[5])[1:]), (99, [])], "item long, words array<string>")
    merged = similarity.merged(rows, rows.select("item"), "item", "words")
    monkeypatch.setattr(similarity, "verify", None)  # sets do not move with each pair
    monkeypatch.setattr(similarity, "LAID", 7)
    for tile in (2, 2_048):
        monkeypatch.setattr(similarity, "TILE", tile)
        got = [(r.a, r.b, r.similarity) for r in similarity.similar_sets(merged, "item", "words", 10, 2, 0.5).collect()]
        assert len(got) == len(want) and {(a, b): s for a, b, s in got} == want and len(want) > 20


def test_pearson_queries_rate_once(spark, data, monkeypatch):
    """The ratings are settled before they are counted and paired, and tables are as wide as there are members."""
    from lodestone.plans import queries

    seen = []
    with monkeypatch.context() as m:
        m.setattr(queries, "written", lambda df, name: seen.append(name) or df)
        queries.pearson_user_pairs(spark, data)
        queries.pearson_item_pairs(spark, data)
    assert seen == ["ratings", "ratings"]
    cells = blocks._Cells(pa.table({"node": [1, 1, 2], "member": [0, 4, 2], "rating": [1.0, 2.0, 3.0]}))
    assert cells.columns == 5 and cells.laid(0, 0, 2, 5, cells.x)[0].tolist() == [[1, 0, 0, 0, 2], [0, 0, 3, 0, 0]]


def test_cuts_equal_brute_force(spark):
    """Components and modularity of the definition after each removal."""
    rng = random.Random(6)
    pairs = sorted({tuple(sorted(rng.sample(range(14), 2))) for _ in range(26)})
    ranked = graph.edge_betweenness(_edges(spark, pairs))
    order = [(r.a, r.b) for r in ranked.orderBy(F.desc("betweenness"), "a", "b").collect()]
    degree = Counter(x for p in pairs for x in p)
    nodes, m = sorted(degree), len(pairs)

    def parts(left):
        group = {x: x for x in nodes}
        for _ in nodes:
            for a, b in left:
                group[a] = group[b] = min(group[a], group[b])
        return group

    def q(group):
        return sum(((min(a, b), max(a, b)) in pairs) - degree[a] * degree[b] / (2 * m) for a in nodes for b in nodes if group[a] == group[b] and a != b) / (2 * m) - sum(d * d for d in degree.values()) / (4 * m * m)

    curve, groups = graph.modularity_cuts(ranked)
    every = [(i, parts(order[i:])) for i in range(m + 1)]
    for removed, n, value in curve:
        group = every[removed][1]
        assert len(set(group.values())) == n and math.isclose(value, q(group), abs_tol=1e-9)
    assert math.isclose(q(groups), max(q(g) for _, g in every), abs_tol=1e-9)


def test_factors_solve_their_least_squares(spark):
    """By brute force: with the items' factors fixed, each user's factors are the regularised optimum or near it, and ratings come back."""
    rng = np.random.default_rng(3)
    u, v = rng.uniform(0.5, 1.5, (20, 2)), rng.uniform(0.5, 1.5, (15, 2))
    cells = [(i, j, float(u[i] @ v[j])) for i in range(20) for j in range(15) if (i * 7 + j) % 5]
    wanted = _ratings(spark, [(i, j, float(u[i] @ v[j])) for i in range(20) for j in range(15) if not (i * 7 + j) % 5] + [(99, 1, 0.0)])
    got = recommend.als(_ratings(spark, cells), wanted, rank=2, iterations=20, regularisation=0.001)
    assert got.where("user_id = 99").count() == 0 and recommend.rmse(got, wanted).first().rmse < 0.05


def test_bfr_recovers_what_k_means_would(spark):
    """Well apart, the clusters are the truth, and rounds and summaries add up."""
    rng = np.random.default_rng(5)
    truth = np.repeat(np.arange(4), 50)
    x = np.array([[0, 0], [30, 0], [0, 30], [30, 30]])[truth] + rng.normal(0, 0.5, (200, 2))
    order = rng.permutation(200)
    x, truth = x[order], truth[order]
    p = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, features array<double>")
    got, _ = clustering.bfr(p, 4, 2, fine=3)
    of = {r.id: r.cluster for r in got.collect()}
    named = Counter((int(truth[i]), c) for i, c in of.items() if c >= 0)
    assert len({c for _, c in named}) == len(named) == 4 and sum(named.values()) >= 180


def test_minhash_by_hand(spark):
    s = spark.createDataFrame([("x", 1), ("x", 5), ("y", 1), ("y", 5), ("y", 9)], "item string, member long")
    signed = similarity.signatures(s, "item", "member", 120)
    assert {r.item: r.signature[:6] for r in signed.collect()} == {"x": [64, 66, 68, 70, 72, 74], "y": [64, 66, 68, 70, 72, 74]}
    pairs = similarity.candidates(signed, "item")
    assert [tuple(r) for r in similarity.verify(pairs, s, "item", "member").collect()] == [("x", "y", round(2 / 3, 6))]
    assert [tuple(r) for r in similarity.exact_pairs(s, "item", "member").collect()] == [("x", "y", round(2 / 3, 6))]


def test_candidates_of_copies_equal_brute_force(spark):
    rng = random.Random(9)
    base = [[rng.randrange(4) for _ in range(12)] for _ in range(12)]
    signed = {f"x{i:02}": rng.choice(base) for i in range(40)}
    rows = spark.createDataFrame(list(signed.items()), "item string, signature array<long>")
    want = {(a, b) for a, b in itertools.combinations(sorted(signed), 2) if any(signed[a][i : i + 3] == signed[b][i : i + 3] for i in range(0, 12, 3))}
    got = [tuple(r) for r in similarity.candidates(rows, "item", 4, 3).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_hash_functions(spark):
    row = spark.range(1).select(
        linear_hash(string_mod(F.lit("ab"), 127), 7, 3, 127, 199).alias("ab"), linear_hash(string_mod(F.lit("é"), 127), 7, 3, 127, 199).alias("e"), string_mod(F.lit(""), 127).alias("none"),
        trailing_zeros(F.lit(106)).alias("z"), trailing_zeros(F.lit(0)).alias("z0"), trailing_zeros(F.lit(8)).alias("z8"), jaccard(F.array(F.lit(1)), F.array(F.lit(1), F.lit(2))).alias("j"), subset(F.array(F.lit(1)), F.array(F.lit(1), F.lit(2))).alias("sub"),
    ).first()
    assert tuple(row) == (15, 106, 0, 1, 0, 3, 0.5, True)
    assert len(set(HASHES)) == 12 and all(0 < a < 65536 and 0 < b < 65536 for a, b, _ in HASHES)


def _ratings(spark, rows):
    return spark.createDataFrame(rows, "user_id long, item_id long, rating double")


def test_pearson_by_hand(spark):
    rows = [(1, i, float(i)) for i in (1, 2, 3)] + [(2, i, 2.0 * i) for i in (1, 2, 3)] + [(3, i, 8.0 - 2 * i) for i in (1, 2, 3)] + [(4, i, 3.0) for i in (1, 2, 3)]
    got = {(r.a, r.b): r.weight for r in recommend.pearson_pairs(_ratings(spark, rows), "user_id", "item_id", 3).collect()}
    assert got == {(1, 2): 1.0, (1, 3): -1.0, (2, 3): -1.0, (1, 4): None, (2, 4): None, (3, 4): None}
    assert recommend.pearson_pairs(_ratings(spark, rows), "user_id", "item_id", 4).count() == 0


def test_recommenders_fall_back(spark):
    train = _ratings(spark, [(1, i, float(i)) for i in (1, 2, 3)] + [(2, i, 2.0 * i) for i in (1, 2, 3, 4)])
    wanted = _ratings(spark, [(1, 9, 0.0), (7, 1, 0.0), (1, 4, 0.0)])
    for f in (lambda: recommend.user_based(train, wanted, neighbour_ratings=1, common=3), lambda: recommend.item_based(train, wanted, user_ratings=1)):
        got = {(r.user_id, r.item_id): r.prediction for r in f().collect()}
        assert got[1, 9] == 2.0 and math.isclose(got[7, 1], round(26 / 7, 6))
    # mean 2, neighbour's deviation 8 - 5, weight 1
    assert {(r.user_id, r.item_id): r.prediction for r in recommend.user_based(train, wanted, neighbour_ratings=1, common=3).collect()}[1, 4] == 5.0
    assert recommend.rmse(_ratings(spark, [(1, 1, 2.0)]).withColumnRenamed("rating", "prediction"), _ratings(spark, [(1, 1, 5.0)])).first().rmse == 3.0


def _edges(spark, pairs):
    return spark.createDataFrame(pairs, "a long, b long")


@pytest.mark.parametrize(
    ("pairs", "want"),
    [
        ([(1, 2), (1, 3), (2, 3), (3, 4), (4, 5), (4, 6), (5, 6)], [1, 4, 4, 9, 4, 4, 1]),
        ([(1, 2), (1, 3), (1, 4), (2, 5), (3, 5), (4, 6), (5, 7), (6, 7)], [4.0833, 4.0833, 6, 4.0833, 4.0833, 4.8333, 6, 4.8333]),
        ([(1, 2), (1, 3), (2, 4), (3, 4), (4, 5)], [2.5, 2.5, 3.5, 3.5, 4]),
    ],
)
def test_betweenness_by_hand(spark, pairs, want):
    e = _edges(spark, pairs)
    got = {(r.a, r.b): r.betweenness for r in graph.edge_betweenness(e).collect()}
    assert got == dict(zip(pairs, want, strict=True))
    total = graph.distances(e).where("root < node").agg(F.sum("level")).first()[0]
    assert math.isclose(sum(got.values()), total, abs_tol=0.01)


def test_communities_by_hand(spark):
    e = _edges(spark, [(1, 2), (1, 3), (2, 3), (3, 4), (4, 5), (4, 6), (5, 6)])
    curve, groups = graph.modularity_cuts(graph.edge_betweenness(e))
    assert groups == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4} and math.isclose(max(q for _, _, q in curve), 5 / 14)
    both = spark.createDataFrame(sorted(groups.items()), "node long, label long")
    assert graph.modularity(e, both).first().modularity == round(5 / 14, 6)
    assert [tuple(r) for r in graph.communities(both).collect()] == [(3, "1,2,3"), (3, "4,5,6")]
    apart = _edges(spark, [(1, 2), (2, 3), (7, 8)])
    assert {r.node: r.component for r in graph.connected(apart).collect()} == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7}
    assert graph.label_propagation(e).count() == 6
    rows = spark.createDataFrame([(u, i) for u in (1, 2) for i in range(7)] + [(3, 0)], "u long, i long")
    assert [tuple(r) for r in graph.cooccurrence(rows, "u", "i").collect()] == [(1, 2, 7)]


def test_summaries_and_assignment(spark):
    p = spark.createDataFrame([(1, 0, [1.0, 2.0]), (2, 0, [3.0, 4.0]), (3, 0, [5.0, 6.0])], "id long, label int, features array<double>")
    s = clustering.collect(clustering.summaries(p, "label", 2), "label")[0]
    assert s.n == 3 and list(s.s) == [9, 12] and list(s.ss) == [35, 56] and list(s.centroid) == [3, 4] and np.allclose(s.std, math.sqrt(8 / 3))
    got = {r.id: (r.cluster, r.distance) for r in clustering.assign(p, {0: s}, 1.0).collect()}
    assert got[2] == (0, 0.0) and got[1][0] == -1
    flat = clustering.Summary(2, np.array([2.0, 4.0]), np.array([2.0, 10.0]))
    assert clustering.assign(p, {5: flat}, 9.0).where("id = 1").first().distance == 0.0
    assert spark.range(1).select(mahalanobis(F.array(F.lit(1.0), F.lit(9.0)), [0.0, 0.0], [2.0, 0.0]).alias("d")).first().d == 0.5


def test_bfr_keeps_every_point(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 0.2, (60, 3)) for c in (0, 10, 20)] + [rng.uniform(-90, 90, (5, 3))])
    rng.shuffle(x)
    p = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, features array<double>")
    got, rounds = clustering.bfr(p, 3, 3, fine=3)
    assert got.select("id").distinct().count() == got.count() == 185
    assert [d + c + r for _, d, _, c, r in rounds] == [37, 74, 111, 148, 185]


def test_numbered_is_total_and_ordered(spark):
    got = [tuple(r) for r in numbered(spark.range(1000).select((F.col("id") * 7 % 1000).alias("id")).repartition(5), [F.col("id")]).orderBy("rn").collect()]
    assert got == [(i, i + 1) for i in range(1000)]


def test_settled_tables_can_be_released(spark):
    table = written(spark.range(5), "small")
    folder = Path(table.inputFiles()[0].removeprefix("file://").removeprefix("file:")).parent
    assert table.count() == 5 and folder.exists()
    assert release(spark) >= 1 and not folder.exists() and release(spark) == 0


def test_dense_ids_have_no_gaps(spark):
    rows = spark.createDataFrame([("b", 1), ("a", 2), ("b", 3), (None, 4), ("d", 5)], "u string, i int").repartition(3)
    assert {(r.u, r.i, r.dense_id) for r in dense(rows, "u").collect()} == {("b", 1, 1), ("a", 2, 0), ("b", 3, 1), (None, 4, None), ("d", 5, 2)}


def _bloom(values, m=199):
    def slots(v):
        x = int.from_bytes(v.encode(), "big")
        return {((a * (x % p) + b) % p) % m for a, b, p in HASHES}

    bits, seen, fp = set(), set(), []
    for v in values:
        s = slots(v)
        if v not in seen:
            if s <= bits:
                fp.append(True)
                continue
            seen.add(v)
            bits |= s
        fp.append(False)
    return fp


def test_bloom_equals_the_filter(spark, data):
    rng = random.Random(3)
    values = [rng.choice(["", "é", *map(str, range(60))]) for _ in range(400)]
    rows = spark.createDataFrame([(i, v, i // 50) for i, v in enumerate(values)], "at long, v string, day long")
    got = sketches.bloom_rate(rows, sketches.bloom_marks(rows, "v", "at"), "v", F.col("day")).orderBy("period").collect()
    want = _bloom(values)
    assert [r.fp for r in got] == [sum(want[i : i + 50]) for i in range(0, 400, 50)] and sum(want) > 0
    assert got[-1].fpr == round(sum(want) / 400, 6)


def test_reservoir_and_ranks(spark):
    rows = spark.range(1000).withColumn("tag", F.when(F.col("id") % 2 == 0, "a").otherwise("b"))
    one, two = (sketches.reservoir(rows.repartition(n), "id").select("id").collect() for n in (1, 7))
    assert one == two and len(one) == 100 and sketches.reservoir(rows.limit(3), "id").count() == 3
    tags = spark.createDataFrame([(t,) for t in "aaaaabbbbbccccdddeeef"] + [("",)], "t string")
    assert {r.tag: r["rank"] for r in sketches.top_tags(tags, "t").collect()} == {"a": 1, "b": 1, "c": 2, "d": 3, "e": 3}


def test_streams_equal_batches_over_several_files(spark, data, tmp_path):
    events = load(spark, data, "events")
    ordered = [r for r in events.orderBy("ts", "event_id").collect()]
    for i in range(3):
        part = ordered[i * len(ordered) // 3 : (i + 1) * len(ordered) // 3]
        spark.createDataFrame(part, events.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = lambda: file_stream(spark, str(tmp_path / "in"), events.schema)
    v = F.col("user_id").cast("string").alias("v")
    fm = streaming.fm(source().select("ts", v), "ts", "v", "3 days", "1 day")
    assert sorted(map(tuple, fm.collect())) == sorted(map(tuple, sketches.flajolet_martin(events.select("ts", v), "ts", "v", "3 days", "1 day").collect()))
    day = F.date_format("ts", "yyyy-MM-dd").alias("period")
    bloom = streaming.bloom(source().select(v, "ts", "event_id", day), "v", ["ts", "event_id"], "period")
    rows = events.select(v, F.struct("ts", "event_id").alias("at"), day)
    assert sorted(map(tuple, bloom.collect())) == sorted(map(tuple, sketches.bloom_rate(rows, sketches.bloom_marks(rows, "v", "at"), "v", F.col("period")).collect()))
    top = streaming.reservoir(source(), "event_id", "event_type")
    assert sorted(map(tuple, top.collect())) == sorted(map(tuple, sketches.top_tags(sketches.reservoir(events, "event_id"), "event_type").collect()))


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"user_id":"u","business_id":"b","date":"2018-01-01","stars":4,"more":1}\n{"user_id":"v"}\n')
    assert [r.stars for r in json_lines(spark, str(tmp_path / "r.json")).collect()] == [4.0, None]
    (tmp_path / "c.csv").write_text('user_id,business_id\n"a,1",x\nb,y\n')
    assert [r.user_id for r in csv_table(spark, str(tmp_path / "c.csv")).collect()] == ["a,1", "b"]
    (tmp_path / "p.csv").write_text("1,2,0.5,1.5\n")
    assert tuple(points(spark, str(tmp_path / "p.csv"), 2).first()) == (1, 2, [0.5, 1.5])
    df = spark.createDataFrame([('{"city":"X"}', "en", "Big News"), ("{}", "en", "none"), ("no", "de", "news")], "value string, lang string, text string")
    assert [r.city for r in json_field(df, "city").collect()] == ["X"]
    assert tracked(df, ["news", "zzz"]).count() == 1
    write_json(df, str(tmp_path / "out.json"))
    write_csv(df, str(tmp_path / "out"), sep="\t")
    append_csv(df, str(tmp_path / "out2"))
    append_csv(df, str(tmp_path / "out2"))
    assert spark.read.json(str(tmp_path / "out.json")).count() == 3 and spark.read.csv(str(tmp_path / "out2"), header=True).count() == 6
