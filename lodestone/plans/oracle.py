"""DuckDB SQL for the queries, over the same tables; written apart from the operators."""

from __future__ import annotations

from lodestone.functions import HASHES

REVIEWS = "reviews AS (SELECT o_custkey AS user_id, l_partkey AS business_id, o_orderdate AS date FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
CITY = "SELECT n_name AS city, round(sum(l_quantity) / count(l_quantity), 6) AS avg_stars FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name"
BRANDS = "b AS (SELECT DISTINCT l_orderkey AS basket, p_brand AS item FROM lineitem JOIN part ON l_partkey = p_partkey)"
EVENT_ITEMS = "e AS (SELECT user_id, strftime(ts, '%Y%m%d') || '-' || event_type AS item FROM events)"


def _itemsets(baskets: str, share: float) -> str:
    """Itemsets of any size: each grows by a later item, with the baskets that hold all of it."""
    return f"""WITH RECURSIVE {baskets}, s AS (SELECT ceil(count(DISTINCT basket) * {share})::BIGINT AS least FROM b),
t AS (SELECT item, list(basket) AS held FROM b GROUP BY item HAVING count(*) >= (SELECT least FROM s)),
f AS (SELECT 1::INTEGER AS size, item AS itemset, item AS last, held FROM t
UNION ALL SELECT (size + 1)::INTEGER, itemset || ',' || item, item, common FROM (SELECT f.size, f.itemset, t.item, list_intersect(f.held, t.held) AS common FROM f JOIN t ON t.item > f.last) WHERE len(common) >= (SELECT least FROM s))
SELECT size, itemset, len(held)::BIGINT AS support FROM f"""


def _local(share: float) -> str:
    return f"""WITH RECURSIVE {BRANDS}, n AS (SELECT count(DISTINCT basket) AS n FROM b), c AS (SELECT basket, item, basket % greatest(4, ceil((SELECT n FROM n) / 25000)::BIGINT) AS chunk FROM b),
l AS (SELECT chunk, count(DISTINCT basket) * ceil((SELECT n FROM n) * {share}) / (SELECT n FROM n) AS least FROM c GROUP BY chunk),
t AS (SELECT chunk, item, list(basket) AS held, any_value(least) AS least FROM c JOIN l USING (chunk) GROUP BY chunk, item HAVING count(*) >= any_value(least)),
f AS (SELECT chunk, 1::INTEGER AS size, item AS itemset, item AS last, held FROM t
UNION ALL SELECT chunk, (size + 1)::INTEGER, itemset || ',' || item, item, common FROM (SELECT f.chunk, f.size, f.itemset, t.item, t.least, list_intersect(f.held, t.held) AS common FROM f JOIN t ON t.chunk = f.chunk AND t.item > f.last) WHERE len(common) >= least)
SELECT DISTINCT size, itemset FROM f"""


TOKENS = "t AS (SELECT DISTINCT doc_id, token FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[ \\t\\n\\r\\f]+')) AS token FROM documents) WHERE token <> '')"
EXACT = f"WITH {TOKENS}, n AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id), i AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM t x JOIN t y ON x.token = y.token AND x.doc_id < y.doc_id GROUP BY ALL)"
JACCARD = f"{EXACT}, j AS (SELECT a, b, i, na.n + nb.n - i AS u FROM i JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b)"


def _lsh() -> str:
    bands, rows, p = 30, 4, 2147483647
    mins = ", ".join(f"min(({(48271 * (v + 1) * (v + 7)) % p + 1} * x + {(69621 * (v + 3)) % p}) % {p}) AS h{v}" for v in range(bands * rows))
    long = ", ".join(f"{{'band': {i}, 'rows': [{', '.join(f'h{i * rows + j}' for j in range(rows))}]}}" for i in range(bands))
    return f"{TOKENS}, x AS (SELECT doc_id, token, ('0x' || substr(md5(token), 1, 7))::BIGINT AS x FROM t), m AS (SELECT doc_id, {mins} FROM x GROUP BY doc_id), r AS (SELECT doc_id, unnest([{long}]) AS z FROM m), c AS (SELECT DISTINCT p.doc_id AS a, q.doc_id AS b FROM r p JOIN r q ON p.z = q.z AND p.doc_id < q.doc_id)"


RATINGS = "r AS (SELECT user_id, item_id, rating, (user_id * 31 + item_id) % 10 = 0 AS held FROM (SELECT l_suppkey AS user_id, regexp_extract(p_brand, '([0-9]+)$', 1)::INTEGER AS item_id, round(avg(l_quantity) / 10, 4) AS rating FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2))"


def _weights(name: str, table: str, of: str, over: str, least: int) -> str:
    return (
        f"{name} AS (SELECT a, b, n, CASE WHEN abs(cov) > 1e-9 AND vx > 1e-9 AND vy > 1e-9 THEN round(cov / sqrt(vx) / sqrt(vy), 6) END AS weight FROM (SELECT a, b, n, sxy - sx * sy / n AS cov, sxx - sx * sx / n AS vx, syy - sy * sy / n AS vy FROM "
        f"(SELECT p.{of} AS a, q.{of} AS b, count(*) AS n, sum(p.rating) AS sx, sum(q.rating) AS sy, sum(p.rating * q.rating) AS sxy, sum(p.rating * p.rating) AS sxx, sum(q.rating * q.rating) AS syy FROM {table} p JOIN {table} q ON p.{over} = q.{over} AND p.{of} < q.{of} GROUP BY ALL HAVING count(*) >= {least})))"
    )


SPLIT = f"{RATINGS}, tr AS (SELECT user_id, item_id, rating FROM r WHERE NOT held), te AS (SELECT user_id, item_id, rating FROM r WHERE held), um AS (SELECT user_id, avg(rating) AS mean, count(*) AS n FROM tr GROUP BY 1)"
FALLBACK = "pr AS (SELECT te.user_id, te.item_id, te.rating, round(coalesce(q.prediction, um.mean, (SELECT avg(rating) FROM tr)), 6) AS prediction FROM te LEFT JOIN q USING (user_id, item_id) LEFT JOIN um USING (user_id))"
USER_CF = f"WITH {SPLIT}, {_weights('w0', 'tr', 'user_id', 'item_id', 5)}, w AS (SELECT a, b, weight FROM w0 WHERE weight IS NOT NULL UNION ALL SELECT b, a, weight FROM w0 WHERE weight IS NOT NULL), q AS (SELECT te.user_id, te.item_id, any_value(m.mean) + sum(w.weight * (tr.rating - um.mean)) / sum(abs(w.weight)) AS prediction FROM te JOIN tr ON tr.item_id = te.item_id JOIN um ON um.user_id = tr.user_id AND um.n > 10 JOIN w ON w.a = te.user_id AND w.b = tr.user_id JOIN um m ON m.user_id = te.user_id GROUP BY ALL HAVING sum(abs(w.weight)) > 0), {FALLBACK}"
ITEM_CF = f"WITH {SPLIT}, {_weights('w0', 'tr', 'item_id', 'user_id', 2)}, w AS (SELECT a, b, weight FROM w0 WHERE weight IS NOT NULL UNION ALL SELECT b, a, weight FROM w0 WHERE weight IS NOT NULL), g AS (SELECT te.user_id, te.item_id, w.weight, tr.rating, row_number() OVER (PARTITION BY te.user_id, te.item_id ORDER BY w.weight DESC, w.b DESC) AS k FROM te JOIN um ON um.user_id = te.user_id AND um.n > 10 JOIN w ON w.a = te.item_id JOIN tr ON tr.user_id = te.user_id AND tr.item_id = w.b), q AS (SELECT user_id, item_id, abs(sum(weight * rating) / sum(abs(weight))) AS prediction FROM g WHERE k <= 10 GROUP BY ALL HAVING sum(abs(weight)) > 0 AND abs(sum(weight * rating)) > 1e-9), {FALLBACK}"


def _lsh_cf() -> str:
    mins = ", ".join(f"min((({41 + v}) * user_id + {23 + v}) % 671) AS h{v}" for v in range(120))
    long = ", ".join(f"{{'band': {i}, 'rows': [{', '.join(f'h{i * 3 + j}' for j in range(3))}]}}" for i in range(40))
    return (
        f"WITH {SPLIT}, m AS (SELECT item_id, {mins} FROM tr GROUP BY 1), z AS (SELECT item_id, unnest([{long}]) AS z FROM m), c AS (SELECT DISTINCT p.item_id AS a, q.item_id AS b FROM z p JOIN z q ON p.z = q.z AND p.item_id < q.item_id), "
        "s AS (SELECT item_id, count(DISTINCT user_id) AS n FROM tr GROUP BY 1), i AS (SELECT a, b, count(*) AS i FROM c JOIN tr p ON p.item_id = a JOIN tr q ON q.item_id = b AND q.user_id = p.user_id GROUP BY ALL), "
        f"sim AS (SELECT a, b FROM i JOIN s x ON x.item_id = a JOIN s y ON y.item_id = b WHERE i >= (x.n + y.n - i) * 0.5), {_weights('w0', 'tr', 'item_id', 'user_id', 5)}, "
        "w1 AS (SELECT a, b, weight FROM w0 SEMI JOIN sim USING (a, b) WHERE weight IS NOT NULL), w AS (SELECT a, b, weight FROM w1 UNION ALL SELECT b, a, weight FROM w1), "
        f"q AS (SELECT te.user_id, te.item_id, abs(sum(w.weight * tr.rating) / sum(abs(w.weight))) AS prediction FROM te JOIN w ON w.a = te.item_id JOIN tr ON tr.user_id = te.user_id AND tr.item_id = w.b GROUP BY ALL HAVING sum(abs(w.weight)) > 0 AND abs(sum(w.weight * tr.rating)) > 1e-9), {FALLBACK}"
    )


PREDICTION = " SELECT user_id, item_id, prediction FROM pr"
RMSE = " SELECT count(*) AS n, round(sqrt(avg((prediction - rating) * (prediction - rating))), 4) AS rmse FROM pr"

EDGES = "h AS (SELECT DISTINCT user_id, strftime(ts, '%Y%m%d%H') || '-' || event_type AS item FROM events), edges AS (SELECT x.user_id AS a, y.user_id AS b, count(*) AS common FROM h x JOIN h y ON x.item = y.item AND x.user_id < y.user_id GROUP BY ALL HAVING count(*) >= (SELECT 2 + floor(log10(count(DISTINCT user_id))) FROM events)), sym AS (SELECT a AS node, b AS other FROM edges UNION ALL SELECT b, a FROM edges)"

# All edges, however many users there are.
ALL_EDGES = EDGES.replace("(SELECT 2 + floor(log10(count(DISTINCT user_id))) FROM events)", "2")


def _labels(edges: str = EDGES) -> str:
    out = [f"{edges}, l0 AS (SELECT DISTINCT node, node AS label FROM sym)"]
    for i in range(1, 6):
        out.append(f", l{i} AS (SELECT node, label FROM (SELECT node, label, row_number() OVER (PARTITION BY node ORDER BY n DESC, label) AS k FROM (SELECT sym.node, l.label, count(*) AS n FROM sym JOIN l{i - 1} l ON l.node = sym.other GROUP BY ALL)) WHERE k = 1)")
    return "".join(out)


BETWEENNESS = f"""WITH RECURSIVE {EDGES},
walk AS (SELECT DISTINCT node AS root, node, 0 AS level FROM sym UNION SELECT w.root, s.other, w.level + 1 FROM walk w JOIN sym s ON s.node = w.node WHERE w.level < 24),
dist AS (SELECT root, node, min(level) AS level FROM walk GROUP BY ALL),
par AS (SELECT d.root, d.node, s.other AS parent, count(*) OVER (PARTITION BY d.root, d.node) AS k FROM dist d JOIN sym s ON s.node = d.node JOIN dist e ON e.root = d.root AND e.node = s.other AND e.level = d.level - 1),
flow AS (SELECT root, node, parent, 1.0::DOUBLE / k AS w FROM par UNION ALL SELECT p.root, p.node, p.parent, f.w / p.k FROM flow f JOIN par p ON p.root = f.root AND p.node = f.parent)
SELECT least(node, parent) AS a, greatest(node, parent) AS b, round(sum(w) / 2 + 1e-9, 4) AS betweenness FROM flow GROUP BY 1, 2"""

# Components after each cut, by labels that spread as many steps as there are nodes; a cut counts where it changes their number.
CUTS = f"""{BETWEENNESS.rpartition("SELECT least(")[0].rstrip()},
bt AS (SELECT least(node, parent) AS a, greatest(node, parent) AS b, round(sum(w) / 2 + 1e-9, 4) AS betweenness FROM flow GROUP BY 1, 2),
rk AS (SELECT a, b, row_number() OVER (ORDER BY betweenness DESC, a, b) - 1 AS rank FROM bt), m AS (SELECT count(*) AS m FROM rk),
dg AS (SELECT node, count(*) AS degree FROM sym GROUP BY node), nn AS (SELECT count(*) AS n FROM dg),
st AS (SELECT a AS node, b AS other, rank FROM rk UNION ALL SELECT b, a, rank FROM rk UNION ALL SELECT node, node, (SELECT m FROM m) FROM dg),
lab AS (SELECT 0 AS t, i, node, node AS label FROM dg, m, range(m + 1) r(i) UNION ALL SELECT lab.t + 1, lab.i, st.other, min(lab.label) FROM lab JOIN st ON st.node = lab.node AND st.rank >= lab.i WHERE lab.t < (SELECT n FROM nn) GROUP BY ALL),
fin AS (SELECT i, node, label FROM lab WHERE t = (SELECT n FROM nn)),
ins AS (SELECT x.i, count(*) AS inside FROM rk JOIN fin x ON x.node = rk.a JOIN fin y ON y.node = rk.b AND y.i = x.i WHERE x.label = y.label GROUP BY x.i),
sq AS (SELECT i, count(*) AS communities, sum(ends * ends)::DOUBLE AS spread FROM (SELECT i, label, sum(degree) AS ends FROM fin JOIN dg USING (node) GROUP BY ALL) GROUP BY i),
cv AS (SELECT i, communities, lead(communities) OVER (ORDER BY i) AS after, coalesce(inside, 0) / m - spread / (4.0 * m * m) AS q FROM sq LEFT JOIN ins USING (i), m),
curve AS (SELECT i, communities, q FROM cv WHERE after IS NULL OR communities < after)"""

DIMS = "e AS (SELECT vec_id AS id, label, generate_subscripts(embedding, 1) - 1 AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings)"
SUMMARY = f"WITH {DIMS} SELECT label, dim::BIGINT AS dim, count(*) AS n, round(sum(x), 4) AS s, round(sum(x * x), 4) AS ss FROM e GROUP BY ALL"
ASSIGN = f"""WITH {DIMS}, c AS (SELECT vec_id AS id, ceil(row_number() OVER (ORDER BY vec_id) / ceil((SELECT count(*) FROM embeddings) / 5.0)) AS chunk FROM embeddings),
d AS (SELECT label, dim, avg(x) AS m, sqrt(greatest(avg(x * x) - avg(x) * avg(x), 0)) AS s FROM e JOIN c USING (id) WHERE chunk = 1 GROUP BY ALL),
g AS (SELECT e.id, d.label, round(sqrt(sum(CASE WHEN d.s > 1e-9 THEN ((e.x - d.m) / d.s) * ((e.x - d.m) / d.s) ELSE 0 END)), 6) AS dist FROM e JOIN c USING (id) JOIN d ON d.dim = e.dim WHERE chunk > 1 GROUP BY ALL),
k AS (SELECT id, label, dist, row_number() OVER (PARTITION BY id ORDER BY dist, label) AS k FROM g)
SELECT id, CASE WHEN dist < 16 THEN label ELSE -1 END::BIGINT AS cluster, round(dist, 4) AS distance FROM k WHERE k = 1"""


def _hashed(m: int) -> str:
    """Values of user ids as text: the bytes as one number, modulo the prime."""
    digits = "list_reduce(list_transform(range(1, length(v) + 1), lambda i: ascii(substr(v, i, 1))::BIGINT), lambda acc, c: (acc * 256 + c) % 65537, 0::BIGINT)"
    return f"u AS (SELECT DISTINCT user_id::VARCHAR AS v FROM events), ux AS (SELECT v, {digits} AS x FROM u), uh AS (SELECT v, unnest([{', '.join(f'{{k: {i}, h: (({a} * (x % {p}) + {b}) % {p}) % {m}}}' for i, (a, b, p) in enumerate(HASHES))}], recursive := true) FROM ux)"


BLOOM = f"""WITH {_hashed(199)}, ev AS (SELECT user_id::VARCHAR AS v, strftime(ts, '%Y-%m-%d') AS period, row_number() OVER (ORDER BY ts, event_id) AS t FROM events),
fa AS (SELECT v, min(t) AS f FROM ev GROUP BY v), tj AS (SELECT h, min(f) AS s FROM uh JOIN fa USING (v) GROUP BY h),
fp AS (SELECT v, max(s) < any_value(f) AS fp FROM uh JOIN fa USING (v) JOIN tj USING (h) GROUP BY v),
d AS (SELECT period, count(*) AS n, sum(fp::BIGINT)::BIGINT AS fp FROM ev JOIN fp USING (v) GROUP BY period)
SELECT period, n, fp, round(sum(fp) OVER w / sum(n) OVER w, 6) AS fpr FROM d WINDOW w AS (ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""
FM = f"""WITH {_hashed(65536)}, z AS (SELECT v, k, CASE WHEN h = 0 THEN 0 ELSE bit_count((h & -h) - 1) END AS z FROM uh),
ev AS (SELECT DISTINCT user_id::VARCHAR AS v, date_trunc('day', ts) - to_days(i::INTEGER) AS st FROM events, range(3) r(i)),
mx AS (SELECT st, k, max(z) AS z FROM ev JOIN z USING (v) GROUP BY ALL), gm AS (SELECT st, k // 4 AS g, avg(pow(2, z)) AS m FROM mx GROUP BY ALL), md AS (SELECT st, median(m) AS m FROM gm GROUP BY st),
tr AS (SELECT st, count(*) AS truth FROM ev GROUP BY st)
SELECT strftime(st, '%Y-%m-%d %H:%M:%S') AS window_start, truth, floor(m)::BIGINT AS estimate FROM md JOIN tr USING (st)"""
RESERVOIR = "WITH s AS (SELECT event_type FROM events ORDER BY ((event_id % 2147483647) * 48271 + 11) % 2147483647, event_id LIMIT 100), c AS (SELECT event_type AS tag, count(*) AS n FROM s WHERE length(event_type) > 0 GROUP BY 1) SELECT tag, n, rank FROM (SELECT tag, n, dense_rank() OVER (ORDER BY n DESC) AS rank FROM c) WHERE rank <= 3"

ORACLE_SQL: dict[str, str] = {
    "review_overview": f"WITH {REVIEWS} SELECT 'n_review' AS metric, count(*) AS value FROM reviews UNION ALL SELECT 'n_review_year', count(*) FROM reviews WHERE year(date) = 1998 UNION ALL SELECT 'n_user', count(DISTINCT user_id) FROM reviews UNION ALL SELECT 'n_business', count(DISTINCT business_id) FROM reviews",
    "top10_users": f"WITH {REVIEWS} SELECT user_id, count(*) AS n FROM reviews GROUP BY 1 ORDER BY n DESC, user_id LIMIT 10",
    "top10_items": "SELECT l_partkey AS business_id, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, business_id LIMIT 10",
    "city_avg_stars": CITY,
    "city_top10": f"{CITY} ORDER BY avg_stars DESC, city LIMIT 10",
    "partition_sizes": "SELECT l_orderkey % 8 AS partition, count(*) AS n_items FROM lineitem GROUP BY 1",
    "son_frequent_itemsets_case1": _itemsets(BRANDS, 0.004),
    "son_frequent_itemsets_case2": _itemsets(f"{EVENT_ITEMS}, b AS (SELECT DISTINCT item AS basket, user_id::VARCHAR AS item FROM e)", 0.2),
    "son_active_users": _itemsets(f"{EVENT_ITEMS}, b AS (SELECT DISTINCT user_id AS basket, item FROM e WHERE user_id IN (SELECT user_id FROM e GROUP BY 1 HAVING count(*) > 60))", 0.2),
    "son_local_candidates": _local(0.01),
    "minhash_signature": f"WITH {EVENT_ITEMS} SELECT item, v, min(((41 + v) * user_id + (23 + v)) % 671) AS minhash FROM e, range(120) r(v) GROUP BY ALL",
    "lsh_candidate_pairs": f"WITH {_lsh()} SELECT a, b FROM c",
    "lsh_jaccard_pairs": f"{JACCARD.replace('WITH ' + TOKENS, 'WITH ' + _lsh(), 1)} SELECT a, b, round(i / u, 6) AS similarity FROM j SEMI JOIN c USING (a, b) WHERE i >= u * 0.5",
    "exact_jaccard_pairs": f"{JACCARD} SELECT a, b, round(i / u, 6) AS similarity FROM j WHERE i >= u * 0.5",
    "pearson_user_pairs": f"WITH {RATINGS}, {_weights('w', 'r', 'user_id', 'item_id', 5)} SELECT a, b, n, weight FROM w",
    "pearson_item_pairs": f"WITH {RATINGS}, {_weights('w', 'r', 'item_id', 'user_id', 2)} SELECT a, b, n, weight FROM w",
    "user_cf_predict": USER_CF + PREDICTION,
    "user_cf_rmse": USER_CF + RMSE,
    "item_cf_predict": ITEM_CF + PREDICTION,
    "item_cf_rmse": ITEM_CF + RMSE,
    "lsh_item_cf_predict": _lsh_cf() + PREDICTION,
    "lsh_item_cf_rmse": _lsh_cf() + RMSE,
    "coreview_edges": f"WITH {ALL_EDGES} SELECT a, b, common FROM edges",
    "vertex_degrees": f"WITH {ALL_EDGES} SELECT node, count(*) AS degree FROM sym GROUP BY 1",
    "label_propagation": f"WITH {_labels(ALL_EDGES)} SELECT node, label FROM l5",
    "label_communities": f"WITH {_labels()} SELECT count(*) AS size, string_agg(node::VARCHAR, ',' ORDER BY node::VARCHAR) AS members FROM l5 GROUP BY label",
    "connected_components": f"WITH RECURSIVE {ALL_EDGES}, reach AS (SELECT DISTINCT node, node AS other FROM sym UNION SELECT r.node, s.other FROM reach r JOIN sym s ON s.node = r.other) SELECT node, min(other) AS component FROM reach GROUP BY node",
    "edge_betweenness": BETWEENNESS,
    "modularity_curve": f"{CUTS.replace(EDGES, ALL_EDGES)} SELECT i AS removed, communities, round(q, 6) AS modularity FROM curve",
    "modularity_communities": f"{CUTS}, best AS (SELECT i FROM curve ORDER BY round(q, 12) DESC, i LIMIT 1) SELECT count(*) AS size, string_agg(node::VARCHAR, ',' ORDER BY node::VARCHAR) AS members FROM fin JOIN best USING (i) GROUP BY label",
    "bfr_summary": SUMMARY,
    "bfr_mahalanobis_assign": ASSIGN,
    "bloom_fpr_by_day": BLOOM,
    "fm_sliding_distinct": FM,
    "reservoir_top_tags": RESERVOIR,
    "stream_fm": FM,
    "stream_bloom": BLOOM,
    "stream_reservoir": RESERVOIR,
}
