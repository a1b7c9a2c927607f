"""DuckDB SQL for the corpus queries that SQL can express, written apart from the operators."""

from __future__ import annotations

from lodestone.llm.license_scan import BLANK_LINES, COMMENT_END, HOLDER, LICENCE_FILE, MARKERS, TEMPLATES

JACCARD = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS s FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM i JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 90 * (na.n + nb.n - i)),
sym AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT doc_id AS node, doc_id AS other FROM w UNION SELECT r.node, sym.b FROM reach r JOIN sym ON sym.a = r.other)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT node AS doc_id, min(other) AS component_id FROM reach GROUP BY node) c USING (doc_id)"""

TOPK = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5"""


def _quality(order: int = 4) -> str:
    """Kneser-Ney by joins: counts from the top order down, then probabilities from the lowest up."""
    base = "65536::HUGEINT"
    power = lambda k: " * ".join([base] * k) if k else "1::HUGEINT"
    lags = " + ".join(f"coalesce(lag(c, {j}) OVER w, 0) * ({power(j)})" for j in range(1, order))
    out = [f"""WITH ch AS (SELECT k, doc_id, i, CASE WHEN u < 65536 THEN greatest(u, 1) ELSE 57344 + u % 6400 END::HUGEINT AS c FROM (SELECT k, doc_id, i, ord(x)::BIGINT AS u FROM (SELECT k, doc_id, generate_subscripts(xs, 1) AS i, unnest(xs) AS x FROM (SELECT doc_id AS k, doc_id, regexp_extract_all(text, '(?s).') AS xs FROM documents)))),
mk AS (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1),
g AS (SELECT k, doc_id, c + {lags} AS gram FROM ch WINDOW w AS (PARTITION BY k ORDER BY i)),
t{order} AS (SELECT gram, count(*) AS n FROM g SEMI JOIN mk USING (doc_id) GROUP BY gram)"""]
    out += [f"t{k} AS (SELECT gram % ({power(k)}) AS gram, count(*) AS n FROM t{k + 1} GROUP BY 1)" for k in range(order - 1, 0, -1)]
    for k in range(1, order + 1):
        n = ", ".join(f"greatest(count(*) FILTER (WHERE n = {i}), CASE WHEN count(*) FILTER (WHERE n = {i}) = 0 THEN 1 ELSE 0 END)::DOUBLE AS n{i}" for i in (1, 2, 3, 4))
        d = ", ".join(f"least(greatest({i} - {i + 1} * y * n{i + 1} / n{i}, 0.05), {i - 0.05}) AS d{i}" for i in (1, 2, 3))
        out.append(f"d{k} AS (SELECT {d} FROM (SELECT *, n1 / (n1 + 2 * n2) AS y FROM (SELECT {n} FROM t{k})))")
        out.append(f"s{k} AS (SELECT gram, gram // {base} AS context, n, CASE n WHEN 1 THEN d1 WHEN 2 THEN d2 ELSE d3 END AS spent FROM t{k}, d{k})")
        out.append(f"h{k} AS (SELECT context, sum(n)::DOUBLE AS total, sum(spent) AS spent FROM s{k} GROUP BY context)")
        out.append(f"p{k} AS (SELECT gram, (n - s{k}.spent) / total AS p FROM s{k} JOIN h{k} USING (context))")
    out.append(f"u{order} AS (SELECT DISTINCT gram FROM g)")
    out += [f"u{k} AS (SELECT DISTINCT gram % ({power(k)}) AS gram FROM u{k + 1})" for k in range(order - 1, 0, -1)]
    out.append("q0 AS (SELECT 0::HUGEINT AS gram, 1.0::DOUBLE / 65536 AS q)")
    for k in range(1, order + 1):
        out.append(f"q{k} AS (SELECT u.gram, coalesce(p.p, 0) + coalesce(h.spent / h.total, 1) * l.q AS q FROM u{k} u LEFT JOIN p{k} p ON p.gram = u.gram LEFT JOIN h{k} h ON h.context = u.gram // {base} JOIN q{k - 1} l ON l.gram = u.gram % ({power(k - 1)}))")
    out.append(f"pp AS (SELECT k, pow(2, sum(-log2(q)) / count(*)) AS x FROM g JOIN q{order} USING (gram) GROUP BY k)")
    out.append("sc AS (SELECT d.doc_id AS k, d.doc_id, lang, x FROM documents d LEFT JOIN pp ON pp.k = d.doc_id)")
    cut = "quantile_disc(x, 0.005) AS lo, quantile_disc(x, 0.995) AS hi"
    out.append(f"own AS (SELECT lang, {cut} FROM sc SEMI JOIN mk USING (doc_id) WHERE x IS NOT NULL GROUP BY lang), al AS (SELECT {cut} FROM sc SEMI JOIN mk USING (doc_id) WHERE x IS NOT NULL)")
    out.append("r AS (SELECT doc_id, sc.lang, x, coalesce(own.lo, al.lo) AS lo, coalesce(own.hi, al.hi) AS hi FROM sc LEFT JOIN own ON own.lang IS NOT DISTINCT FROM sc.lang, al)")
    return ",\n".join(out) + " SELECT doc_id, lang, round(x, 4) AS perplexity, round(lo, 4) AS threshold_low, round(hi, 4) AS threshold_high, x IS NOT NULL AND coalesce(x BETWEEN lo AND hi, true) AS keep FROM r"


def _licences() -> str:
    rows = ", ".join(f"('{name}#{i}', '{name}', '{text}')" for name, texts in sorted(TEMPLATES.items()) for i, text in enumerate(texts))
    words = "list_filter(regexp_split_to_array(lower({}), '[^a-z0-9]+'), lambda x: x <> '')"

    def weighted(name: str, source: str, ids: str) -> str:
        return (
            f"{name}_t AS (SELECT {ids}, word, count(*) AS tf FROM (SELECT {ids}, unnest(words) AS word FROM {source}) GROUP BY ALL), "
            f"{name}_w AS (SELECT {ids}, word, tf * (ln((n + 1.0) / (coalesce(df, 0) + 1.0)) + 1.0) AS w FROM {name}_t LEFT JOIN df USING (word), total), "
            f"{name} AS (SELECT {ids}, word, w / sqrt(sum(w * w) OVER (PARTITION BY {ids})) AS w FROM {name}_w)"
        )

    return f"""WITH f AS (SELECT page_id AS k, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path, regexp_replace(html, '<[^>]*>', chr(10), 'g') AS t FROM pages),
m AS (SELECT t AS template, l AS licence, {words.format("x")} AS words FROM (VALUES {rows}) v(t, l, x)), total AS (SELECT count(*) AS n FROM f),
df AS (SELECT word, count(*) AS df FROM (SELECT DISTINCT k, unnest({words.format("t")}) AS word FROM f) GROUP BY word),
bd AS (SELECT k, coalesce(regexp_matches(lower(path), '{LICENCE_FILE}'), false) AS whole, regexp_matches(lower(t), '{MARKERS}') AS marked, regexp_replace(t, '{HOLDER}', 'copyright \\1', 'g') AS t FROM f),
bl AS (SELECT k, whole, t, CASE WHEN marked THEN list_filter(list_distinct(list_concat(string_split(t, chr(10)), regexp_split_to_array(regexp_replace(t, '{COMMENT_END}', '\\1\\2' || chr(10) || chr(10) || '\\3', 'g'), '{BLANK_LINES}'))), lambda x: regexp_matches(lower(x), '{MARKERS}')) ELSE [] END AS ls FROM bd WHERE t IS NOT NULL),
ln AS (SELECT k, whole, generate_subscripts(ls, 1) AS line, unnest(ls) AS t FROM (SELECT k, whole, CASE WHEN whole THEN list_concat([t], ls) ELSE ls END AS ls FROM bl)),
tx AS (SELECT k, line, whole, {words.format("t")} AS words FROM ln),
{weighted("a", "tx", "k, line, whole")}, {weighted("b", "m", "template, licence")},
c AS (SELECT k, line, whole, template, licence, round(sum(a.w * b.w), 6) AS score FROM a JOIN b USING (word) GROUP BY ALL HAVING round(sum(a.w * b.w), 6) >= 0.7),
o AS (SELECT k, licence, score, whole FROM (SELECT k, licence, score, bool_or(whole) OVER (PARTITION BY k) AS whole, row_number() OVER (PARTITION BY k ORDER BY score DESC, licence) AS r FROM c) WHERE r = 1),
g AS (SELECT f.k, path, regexp_extract(path, '^(.*/)?[^/]*$', 1) AS dir, licence, score, whole FROM f LEFT JOIN o USING (k)),
d AS (SELECT dir, licence, score FROM (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY (NOT whole), score DESC, licence) AS r FROM g WHERE licence IS NOT NULL AND path IS NOT NULL AND (whole OR path LIKE '%/')) WHERE r = 1),
h AS (SELECT k, licence, score, dir FROM (SELECT g.k, d.licence, d.score, d.dir, row_number() OVER (PARTITION BY g.k ORDER BY length(d.dir) DESC) AS r FROM g JOIN d ON starts_with(g.dir, d.dir) WHERE g.licence IS NULL) WHERE r = 1)
SELECT g.k AS page_id, g.path, coalesce(g.licence, h.licence) AS licence, coalesce(g.score, h.score) AS score, CASE WHEN g.licence IS NOT NULL THEN CASE WHEN g.whole THEN 'file' ELSE 'header' END WHEN h.licence IS NOT NULL THEN 'inherited' END AS origin, h.dir AS declared_in FROM g LEFT JOIN h USING (k)"""


ORACLE_SQL: dict[str, str] = {"op2_quality": _quality(), "op4_jaccard_join": JACCARD, "op7_topk": TOPK, "op8_license_scan": _licences()}
