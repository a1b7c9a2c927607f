import random

import pytest
from pyspark.sql import functions as F

from lodestone.llm import jaccard_join
from tests.llm.helpers import documents, prose, words


def brute(rows, w, num, den):
    sets = []
    for i, t in rows:
        k = words(t)
        sets.append((i, frozenset(tuple(k[j : j + w]) for j in range(max(1, len(k) - w + 1))) if k else frozenset()))
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and den * len(x & y) >= num * len(x | y):
                parent[find(a)] = find(b)
    least: dict = {}
    for a, (i, _) in enumerate(sets):
        r = find(a)
        if i is not None:
            least[r] = min(least.get(r, i), i)
    return sorted(((i, len(s), least.get(find(a)) if s else i) for a, (i, s) in enumerate(sets)), key=repr)


def edited(rng, n):
    """Families of near copies with few edits, so that many pairs lie near the threshold."""
    rows, i = [], 0
    for _ in range(n):
        base = prose(rng, "en", rng.choice([3, 6, 12, 25, 60, 150])).split()
        for _ in range(rng.randint(1, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 18))):
                copy[rng.randrange(len(copy))] = prose(rng, "fr", 1)
            rows.append((i, " ".join(copy), "en"))
            i += 1
    return rows


@pytest.mark.parametrize(("w", "num", "den"), [(3, 90, 100), (5, 80, 100), (1, 60, 100)])
def test_components_equal_brute_force(spark, w, num, den):
    rng = random.Random(w)
    docs = documents(spark, rows=edited(rng, 60))
    got = jaccard_join.classes(docs, words=w, num=num, den=den)
    assert sorted(map(tuple, got.collect()), key=repr) == brute([(r.doc_id, r.text) for r in docs.collect()], w, num, den)


def test_nulls_empties_repeats_and_long_texts(spark):
    docs = documents(spark)
    got = sorted(map(tuple, jaccard_join.classes(docs, words=3, num=90, den=100).collect()), key=repr)
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()], 3, 90, 100)


def test_empty_table_and_clashing_columns(spark):
    assert jaccard_join.classes(documents(spark, rows=[])).count() == 0
    odd = spark.createDataFrame([(1, "a b c", 5), (2, "a b c", 6)], "node long, t string, key int")
    got = jaccard_join.classes(odd, key="node", text="t", words=2)
    assert sorted(map(tuple, got.collect())) == [(1, 2, 1), (2, 2, 1)]


def test_one_of_each_group_stays(spark):
    docs = documents(spark, rows=[(1, "a b c d e f", "en"), (2, "a b c d e f", "en"), (3, None, "en"), (4, "", "en"), (5, "x y z", "en"), (5, "x y z", "en"), (None, "q", "en")])
    kept = jaccard_join.representatives(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([1, 3, 4, 5, None], key=repr)


def test_repeated_keys_lose_no_clean_row_and_keep_no_copy(spark):
    """A key may stand on unlinked texts, on a copy of another key's text, on empty ones."""
    rows = [(5, "one two three four five six", "en"), (5, "quite another text under this key", "en"), (3, "a b c d e f", "en"), (5, "a b c d e f", "en"), (7, "", "en"), (7, None, "en"), (7, " ", "en"), (7, "", "en"), (None, "a b c d e f", "en"), (None, "p q", "en"), (None, "p q", "en"), (None, "r s", "en")]
    odd = documents(spark, rows=rows).withColumnRenamed("source", "k").withColumn("__own_0", F.lit(1)).withColumnRenamed("n_chars", "comp")
    kept = jaccard_join.representatives(odd)
    assert kept.columns == odd.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted([(5, rows[0][1]), (5, rows[1][1]), (3, "a b c d e f"), (7, ""), (7, ""), (7, None), (7, " "), (None, "p q"), (None, "r s")], key=repr)
    assert jaccard_join.representatives(documents(spark, rows=[])).count() == 0


@pytest.mark.parametrize(("num", "den"), [(90, 100), (80, 100), (50, 100)])
def test_plans_are_worth_what_pairs_need(num, den):
    for n in (1, 1000, 10**9):
        table = jaccard_join.plan({k: n for k in range(200)}, 5000, num, den)
        for k, b in enumerate(table):
            worth = b.segments * b.worth
            assert worth >= 2 * b.hi * (den - num) // (den + num) + 1
            if k + 1 < len(table):
                top = min(table[k + 1].hi, b.hi * den // num)
                assert worth >= (b.hi + top) * (den - num) // (den + num) + 1
    # Very many small sets take one-deletion segments: empty segments would cost more.
    assert any(b.worth == 2 for b in jaccard_join.plan({k: 10**9 for k in range(50)}, 100, 80, 100))


def test_one_deletion_segments_find_all(spark, monkeypatch):
    real = jaccard_join.plan
    monkeypatch.setattr(jaccard_join, "plan", lambda counts, top, num, den: real({k: 10**12 for k in range(300)}, top, num, den))
    docs = documents(spark, rows=edited(random.Random(9), 40))
    got = jaccard_join.classes(docs, words=2, num=80, den=100)
    assert sorted(map(tuple, got.collect()), key=repr) == brute([(r.doc_id, r.text) for r in docs.collect()], 2, 80, 100)


def test_links_at_the_very_threshold(spark):
    """Subsets and supersets at exactly nine tenths, in and across bands, with partners that only the larger can look up."""
    rng = random.Random(11)
    rows, i = [], 0
    for n in (9, 10, 18, 19, 20, 27, 36, 45, 90, 91, 100, 171):
        own = [f"w{n}x{j}" for j in range(n)]
        for size in {n, n - n // 10, n - n // 20, n - n // 10 - 1, n - 1}:
            kept = sorted(rng.sample(range(n), size))
            rows.append((i, " ".join(own[j] for j in kept), "en"))
            i += 1
    rng.shuffle(rows)
    docs = documents(spark, rows=rows)
    got = jaccard_join.classes(docs, words=1, num=90, den=100)
    assert sorted(map(tuple, got.collect()), key=repr) == brute([(r.doc_id, r.text) for r in docs.collect()], 1, 90, 100)
