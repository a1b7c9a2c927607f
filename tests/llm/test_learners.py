import math
import random
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.llm import language_id, lm_score, quality, toxicity
from lodestone.llm.common import fold
from tests.llm.helpers import SYLLABLES, documents, held_out, prose, words


def greedy(s: bytes, text: bytes) -> int:
    """Phrases by the definition: the longest part of ``s``, block by block."""
    n = 0
    for a in range(0, len(text), language_id.BLOCK):
        block, i = text[a : a + language_id.BLOCK], 0
        while i < len(block):
            j = i + 1
            while j < len(block) and block[i : j + 1] in s:
                j += 1
            n, i = n + 1, j
    return n


def test_phrases_equal_the_definition():
    rng = random.Random(2)
    samples = {lang: prose(rng, lang, 300) for lang in sorted(SYLLABLES)}
    model = language_id.Model(list(samples), [], [])
    learned = []
    for t in samples.values():
        c = language_id.letters(*language_id.buffer(pa.array([t])))[0].tobytes()
        learned.append(c)
        model.edges.append(language_id.automaton(c))
        model.bits.append(math.log2(len(c)))
    texts = [prose(rng, rng.choice(sorted(SYLLABLES)), n) for n in (1, 2, 20, 400)] + ["", "zqx ÀÉ! 99", "éa" * 300]
    raw, offs = language_id.buffer(pa.array(texts))
    got, _ = model.phrases(raw, offs)
    for i, t in enumerate(texts):
        c = language_id.letters(*language_id.buffer(pa.array([t])))[0].tobytes()
        assert list(got[i]) == [greedy(s, c) for s in learned]


def test_languages_are_told_apart_and_odd_texts_are_und(spark):
    docs = documents(spark, 200)
    model = language_id.train(docs.where(fold(F.col("doc_id"), 5) != 0))
    assert model.langs == sorted(SYLLABLES)
    got = language_id.predict(docs, model, carry=["doc_id", "lang", "text"]).collect()
    assert len(got) == docs.count()
    long = [r for r in got if r.text and len(r.text) > 60 and r.lang and r.doc_id is not None and r.doc_id < 200]
    assert np.mean([r.lang == r.lang_pred for r in long]) > 0.97
    for r in got:
        assert 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or ""))


def test_letters_are_those_of_unicode(spark):
    """Every code point alone: ``und`` where Unicode calls it no letter."""
    model = language_id.train(documents(spark, 40))
    points = [chr(c) for c in range(1, 0x30000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) != "Cn"]
    rows = spark.createDataFrame(list(enumerate(points)), "doc_id long, text string")
    got = {r.doc_id: r.lang_pred for r in language_id.predict(rows, model, carry=["doc_id"]).collect()}
    # The JVM's Unicode is a little older than Python's: letters of later versions may differ.
    odd = [c for i, c in enumerate(points) if (got[i] == "und") == c.isalpha()]
    assert len(odd) < 0.05 * len(points) and not [c for c in odd if ord(c) < 0x800 or 0x3000 <= ord(c) < 0x3400 or 0xFF00 <= ord(c) < 0x10000]


def test_samples_fill_from_short_texts_and_beside_many_copies(spark):
    rng = random.Random(8)
    short = [(i, prose(rng, "de", 3), "de") for i in range(6000)]
    hot = [(10_000 + i, "the end of the page", "en") for i in range(20_000)] + [(40_000 + i, prose(rng, "en", 60), "en") for i in range(300)]
    model = language_id.train(documents(spark, rows=short + hot), sample_letters=20_000)
    assert model.langs == ["de", "en"] and all(abs(b - math.log2(20_001)) < 1e-9 for b in model.bits)


def test_predictions_equal_the_definition(spark):
    """Language, score and decision of the stage from phrases counted one by one."""
    docs = documents(spark, 60)
    model = language_id.train(docs)
    rng = random.Random(5)
    rows = [(i, prose(rng, rng.choice(sorted(SYLLABLES)), rng.choice([1, 4, 40])), None) for i in range(60)] + [(100, "\u0431\u0443\u043a\u0432\u044b \u0438 \u0441\u043b\u043e\u0432\u0430", None), (101, "7 8", None), (102, None, None), (103, "the " * 40_000, None)]
    table = documents(spark, rows=rows).withColumnRenamed("source", "score")
    got = {r.doc_id: r for r in language_id.predict(table, model, carry=["doc_id", "score"]).collect()}
    kept = {r.doc_id for r in language_id.accepted(table, model).collect()}
    taught = [bytes(x) for x in _samples(docs)]
    for i, t, _ in rows[:-1]:
        c = language_id.letters(*language_id.buffer(pa.array([t], pa.string())))[0].tobytes()
        if not any(x.isalpha() for x in t or ""):
            assert (got[i].lang_pred, got[i].score) == ("und", 0) and i not in kept
            continue
        n = [greedy(s, c) for s in taught]
        cost = [x * b / len(c) for x, b in zip(n, model.bits, strict=True)]
        best = cost.index(min(cost))
        assert got[i].lang_pred == model.langs[best]
        assert abs(got[i].score - 1 / sum(2 ** -min(60, (x - cost[best]) * math.sqrt(len(c))) for x in cost)) < 1e-9
        assert (i in kept) == (cost[best] * len(c) <= 5 * len(c) + 2 * model.bits[best])
    assert 100 not in kept and got[103].lang_pred == "en"


def _samples(docs):
    """The samples that the automata were built of: their longest paths."""
    for state, c, target, _ in language_id.train(docs).edges:
        out: dict = {}
        for s, x, t in zip(state.tolist(), c.tolist(), target.tolist(), strict=True):
            out.setdefault(s, []).append((x, t))
        yield _longest(out)


def _longest(out):
    best, order, seen = {}, [], set()
    stack = [(0, False)]
    while stack:
        s, done = stack.pop()
        if done:
            order.append(s)
        elif s not in seen:
            seen.add(s)
            stack.append((s, True))
            stack += [(t, False) for _, t in out.get(s, []) if t not in seen]
    for s in order:
        best[s] = max(((best[t][0] + 1, x, t) for x, t in out.get(s, [])), default=(0, 0, 0))
    s, text = 0, []
    while best[s][0]:
        _, x, s = best[s]
        text.append(x)
    return text


def test_language_id_without_rows_or_languages(spark):
    empty = documents(spark, rows=[])
    assert language_id.predict(empty, language_id.train(empty), carry=["doc_id"]).count() == 0
    model = language_id.train(documents(spark, rows=[(1, "abc", None), (2, None, "en")]))
    assert model.langs == []
    assert [r.lang_pred for r in language_id.predict(documents(spark, rows=[(1, "abc", "en")]), model, carry=["doc_id"]).collect()] == ["und"]
    assert language_id.accepted(documents(spark), language_id.train(documents(spark))).columns == empty.columns


def test_toxicity_learns_words_and_scores_all(spark):
    rng = random.Random(4)
    rows, marks = [], []
    for i in range(600):
        bad = i % 6 == 0
        t = prose(rng, "en", rng.randint(5, 80)).split()
        if bad:
            for w in rng.sample(["grumbag", "snotling", "vexhole"], 2):
                t.insert(rng.randrange(len(t)), w)
        rows.append((i, " ".join(t), "en"))
        marks.append((i, int(bad)))
    rows += [(1000, None, "en"), (1001, "", "en"), (1001, "", "en")]
    docs = documents(spark, rows=rows)
    labels = spark.createDataFrame([*marks, (None, 1), (3, None), (2, 0)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels.where(fold(F.col("doc_id"), 5) != 0))
    got = {r.doc_id: r for r in toxicity.score(docs, model, carry=["doc_id"]).collect()}
    held = [i for i, _ in marks if held_out(i, 5)]
    assert all(got[i].predicted == int(i % 6 == 0) for i in held)
    assert got[1000].score == got[1001].score and got[1001].predicted == 0
    assert toxicity.score(docs, model, carry=["doc_id"]).count() == len(rows)
    assert toxicity.accepted(docs, model).columns == docs.columns
    empty = toxicity.train(documents(spark, rows=[]), labels)
    assert [r.score for r in toxicity.score(docs, empty, carry=["doc_id"]).limit(2).collect()] == [0.5, 0.5]


def naive_features(t):
    h, first = toxicity.word_hashes(*toxicity.buffer(pa.array([t])), toxicity._WORD)
    return {int(x) for f, _ in toxicity.features(h, first) for x in f}


def test_toxicity_equals_ftrl_by_the_definition(spark):
    """A plain per-coordinate FTRL-proximal over dictionaries gives the same scores; long texts, ties and a repeated key among the rows."""
    rng = random.Random(14)
    rows = [(i, prose(rng, "en", rng.randint(1, 30)) + (" grumbag" if i % 4 == 0 else ""), "en") for i in range(160)]
    rows += [(200, "the grumbag " * 9_000, "en"), (201, "b same", "en"), (201, "a same", "en"), (202, None, "en"), (203, "", "en")]
    docs = documents(spark, rows=rows).withColumnRenamed("lang", "predicted").withColumnRenamed("source", "y")
    marks = {i: int(i % 4 == 0) for i in range(160)} | {200: 1, 201: 0, 202: 0, 203: 0}
    labels = spark.createDataFrame([*marks.items(), (201, None), (999, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, epochs=3, l1=0.5)
    texts = {i: min(t or "" for j, t, _ in rows if j == i) for i in marks}
    have = {i: naive_features(t) for i, t in texts.items()}
    df = Counter(f for x in have.values() for f in x)
    ids = sorted(texts)
    total = [sum(marks.values()) + 1 if side else len(marks) - sum(marks.values()) for side in (0, 1)]
    each = [max(1, total[1 - s] / total[s]) ** 0.5 * total[s] / sum(marks[i] == s for i in ids) for s in (0, 1)]
    mean = sum(each[marks[i]] for i in ids) / len(ids)
    z, g2 = Counter(), Counter()

    def weight(f):
        cut = 0 if f == "bias" else 0.5
        return 0 if abs(z[f]) <= cut else -math.copysign(abs(z[f]) - cut, z[f]) / (1 + math.sqrt(g2[f]))

    order = np.random.default_rng(7)
    for _ in range(3):
        for r in order.permutation(len(ids)):
            mine = [f for f in have[ids[r]] if df[f] >= 4] + ["bias"]
            w = {f: weight(f) for f in mine}
            g = (1 / (1 + math.exp(-max(-35, min(35, sum(w.values()))))) - marks[ids[r]]) * each[marks[ids[r]]] / mean
            for f in mine:
                z[f] += g - (math.sqrt(g2[f] + g * g) - math.sqrt(g2[f])) * w[f]
                g2[f] += g * g
    got = {(r.doc_id, r.y): r.score for r in toxicity.score(docs, model, carry=["doc_id", "y", "predicted"]).collect()}
    for i, t in texts.items():
        if i != 201:
            x = sum(weight(f) for f in naive_features(t) | {"bias"} if f in z)
            assert abs(got[i, f"s{i % 3}"] - 1 / (1 + math.exp(-x))) < 1e-6


def brute_base(rows, mod=10):
    c, docs = Counter(), []
    for i, t in rows:
        k = [*words(t), "\x00end"]
        docs.append((i, k))
        if not held_out(i, mod):
            c.update(k)
    n, v = sum(c.values()), len(c)
    return sorted([(repr(i), held_out(i, mod), len(k), sum(c[w] > 0 for w in k), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in k), 6)) for i, k in docs])


@pytest.mark.parametrize("rows", [None, [], [(5, "a b", "en")]])
def test_base_scores_equal_brute_force(spark, rows):
    docs = documents(spark, rows=rows).withColumn("held_out", fold(F.col("doc_id"), 10) == 0)
    got = lm_score.score(docs, ~F.col("held_out"), carry=["doc_id", "held_out"]).collect()
    have = sorted((repr(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got)
    assert have == brute_base([(r.doc_id, r.text) for r in docs.collect()])


def brute_score(rows, mod=10):
    """All words as symbols and all n-grams that repeat as arcs, by the definition."""
    grams, docs = [Counter(), Counter(), Counter()], []
    for i, t in rows:
        k = ["\x00end", *words(t), "\x00end"]
        docs.append((i, k))
        if not held_out(i, mod):
            for j in range(1, len(k)):
                for order in range(min(j + 1, 3)):
                    grams[order][tuple(k[j - order : j + 1])] += 1
    n, d = sum(grams[0].values()), []
    for g in grams:
        once, twice = (sum(x == y for x in g.values()) for y in (1, 2))
        d.append(once / (once + 2 * twice) if once and twice else 0.5)
    after = [Counter(), Counter()]
    for order in (1, 2):
        for x, m in grams[order].items():
            if m >= 2:
                after[order - 1][x[:-1]] += m - d[order]

    def p(x):
        if len(x) == 1:
            return 1 if not n else (grams[0][x] - d[0] if grams[0][x] else d[0] * len(grams[0])) / n
        order, total = len(x) - 1, grams[len(x) - 2][x[:-1]]
        if not total:
            return p(x[1:])
        m = grams[order][x]
        return (m - d[order] if m >= 2 else 0) / total + (1 - after[order - 1][x[:-1]] / total) * p(x[1:])

    return sorted([(repr(i), round(sum(math.log10(p(tuple(k[max(0, j - 2) : j + 1]))) for j in range(1, len(k))), 6)) for i, k in docs])


@pytest.mark.parametrize("block", [8 << 20, 20_000])
def test_scores_equal_brute_force_whatever_the_size_of_the_corpus(spark, monkeypatch, block):
    """Words and n-grams that occur twice among 100,000 tokens keep their own arcs."""
    monkeypatch.setattr(lm_score, "BLOCK_BYTES", block)
    rng = random.Random(11)
    twins = [(1000 + i, f"alpha{i // 2} beta{i // 2} gamma{i // 2} delta{i}", "en") for i in range(60)]
    docs = documents(spark, rows=[*twins, *[(i, "the " * 900 + prose(rng, "en", 30), "en") for i in range(120)], (500, None, "en"), (None, "", "en"), (501, "unseen words", "en"), (501, "unseen words", "en")])
    got = lm_score.score(docs.withColumn("h", fold(F.col("doc_id"), 10) == 0), fold(F.col("doc_id"), 10) != 0, carry=["doc_id"])
    assert sorted((repr(r.doc_id), round(r.score, 6)) for r in got.collect()) == brute_score([(r.doc_id, r.text) for r in docs.collect()])


def test_traversal_is_a_distribution_and_carries_its_state():
    """Brute force over the arcs: in each state the known words and the unknown one sum to one,
    and a long text in parts scores like the walk through one state after the other."""
    rng = random.Random(5)
    texts = pa.array([" ".join(rng.choice(["a b c", "d e f", "x"]) for _ in range(n)) for n in (1, 3, 40, 700, 300)] + ["", "new"])
    g = lm_score.Grams(texts, lm_score.Keys(0, 60, 40))
    n = len(g.word)
    c, pairs = np.bincount(g.word), np.bincount(g.pair)
    at, u, e, i = g.triples(pairs, np.bincount(g.mark) >= 2)
    triples = np.bincount(i, minlength=len(u))
    c[np.searchsorted(g.words, lm_score.tokens(pa.array(["new"]))[0][:1])] = 0  # as if held out

    def after(counts, context, contexts):
        kept, some = counts >= 2, contexts >= 2
        return tuple(np.bincount(context[kept], x, minlength=len(some)).astype(int)[some] for x in (counts[kept], np.ones(kept.sum())))

    have = {1: (c, c), 2: (pairs, pairs), 3: (triples, triples), 4: after(pairs, g.before[g.example], c), 5: after(triples, g.pair[e - 1], pairs), 6: (np.bincount(g.mark) >= 2, 0)}
    auto, start = g.automaton(have, n - 1, len(c) - 1, 0.5, 0.4, 0.3)
    arcs = {int(k): (int(t), float(w)) for k, t, w in zip(auto.keys, auto.targets, auto.weights, strict=True)}

    def step(state, word):
        total = 0.0
        while (k := state * auto.symbols + word) not in arcs:
            total += auto.failure_weights[state]
            state = int(auto.failures[state])
        return arcs[k][0], total + arcs[k][1]

    for state in {0, start, *auto.targets.tolist()}:
        assert abs(sum(10 ** step(state, w)[1] for w in range(len(c))) - 1) < 1e-6
    want = []
    for a, z in zip(g.first[:-1], g.first[1:], strict=True):
        state = start
        for w in g.word[a:z]:
            state, p = step(state, int(w))
            want.append(p)
    assert np.allclose(auto.traverse(g.first, start), want)


@pytest.mark.parametrize("x", [[], [0], [0, 0, 0], [5, 300, 2**40], [2**64 - 1, 0]])
def test_packed_numbers_come_back(x):
    x = np.array(x, dtype=np.uint64)
    assert (lm_score.unpacked(lm_score.packed(x)) == x).all()
    if len(x):
        assert (lm_score.ascended(lm_score.ascending(np.sort(x))) == np.sort(x)).all()


def brute_kneser_ney(texts, order=quality.ORDER):
    """Probabilities of the definition: interpolated, three discounts, continuation counts below the top."""
    tables = [Counter() for _ in range(order + 1)]
    for t in texts:
        k = "\0" * (order - 1) + t
        tables[order].update(k[i - order + 1 : i + 1] for i in range(order - 1, len(k)))
    for k in range(order - 1, 0, -1):
        tables[k] = Counter(g[1:] for g in tables[k + 1])
    spent = [None]
    for k in range(1, order + 1):
        n = Counter(tables[k].values())
        n = [n.get(i) or 1 for i in range(5)]
        y = n[1] / (n[1] + 2 * n[2])
        spent.append([0, *(min(max(i - (i + 1) * y * n[i + 1] / n[i], 0.05), i - 0.05) for i in (1, 2, 3))])
    by = [{} for _ in range(order + 1)]
    for k in range(1, order + 1):
        for g, n in tables[k].items():
            by[k].setdefault(g[:-1], []).append(n)

    def p(g):
        k = len(g)
        if not k:
            return 1 / (1 << quality.BITS)
        have = by[k].get(g[:-1])
        if have is None:
            return p(g[1:])
        n, d = tables[k][g], spent[k]
        return ((n - d[min(n, 3)]) / sum(have) if n else 0) + sum(d[min(x, 3)] for x in have) / sum(have) * p(g[1:])

    return p


def test_quality_equals_kneser_ney_by_the_definition(spark, monkeypatch):
    """Perplexities in several scripts and blocks; nulls, empties, repeats, a long text, ties and clashing names."""
    monkeypatch.setattr(quality, "BLOCK_BYTES", 4_000)
    rng = random.Random(21)
    scripts = {"ru": "\u043e\u043d \u0438 \u0432\u043e \u0441\u0442\u043e \u043d\u0430 \u043f\u043e \u0440\u0435".split(), "zh": "\u7684 \u4e00 \u662f \u4e0d \u4e86 \u5728 \u4eba \u6709".split(), "xx": ["\U0001f600", "\U00020000x", "q"]}
    rows = [(i, prose(rng, "en", rng.randint(1, 60)), "en") for i in range(60)]
    rows += [(100 + i, " ".join("".join(rng.choice(scripts[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 40))), lang) for i in range(60) for lang in [rng.choice(sorted(scripts))]]
    rows += [(200, None, "en"), (201, "", "ru"), (202, "the end " * 3_000, "en"), (203, "ab\x00c \u0410\u0411!", None), (204, rows[0][1], "en"), (204, rows[0][1], "en"), (None, "null key", "en")]
    docs = documents(spark, rows=rows).withColumnRenamed("source", "perplexity").withColumnRenamed("n_chars", "k")
    marks = [(i, int(i % 3 != 0)) for i, _, _ in rows if i is not None and i < 200] + [(3, None), (None, 1), (4, 0)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int")
    good = {i for i, m in marks if m == 1 and i not in (None, 4)}

    def folded(t):
        return "".join(chr(max(1, ord(c) if ord(c) < 1 << 16 else 0xE000 + ord(c) % 0x1900)) for c in t or "")

    p = brute_kneser_ney([folded(t) for i, t, _ in rows if i in good])
    want = []
    for _, t, _ in rows:
        k = "\0" * (quality.ORDER - 1) + folded(t)
        bits = [-math.log2(p(k[i - quality.ORDER + 1 : i + 1])) for i in range(quality.ORDER - 1, len(k))]
        want.append(2 ** (sum(bits) / len(bits)) if bits else None)
    got = quality.classify(docs, labels).collect()
    key = lambda r: (r[0] is None, r[0] or 0)
    for r, (i, x) in zip(sorted(got, key=key), sorted(((i, x) for (i, _, _), x in zip(rows, want, strict=True)), key=key), strict=True):
        assert r.doc_id == i and (r.perplexity is None) == (x is None) and (x is None or abs(r.perplexity - x) < 6e-5)
    for lang in ("en", "ru", "zh", "xx"):
        mine = sorted(x for (i, _, own), x in zip(rows, want, strict=True) if i in good and own == lang and x is not None)
        have = next(r for r in got if r.lang == lang)
        assert mine[0] * 0.9999 <= have.threshold_low <= have.threshold_high <= mine[-1] * 1.0001
    for r in got:
        if r.perplexity is not None and min(abs(r.perplexity - r.threshold_low), abs(r.perplexity - r.threshold_high)) < 1e-4:
            continue  # told apart by digits that the result rounds
        assert r.keep == (r.perplexity is not None and r.threshold_low <= r.perplexity <= r.threshold_high)


def test_quality_judges_by_language(spark, monkeypatch):
    docs = documents(spark, 300)
    labels = docs.where("doc_id < 300").select("doc_id", F.lit(1).alias("quality"))
    more = docs.unionByName(documents(spark, rows=[(900, "QQ!! ZZ## XX%% " * 20, "en"), (901, None, None), (902, "the end on the hand", "xx")]))
    got = {r.doc_id: r for r in quality.classify(more, labels).collect()}
    assert not got[900].keep and not got[901].keep and got[901].perplexity is None and got[902].threshold_high is not None
    good = [r for i, r in got.items() if i is not None and i < 300]
    assert sum(r.keep for r in good) > 0.95 * len(good)
    assert quality.classify(documents(spark, rows=[]), labels).count() == 0
    assert all(r.keep for r in quality.classify(docs.where("doc_id < 9"), labels.where("false")).collect())
    monkeypatch.setattr(quality, "HANDED", 0)  # more trusted keys than may be handed out
    assert {(r.doc_id, r.keep) for r in quality.classify(more, labels).collect()} == {(i, r.keep) for i, r in got.items()}
