import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.llm import decontaminate, license_scan, packing, sharding, topk
from lodestone.llm.queries import tokenizer_path
from tests.llm.helpers import documents, prose


def edits(p: bytes, t: bytes) -> int:
    prev = [0] * (len(t) + 1)
    for i, x in enumerate(p):
        cur = [i + 1]
        for j, y in enumerate(t):
            cur.append(min(prev[j] + (x != y), prev[j + 1] + 1, cur[j] + 1))
        prev = cur
    return min(prev)


def test_myers_equals_dynamic_programming():
    rng = random.Random(1)
    for _ in range(300):
        p = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 14)))
        t = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 25)))
        assert decontaminate.distance(p, t, 99)[0] == edits(p, t)


def test_matches_equal_brute_force(spark):
    rng = random.Random(6)
    items = [(i, prose(rng, "en", 25)) for i in range(8)] + [(20, "no"), (21, "!!"), (22, None), (None, "the end")]
    rows = []
    for i in range(60):
        t = prose(rng, "fr", rng.randint(3, 60)).split()
        if i % 3 == 0:
            hit = list(items[i % 8][1])
            for _ in range(rng.randint(0, 14)):
                hit[rng.randrange(len(hit))] = rng.choice("abcxyz ")
            t.insert(rng.randrange(len(t)), "".join(hit).upper() if i % 2 else "".join(hit).replace(" ", ",  "))
        rows.append((i, " ".join(t), "en"))
    rows += [(100, None, "en"), (101, "", "en"), (102, "say No.", "en"), (103, "nothing", "en")]
    docs, bench = documents(spark, rows=rows), spark.createDataFrame(items, "item_id long, text string")
    want = set()
    for i, t, _ in rows:
        for k, x in items:
            p = decontaminate.text_of(x)
            body = b" " + decontaminate.text_of(t) + b" "
            if k is None or not p:
                continue
            budget = int(len(p) * 0.06)
            d = edits(p, body) if budget else (0 if b" " + p + b" " in body else 1)
            if d <= budget:
                want.add((i, k, d))
    got = decontaminate.matches(docs, bench)
    assert {(r.doc_id, r.item_id, r.distance) for r in got.collect()} == want and len(want) > 10
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, _, _ in rows} - {i for i, _, _ in want}
    assert decontaminate.matches(documents(spark, rows=[]), bench).count() == 0
    assert decontaminate.matches(docs, bench.where("false")).count() == 0 and decontaminate.clean(docs, bench.where("false")).count() == len(rows)


def test_items_in_very_long_texts_ties_and_clashing_names(spark):
    rng = random.Random(12)
    item = prose(rng, "en", 30)
    at = next(i for i in range(40, 60) if item[i].isalpha())
    near = f"{item[:at]}q{item[at + 1 :]}"
    long = " ".join([prose(rng, "de", 60_000), near, prose(rng, "de", 5_000), item, prose(rng, "de", 60_000), item])
    rows = [(1, long, 5, 6), (2, f"{near} and {near}", 5, 6), (3, "x " * 400_000, None, None), (2, f"{near} and {near}", 5, 6)]
    docs = spark.createDataFrame(rows, "end long, text string, item long, distance long")
    bench = spark.createDataFrame([(7, item), (7, item), (8, None)], "distance long, text string")
    got = decontaminate.matches(docs, bench, key="end", item_key="distance")
    assert got.columns == ["matched_key", "matched_item", "distance", "end"]
    found = sorted(map(tuple, got.collect()))
    assert [r[:3] for r in found] == [(1, 7, 0), (2, 7, 1), (2, 7, 1)]
    # Of equally good places the first: the exact one before the second exact one, the first of two near ones.
    assert found[0][3] == 1 + len(decontaminate.text_of(long[: long.index(item)])) + 1 + len(decontaminate.text_of(item))
    assert found[1][3] == 1 + len(decontaminate.text_of(near))


def test_licences_in_very_long_texts_and_clashing_names(spark):
    long = "word " * 300_000 + "\nReleased under the MIT License.\n" + "more\n" * 100_000
    rows = [(1, "a/x", long, "n"), (2, "a/x", long, "n"), (2, "a/x", long, "n"), (3, "b/LICENSE", "\n".join(["Released under the MIT License."] + ["text"] * 50_000), "n")]
    files = spark.createDataFrame(rows, "score long, path string, text string, origin string")
    got = license_scan.scan(files, key="score")
    assert got.columns == ["path", "licence", "score", "origin", "declared_in"]
    assert sorted((r.path, r.licence, r.origin) for r in got.collect()) == [("a/x", "MIT", "header")] * 3 + [("b/LICENSE", "MIT", "file")]


def test_licences_are_found_and_inherited(spark):
    rows = [(1, "a/LICENSE", "Licensed under the Apache License, Version 2.0."), (2, "a/b/c.py", "hello"), (3, "a/b/", "x\nReleased under the MIT License.\ny"), (4, "z.txt", "All rights reserved."), (5, None, None), (6, "q/w.txt", "some license"), (7, "a/k.txt", ""), (7, "a/k.txt", ""), (8, "a/b/d/e/f", "no"), (9, "COPYING.md", "This work is licensed under the GNU General Public License, version 3."), (10, "ab/c", "x")]
    files = spark.createDataFrame([(i, p, t, "clash") for i, p, t in rows], "page_id long, path string, text string, licence string")
    got = sorted((r.page_id, r.licence, r.origin, r.declared_in) for r in license_scan.scan(files).collect())
    assert got == [
        (1, "Apache-2.0", "file", None), (2, "MIT", "inherited", "a/b/"), (3, "MIT", "header", None), (4, "proprietary", "header", None), (5, None, None, None), (6, "GPL-3.0", "inherited", ""),
        (7, "Apache-2.0", "inherited", "a/"), (7, "Apache-2.0", "inherited", "a/"), (8, "MIT", "inherited", "a/b/"), (9, "GPL-3.0", "file", None), (10, "GPL-3.0", "inherited", ""),
    ]
    assert license_scan.scan(files.where("false")).count() == 0


def test_ordinary_words_of_a_notice_have_their_own_document_frequency(spark):
    """A common word weighs little, in a table of many files too."""
    rows = [(1, "a/x.py", "Code in this repository is licensed under the Apache License, Version 2.0.")]
    rows += [(i, f"b/{i}", "Licensed under the Apache License, Version 2.0." if i % 10 == 0 else "code in this repository is this") for i in range(2, 4000)]
    files = spark.createDataFrame(rows, "page_id long, path string, text string")
    assert [(r.licence, r.origin) for r in license_scan.scan(files).where("page_id = 1").collect()] == [("Apache-2.0", "header")]


def test_whole_licence_files_and_wrapped_headers_are_found(spark):
    mit = f"MIT License\n\nCopyright (c) 2024 Jo Doe\n\n{license_scan._MIT}\n\nThe above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.\n\n{license_scan._MIT_END}\n"
    bsd = f"BSD 3-Clause License\n\nCopyright (c) 2019, Foo Labs\nAll rights reserved.\n\n{license_scan._BSD}\n\n{license_scan._BSD_END}"
    gpl = "".join(f" * {x}\n" for x in ["This program is free software: you can redistribute it and/or modify", "it under the terms of the GNU General Public License as published by", "the Free Software Foundation, either version 3 of the License, or", "(at your option) any later version."])
    rows = [(1, "m/LICENSE", mit), (2, "b/COPYING", bsd), (3, "g/x.c", f"/*\n{gpl} */\nint main;\n"), (4, "h/y.py", gpl.replace(" *", "#") + "import os\nimport sys, re, json\n"), (5, "p/z.c", "// Copyright (c) 2024 Foo Inc. All rights reserved.\nint x;"), (6, "m/code.py", "import os"), (7, "q/w.py", "# Copyright 2024 Foo\nx = 1")]
    files = spark.createDataFrame(rows, "page_id long, path string, text string")
    got = sorted((r.page_id, r.licence, r.origin) for r in license_scan.scan(files).collect())
    assert got == [(1, "MIT", "file"), (2, "BSD-3-Clause", "file"), (3, "GPL-3.0", "header"), (4, "GPL-3.0", "header"), (5, "proprietary", "header"), (6, "MIT", "inherited"), (7, None, None)]


@pytest.mark.parametrize("spread", [1.0, 0.05])
def test_top_k_equals_brute_force(spark, spread):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(700, 12)) * np.exp(rng.normal(size=(700, 1)) * spread)
    v[100:160] = v[100]
    rows = [(int(i), [float(x) for x in v[i]], 0) for i in range(700)] + [(700, None, 0), (701, [1.0, None], 0), (702, [float("nan")] * 12, 0), (703, [float("inf")] + [0.0] * 11, 0), (704, [0.0] * 12, 0), (750, [0.0] * 12, 0), (None, [1.0] * 12, 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int").repartition(5)
    whole = F.transform("embedding", lambda x: F.floor(x * 256).cast("long"))
    vectors = topk.clean(table, "vec_id", "embedding", whole)
    got = topk.top_k(vectors, vectors.where("id % 50 = 0"), k=5)
    x = {i: np.floor(np.array(e) * 256).astype(np.int64) for i, e, _ in rows if i is not None and (i < 700 or i in (704, 750))}
    want = []
    for q in (i for i in x if i % 50 == 0):
        best = sorted(((-int(x[q] @ x[i]), i) for i in x if i != q))[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert topk.top_k(vectors, vectors.where("false")).count() == 0
    alone = vectors.where("id = 50")
    assert topk.top_k(alone, alone).count() == 0


def test_encoder_equals_the_tokenizer():
    rng = random.Random(8)
    texts = ["it's A'sx 'Tis <|endoftext|>hi a|b é—!x x́! ≠ a1b22!! foo--bar\x01 \x01 q\x01\x01", "", None, " a b c .,é. It'S", "ß İ ſ K Å ﬁ 日本語テキスト 😀😀 áb", *("".join(rng.choice("aB'sé.,! \n\t0#<|>́ ") for _ in range(40)) for _ in range(200))]
    coder = packing.Encoder(tokenizer_path())
    ids, at = coder.encode(*packing.buffer(pa.array(texts, pa.string())))
    for i, t in enumerate(texts):
        assert list(ids[at[i] : at[i + 1]]) == coder.t.encode(t or "", add_special_tokens=False).ids


def test_other_tokenizers_get_whole_texts():
    """A cased byte-level tokenizer, whose blanks are part of its tokens."""
    import public_tokenizers

    coder = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["It's A  test", None, "", "\n\n x", "it's a  test"]
    ids, at = coder.encode(*packing.buffer(pa.array(texts, pa.string())))
    assert coder.whole and not packing.Encoder(tokenizer_path()).whole
    for i, t in enumerate(texts):
        assert list(ids[at[i] : at[i + 1]]) == coder.t.encode(t or "", add_special_tokens=False).ids


def test_bins_hold_little():
    bins, rng = packing.Bins(0), random.Random(2)
    for i in range(4000):
        bins.add(i, np.zeros(rng.randint(1, 30_000), dtype="<u4"))
        bins.done = []
    assert sum(len(p[2]) for parts in bins.open.values() for p in parts) < 130 * 4096


def test_packing_with_clashing_names_and_other_keys(spark):
    rows = spark.createDataFrame([("a", "one two", 1, 2), ("a", "one two", 1, 2), (None, None, None, None)], "k string, t string, start long, length long")
    got = packing.pack(rows, tokenizer_path(), key="k", text="t").collect()
    assert sum(r.length for r in got if r.k == "a") == 6 and [(r.start, r.length) for r in got if r.k is None] == [(0, 1)]
    assert packing.pack(rows, tokenizer_path(), key="start", text="t").columns[0] == "start"


def test_packing_places_each_id_once(spark):
    docs = documents(spark).repartition(3)
    got = packing.pack(docs, tokenizer_path()).toPandas()
    coder = packing.Encoder(tokenizer_path())
    by_id = {r.doc_id: [*coder.t.encode(r.text or "", add_special_tokens=False).ids, 2] for r in docs.collect()}
    once = got[got.doc_id.notna() & (got.doc_id != 127)]
    for i, own in once.sort_values("start").groupby("doc_id"):
        ids, at = by_id[int(i)], 0
        for r in own.itertuples():
            assert r.start == at and r.doc_tokens == len(ids)
            at += r.length
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : at], dtype="<u4").tobytes())
        assert at == len(ids)
    fill = got.groupby("sequence_id").length.sum()
    ordered = got.sort_values(["sequence_id", "offset"])
    assert (ordered.offset == ordered.groupby("sequence_id").length.cumsum() - ordered.length).all() and fill.max() <= 4096
    padded = sum(4096 - n for n in fill if n & (n - 1))
    assert padded <= 0.02 * fill.sum()
    assert packing.pack(documents(spark, rows=[]), tokenizer_path()).count() == 0


def test_cuts_are_class_lengths():
    for n in [*range(0, 9000, 7), 4096, 4095, 1]:
        parts = packing.cuts(n)
        assert sum(parts) == n and all(4096 // (4096 // p) == p or p <= packing.TAIL for p in parts)


def test_shards_are_exact_and_gapless(spark):
    docs = documents(spark, 230).repartition(6)
    got = sharding.shuffle(docs, shards=24)
    rows = got.toPandas()
    counts = rows.groupby("shard").slot.agg(["count", "min", "max", "nunique"])
    assert len(rows) == docs.count() and counts["count"].max() - counts["count"].min() <= 1
    assert (counts["min"] == 0).all() and (counts["max"] == counts["count"] - 1).all() and (counts["nunique"] == counts["count"]).all()
    text = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    assert all(r.size_ == len(text[int(r.doc_id)]) + 8 and r.text_crc32 == zlib.crc32(text[int(r.doc_id)]) for r in rows.rename(columns={"size": "size_"}).dropna(subset=["doc_id"]).itertuples())
    assert sharding.shuffle(documents(spark, rows=[])).count() == 0
    few = sharding.shuffle(documents(spark, rows=[(1, "a", "en"), (1, "a", "en"), (None, None, None)])).toPandas()
    assert len(few) == 3 and sorted(few.slot) == [0, 0, 0] and few.shard.nunique() == 3


def test_matrix_has_exact_sums_and_the_right_law():
    counts = [5, 0, 17, 30, 1]
    sent = np.array(sharding.matrix(counts, 7, 1))
    assert list(sent.sum(axis=1)) == counts and sent.sum(axis=0).max() - sent.sum(axis=0).min() <= 1
    first = np.array([sharding.matrix([4, 4], 2, s)[0][0] for s in range(2000)])
    want = [1 / 70, 16 / 70, 36 / 70, 16 / 70, 1 / 70]  # hypergeometric
    assert all(abs((first == k).mean() - p) < 0.04 for k, p in enumerate(want))


@pytest.mark.parametrize(("good", "bad", "n"), [(4, 4, 4), (1, 9, 3), (30, 12, 20), (7, 0, 3), (5, 9, 14), (2, 3, 0)])
def test_draws_have_the_exact_law(good, bad, n):
    rng = np.random.default_rng(3)
    got = Counter(sharding.drawn(rng, good, bad, n) for _ in range(8000))
    want = {k: math.comb(good, k) * math.comb(bad, n - k) / math.comb(good + bad, n) for k in range(max(0, n - bad), min(n, good) + 1)}
    assert set(got) <= set(want)
    assert all(abs(got[k] / 8000 - p) < 5 * math.sqrt(p * (1 - p) / 8000) + 1e-9 for k, p in want.items())


def test_draws_beyond_ten_to_the_twelve():
    """Mean and variance of the law, and the exact ratio of two neighbours, where machine integers of 32 bits end."""
    rng, good, bad, n = np.random.default_rng(4), 4 * 10**11, 96 * 10**11, 3 * 10**7
    got = np.array([sharding.drawn(rng, good, bad, n) for _ in range(1500)])
    p = good / (good + bad)
    sd = math.sqrt(n * p * (1 - p) * (good + bad - n) / (good + bad - 1))
    assert abs(got.mean() - n * p) < 5 * sd / math.sqrt(1500) and abs(got.std() / sd - 1) < 0.1
    sent = np.array(sharding.matrix([10**10, 3 * 10**9, 1], 24, 5))
    assert list(sent.sum(axis=1)) == [10**10, 3 * 10**9, 1] and np.ptp(sent.sum(axis=0)) <= 1
