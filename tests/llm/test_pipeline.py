import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import decontaminate, jaccard_join, language_id, packing, toxicity
from lodestone.llm.queries import QUERIES, table, tokenizer_path
from tests.llm.helpers import SYLLABLES, documents, prose
from tests.llm.test_jaccard_join import brute
from tests.llm.test_matching import edits


def test_stages_keep_columns_and_pass_on_what_is_left(spark, data):
    docs = table(spark, data, "documents")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, data).persist()
        left = {r.doc_id for r in docs.select("doc_id").collect()}
        assert left <= ids and left
        if name != "packing":
            assert docs.columns == columns
        else:
            assert left == ids
        if name == "jaccard_join":
            assert all(r.doc_id == r.component_id for r in jaccard_join.classes(docs, words=5, num=80, den=100).collect())
            assert {r.component_id for r in jaccard_join.classes(before, words=5, num=80, den=100).collect()} == left
        ids = left
    assert corpus_pipeline.run(spark, data).columns[0] == "doc_id"


def odd_tables(spark, folder):
    """Nulls in any column, empty and very long texts, ties, repeated rows and ids, clashing names."""
    rng = random.Random(31)
    rows, marks = [], []
    for i in range(160):
        lang = rng.choice(sorted(SYLLABLES))
        t = prose(rng, lang, rng.choice([4, 30, 90])).split()
        if i % 8 == 0:
            t[1:1] = ["grumbag", "snotling"]
        rows.append((i, " ".join(t), lang))
        marks.append((i, 1, int(i % 8 == 0)))
    item = prose(rng, "en", 30)
    rows += [(200, rows[1][1], "en"), (201, rows[1][1] + " tail", None), (1, rows[1][1], "en"), (1, "another " + rows[2][1], "en"), (202, None, None), (203, "", "en"), (204, " \n ", "fr"), (205, "12 34", "en"), (None, rows[3][1], "en"), (None, "the end of it", None)]
    rows += [(206, prose(rng, "en", 30_000), "en"), (207, f"{prose(rng, 'en', 20)} {item.upper()}. {prose(rng, 'en', 20)}", "en"), (208, "\u4e00\u4e8c\u4e09" * 30, None), (209, "\u4e00\u4e8c", None)]
    docs = documents(spark, rows=rows).withColumn("score", F.lit(1)).withColumn("component_id", F.lit("x")).withColumn("__own_0", F.lit(None).cast("int"))
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([*marks, (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None), (None, "the"), (3, "")], "item_id long, text string").coalesce(1).write.parquet(f"{folder}/benchmark.parquet")
    return rows, item


def listed(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def test_each_stage_equals_brute_force_on_odd_tables(spark, tmp_path):
    _, item = odd_tables(spark, tmp_path)
    folder = str(tmp_path)
    docs = table(spark, folder, "documents")
    stages = dict(corpus_pipeline.STAGES)

    def staged(name):
        nonlocal docs
        before = listed(docs)
        out = stages[name](spark, docs, folder)
        assert out.columns == docs.columns
        out.write.parquet(f"{folder}/out-{name}")
        model_docs, docs = docs, spark.read.parquet(f"{folder}/out-{name}")
        return before, listed(docs), model_docs

    before, after, was = staged("toxicity")
    model = toxicity.train(was, table(spark, folder, "labels"))
    weights = dict(zip(model.keys.tolist(), model.weights.tolist(), strict=True))

    def toxic(t):
        h, first = toxicity.word_hashes(*toxicity.buffer(pa.array([t or ""])), toxicity._WORD)
        return model.bias + sum(weights.get(f, 0) for f in {int(x) for f, _ in toxicity.features(h, first) for x in f}) >= 0

    assert after == [r for r in before if not toxic(r[1])]
    assert {i for i, _ in before} - {i for i, _ in after} >= set(range(0, 160, 8)) and {202, 203} <= {i for i, _ in after}

    before, after, was = staged("language_id")
    gone = {i for i, _ in before} - {i for i, _ in after}
    assert {202, 203, 204, 205, 208} <= gone and not gone & set(range(160)) and 206 not in gone
    pred = language_id.predict(was, language_id.train(was), carry=["doc_id"]).where("lang_pred = 'und'").select("doc_id").collect()
    assert {r.doc_id for r in pred} <= gone

    before, after, _ = staged("jaccard_join")
    component: dict = {}
    parent = brute([(n, t) for n, (_, t) in enumerate(before)], 5, 80, 100)  # rows by their place, so that repeated ids stay apart
    for n, _, c in parent:
        i, t = before[n]
        component.setdefault(c, set()).add((i is None, i or 0, t))
    left = sorted(((i is None, i or 0) for i, _ in after))
    assert left == sorted(min((none, i) for none, i, _ in rows) for rows in component.values())

    before, after, _ = staged("decontamination")
    p = decontaminate.text_of(item)
    holds = {i for i, t in before if (t or "") and len(t) < 5_000 and edits(p, b" " + decontaminate.text_of(t) + b" ") <= int(len(p) * 0.06)}
    assert holds == {207} and {i for i, _ in before} - {i for i, _ in after} == holds and len(after) == len(before) - 1

    packed = stages["packing"](spark, docs, folder).collect()
    coder = packing.Encoder(tokenizer_path())
    pieces = sorted(((r.doc_id, r.start, r.length, r.ids_crc32) for r in packed if r.doc_id is not None))
    want = {i: [*coder.t.encode(t, add_special_tokens=False).ids, 2] for i, t in after if i not in (None, 1)}
    for i, ids in want.items():
        mine = [x for x in pieces if x[0] == i]
        assert [x[1] for x in mine] == [sum(y[2] for y in mine[:k]) for k in range(len(mine))] and sum(x[2] for x in mine) == len(ids)
        assert all(x[3] == zlib.crc32(np.array(ids[x[1] : x[1] + x[2]], dtype="<u4").tobytes()) for x in mine)
    whole = corpus_pipeline.run(spark, folder)
    assert sorted((r.doc_id or 0, r.start, r.length) for r in whole.collect()) == sorted((r.doc_id or 0, r.start, r.length) for r in packed)


def test_stages_take_empty_tables(spark, tmp_path):
    odd_tables(spark, tmp_path)
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/{name}.parquet").where("false").coalesce(1).write.parquet(f"{tmp_path}/none/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_all_ten_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
