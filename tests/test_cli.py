"""The commands on small files."""

import json

import socket
import threading
import time

from pyspark.sql import functions as F

from lodestone.__main__ import COMMANDS, bloom_rates, distinct_counts, told
from lodestone.sources import file_stream, tracked, tweets
from lodestone.streaming import hashtags
from tests.test_operators import _bloom as filtered


def _lines(path):
    return sorted(line for p in path.glob("part-*") for line in p.read_text().splitlines())


def test_commands(spark, tmp_path):
    reviews = [{"user_id": f"u{i % 5}", "business_id": f"b{i % 3}", "date": f"201{i % 2 + 7}-01-01", "stars": i % 5 + 1} for i in range(30)]
    (tmp_path / "r.json").write_text("\n".join(map(json.dumps, reviews)))
    (tmp_path / "b.json").write_text("\n".join(json.dumps({"business_id": f"b{i}", "city": "X" if i else ""}) for i in range(3)))
    (tmp_path / "r.csv").write_text("user_id,business_id,stars\n" + "\n".join(f"u{i % 5},b{i % 3},{i % 5 + 1}" for i in range(30)))
    (tmp_path / "t.csv").write_text("user_id,business_id,stars\nu1,b1,3\nu9,b9,2\n")
    (tmp_path / "p.csv").write_text("\n".join(f"{i},0,{i % 2 * 50 + i % 7 / 10},{i % 2 * 50 - i % 5 / 10}" for i in range(60)))
    at = lambda x: str(tmp_path / x)
    COMMANDS["explore"](spark, at("r.json"), at("explore"))
    got = json.loads(_lines(tmp_path / "explore")[0])
    assert got["n_review"] == 30 and got["n_user"] == 5 and len(got["top10_user"]) == 5 and got["top10_business"][0] == {"business_id": "b0", "n": 10}
    COMMANDS["partitions"](spark, at("r.json"), at("partitions"), "2")
    got = json.loads(_lines(tmp_path / "partitions")[0])
    for kind in ("default", "customized"):
        assert len(got[kind]["n_items"]) == got[kind]["n_partitions"] and sum(got[kind]["n_items"]) == 30 and got[kind]["exe_time"] > 0
    assert got["customized"]["n_partitions"] == 2
    COMMANDS["cities"](spark, at("r.json"), at("b.json"), at("cities"), at("times"))
    assert "X\t3.0" in _lines(tmp_path / "cities") and json.loads(_lines(tmp_path / "times")[0]).keys() == {"m1", "m2", "explanation"}
    COMMANDS["itemsets"](spark, "1", "5", at("r.csv"), at("itemsets"))
    COMMANDS["active-itemsets"](spark, "2", "5", at("r.csv"), at("active"))
    text = next((tmp_path / "itemsets").glob("part-*")).read_text().splitlines()
    assert _lines(tmp_path / "itemsets") == _lines(tmp_path / "active")
    assert text == ["Candidates:", *(want := ["('b0'),('b1'),('b2')", "('b0', 'b1'),('b0', 'b2'),('b1', 'b2')", "('b0', 'b1', 'b2')"]), "Frequent Itemsets:", *want]
    COMMANDS["similar"](spark, at("r.csv"), at("similar"))
    assert _lines(tmp_path / "similar")[0] == "b0,b1,1.0"
    for case in ("1", "2", "3", "4"):
        COMMANDS["recommend"](spark, at("r.csv"), at("t.csv"), case, at(f"recommend{case}"))
    COMMANDS["communities"](spark, at("r.csv"), at("communities"), "2")
    COMMANDS["betweenness"](spark, "2", at("r.csv"), at("edges"), at("groups"))
    assert len(_lines(tmp_path / "edges")) >= 10
    COMMANDS["cluster"](spark, at("p.csv"), "2", "2", at("cluster"))
    assert len(_lines(tmp_path / "cluster")) > 60


def test_bloom_command_takes_a_socket_and_goes_on_after_a_restart(spark, tmp_path):
    """Two runs over one home: the second knows what the first has seen."""
    cities, home, out = [f"city{i * 7 % 45}" for i in range(200)], str(tmp_path / "home"), tmp_path / "rates"
    for part in (cities[:120], cities[120:]):
        spark.createDataFrame([(x,) for x in part], "city string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        bloom_rates(file_stream(spark, str(tmp_path / "in"), "city string"), str(out), home)
    rates = [float(r.FPR) for r in spark.read.csv(str(out), header=True).orderBy("Time").collect()]
    want = filtered(cities)
    assert sorted(rates) == sorted(round(sum(want[:n]) / n, 6) for n in (120, 200))

    server = socket.create_server(("localhost", 0))
    stop = threading.Event()

    def serve():
        link, _ = server.accept()
        with link:
            while not stop.is_set():
                try:
                    link.sendall(b'{"city": "Tempe"}\n{"other": 1}\n')
                except OSError:
                    return
                time.sleep(0.3)

    threading.Thread(target=serve, daemon=True).start()
    told_ = tmp_path / "told"
    runs = threading.Thread(target=lambda: COMMANDS["bloom"](spark, str(server.getsockname()[1]), str(told_)), daemon=True)
    runs.start()
    for _ in range(90):
        if list(told_.glob("part-*")):
            break
        time.sleep(1)
    for q in spark.streams.active:
        q.stop()
    stop.set()
    runs.join(30)
    assert "0.0" in _lines(told_)[0] or "FPR" in _lines(told_)[0]


def test_distinct_counts_and_hashtags(spark, tmp_path, capsys):
    rows = spark.range(90).select(F.timestamp_seconds(F.col("id") * 2).alias("ts"), F.concat(F.lit("c"), F.col("id") % 7).alias("city"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    distinct_counts(file_stream(spark, str(tmp_path / "in"), rows.schema), str(tmp_path / "out"), late="1 second")
    got = spark.read.csv(str(tmp_path / "out"), header=True)
    assert got.columns == ["Time", "Ground Truth", "Estimation"] and {r["Ground Truth"] for r in got.collect()} >= {"7"}
    posts = [json.dumps({"text": f"big Data {i}", "lang": "en", "entities": {"hashtags": [{"text": t} for t in (["a"] if i % 2 else ["a", "b", ""])]}}) for i in range(40)]
    posts += ['{"text": "data", "lang": "de", "entities": {"hashtags": [{"text": "x"}]}}', '{"text": "data", "lang": "en"}', "no json"]
    for part in (posts[:20], posts[20:]):
        spark.createDataFrame([(x,) for x in part], "value string").coalesce(1).write.mode("append").parquet(str(tmp_path / "tweets"))
    seen = []

    def each(total, top):
        seen.append((total, [tuple(r) for r in top.collect()]))
        told(total, top)

    hashtags(tracked(tweets(file_stream(spark, str(tmp_path / "tweets"), "value string")), ["data"]), each)
    assert seen == [(20, [("a", 20, 1), ("b", 10, 2)]), (40, [("a", 40, 1), ("b", 20, 2)])]
    assert "The number of tweets with tags from the beginning: 40\na:40\nb:20\n" in capsys.readouterr().out
