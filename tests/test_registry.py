import datetime as dt

import pandas as pd
from pyspark.sql import functions as F

from kelpgraph.operators import registry as R
from kelpgraph.streaming import changes


def test_warm_boundaries(spark):
    rows = spark.createDataFrame([(0,), (50_000,), (50_000 - 21_600,), (50_000 - 21_601,), (None,)], "q long")
    assert [r[0] for r in rows.select(R.is_warm(F.col("q"), F.lit(50_000))).collect()] == [False, True, True, False, False]


def test_freshness(spark):
    rows = spark.createDataFrame([("a", 1000, 1000), ("b", None, None)], "hash string, last_indexed_unix long, last_queried_unix long")
    a, b = R.freshness(rows, F.lit(4600), 3600).orderBy("hash").collect()
    assert (a["warm"], a["seconds_since_indexed"]) == (True, 3600) and (b["indexed"], b["seconds_since_indexed"]) == (False, None)


def test_usage_and_reads_avoided(spark):
    calls = spark.createDataFrame([("trace_call_path", False, 1.0, 300, 1), ("trace_call_path", True, 3.0, 300, 2), ("trace_call_path", False, 2.0, 300, 3), ("search_code", False, 1.0, 50, 4)], "name string, error boolean, latency double, bytes long, at long")
    stats = R.usage_stats(calls, "name")
    row = stats.where("name = 'trace_call_path'").first()
    assert (row["call_count"], row["error_count"], row["max_latency"], row["avg_latency"], row["last_called"]) == (3, 1, 3.0, 2.0, 3)
    assert tuple(R.reads_avoided(stats).first()) == (2, 900, 225)
    assert tuple(R.reads_avoided(stats.where("false")).first()) == (0, 0, 0)


def evicted(spark, watched, estimate, budget):
    frame = spark.createDataFrame(watched, "path string, weight long, last_queried long")
    return [r["path"] for r in R.plan_admission(frame, estimate, budget).orderBy("last_queried", "path").collect()]


def test_admission(spark):
    assert evicted(spark, [("a", 10, 100)], 5, 20) == []
    assert evicted(spark, [("old", 10, 100), ("new", 10, 500)], 5, 15)[:1] == ["old"]
    assert evicted(spark, [("oldest", 5, 100), ("middle", 5, 200), ("newest", 5, 300)], 6, 11) == ["oldest", "middle"]
    assert evicted(spark, [("a", 5, 100)], 30, 20) == []
    assert evicted(spark, [], 5, 20) == []
    assert evicted(spark, [("b", 10, 100), ("a", 10, 100)], 5, 15)[:1] == ["a"]


def test_limits():
    assert [R.clamp_limit(n) for n in (1, 200, 201, 100_000)] == [1, 200, 200, 200] and R.clamp_semantic_limit(200) == 30
    assert (R.watch_budget(65_536), R.watch_budget(100), R.watch_budget(None)) == (32_768, 256, 4096)


def test_dirty_roots_take_the_longest(spark):
    paths = spark.createDataFrame([("/a/b/c.py",), ("/a/x.py",), ("/ab/y.py",), ("/z",)], "path string")
    roots = spark.createDataFrame([("/a",), ("/a/b",)], "root string")
    assert {r["path"]: r["root"] for r in R.dirty_roots(paths, roots).collect()} == {"/a/b/c.py": "/a/b", "/a/x.py": "/a"}


def test_watch_changes(spark):
    p = lambda *x: spark.createDataFrame([(i,) for i in x], "path string")
    got = {(r["path"], r["action"]) for r in R.watch_changes(p("a", "b"), p("b", "c", "d"), p("d")).collect()}
    assert got == {("a", "drop"), ("c", "add")}


def _events(spark, seconds, key="k"):
    base = dt.datetime(2025, 1, 1)
    return spark.createDataFrame([(key, base + dt.timedelta(seconds=s)) for s in seconds], "key string, at timestamp")


def test_debounce_and_cooldown(spark):
    events = _events(spark, [0, 1, 2.5, 10, 11.5, 200])
    got = sorted(r["events"] for r in R.debounce_sessions(events, ["key"], "at", 2).collect())
    assert got == [1, 2, 3]
    events = _events(spark, [0, 100, 179, 180, 300, 361]).unionByName(_events(spark, [5, 6], "other"))
    kept = R.cooldown_filter(events, ["key"], "at", 180).groupBy("key").count().collect()
    assert {r["key"]: r["count"] for r in kept} == {"k": 3, "other": 1}


def test_cooldown_equals_brute_force(spark):
    import random

    r = random.Random(4)
    rows = [(f"k{r.randint(0, 5)}", r.randint(0, 5000)) for _ in range(600)]
    frame = spark.createDataFrame(rows, "key string, at long")
    got = sorted(map(tuple, R.cooldown_filter(frame, ["key"], "at", 180).collect()))
    want, last = [], {}
    for key, at in sorted(rows):
        if key not in last or at - last[key] >= 180:
            want.append((key, at))
            last[key] = at
    assert got == sorted(want)


def test_latest_projects(spark):
    rows = spark.createDataFrame([("/a", "h", 1, 9), ("/b", "h", 2, None), ("/b", "h", 2, None), ("/c", None, 5, 5)], "root_path string, hash string, last_indexed_unix long, last_queried_unix long")
    assert [r["root_path"] for r in R.latest_projects(rows).collect()] == ["/b"]


def test_streams(spark, tmp_path):
    base = dt.datetime(2025, 1, 1)
    frame = pd.DataFrame([("p", base + dt.timedelta(seconds=s), m) for s, m in [(0, 1), (10, 2), (200, 1), (400, 3), (401, 4), (900, 3)]], columns=["path", "at", "signature"])
    spark.createDataFrame(frame, "path string, at timestamp, signature long").coalesce(1).write.parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema("path string, at timestamp, signature long").parquet(str(tmp_path / "in"))
    stream = changes.gated_changes(source()).writeStream.format("memory").queryName("gated").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).start()
    stream.processAllAvailable()
    stream.stop()
    assert [(r["at"] - base).seconds for r in spark.table("gated").orderBy("at").collect()] == [0, 400]
    stream = changes.debounced(source(), ["path"], "at").writeStream.format("memory").queryName("bursts").outputMode("append").option("checkpointLocation", str(tmp_path / "c2")).start()
    stream.processAllAvailable()
    stream.stop()
    assert sum(r["events"] for r in spark.table("bursts").collect()) >= 4
