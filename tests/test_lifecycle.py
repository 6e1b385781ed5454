"""Answers to a caller and the life of registered projects."""

import json

from pyspark.sql import functions as F

from kelpgraph.functions.text import keyword_words
from kelpgraph.operators import answers, lifecycle
from kelpgraph.plans.router import keyword_search
from kelpgraph.sources import snapshot

PROJECT = "hash string, root_path string, last_indexed_unix long, last_queried_unix long, auto_reindex_count long, auto_reindex_fail_count long, auto_reindex_total_ms long"
ROWS = [("a", "/x//y/./z/", 100, 900, 1, None, 50), ("b", "/q", None, 10, None, 2, None), ("c", "rel/", 5, None, None, None, None)]


def projects(spark):
    return spark.createDataFrame(ROWS, PROJECT)


def test_bounded_answers_tell_the_total(spark):
    rows = spark.range(500).withColumnRenamed("id", "n")
    got = answers.bounded_answer(rows, [F.desc("n")], limit=1000).collect()
    assert len(got) == 200 and got[0]["n"] == 499 and got[0]["total"] == 500 and got[0]["shown"] == 200
    assert answers.bounded_answer(rows.limit(0), ["n"], limit=5).count() == 0
    few = answers.bounded_answer(rows.limit(3), ["n"], limit=5).first()
    assert few["total"] == 3 and few["shown"] == 3


def test_hits_are_cut_and_ordered(spark):
    rows = spark.createDataFrame([(i, "Function", f"n{i}", "q", "f.py", 1, 2, i / 100, "é" * 700) for i in range(60)] + [(99, "Function", "x", "q", "f.py", 1, 2, 0.9, None)], "id long, kind string, name string, qualified_name string, file_path string, start_line int, end_line int, score double, chunk_text string")
    got = answers.hit_answer(rows, limit=100).collect()
    assert len(got) == 30 and got[0]["id"] == 99 and got[0]["chunk_text"] is None and got[1]["chunk_text"] == "é" * 500 and got[1]["chunk_truncated"] and got[0]["total"] == 61


def test_json_has_sorted_keys_and_nulls(spark):
    row = answers.as_json(spark.createDataFrame([(1, None, "x")], "b int, a string, c string")).first()["json"]
    assert row == '{"a":null,"b":1,"c":"x"}' and list(json.loads(row)) == ["a", "b", "c"]


def test_tools_of_a_preset(spark):
    assert [len(answers.resolved_tools(p)) for p in ("minimal", "standard", "full")] == [5, 10, 14] and answers.resolved_tools() == answers.resolved_tools("standard")
    assert answers.resolved_tools("minimal", ["query_graph", "unknown"]) == ["query_graph"] and answers.resolved_tools("full", []) == []
    catalog = spark.createDataFrame([("search_code",), ("query_graph",), ("odd",)], "name string")
    assert [r["name"] for r in answers.enabled_definitions(catalog, answers.resolved_tools("minimal")).collect()] == ["search_code"]
    assert answers.enabled_definitions(catalog, []).count() == 0


def test_touch_moves_forward_only(spark):
    touches = spark.createDataFrame([("a", 500), ("b", 20), ("b", 30), ("z", 9)], "hash string, at long")
    got = {r["hash"]: r["last_queried_unix"] for r in lifecycle.touch_queried(projects(spark), touches).collect()}
    assert got == {"a": 900, "b": 30, "c": None}


def test_cold_projects_are_rebuilt_once(spark):
    asked = spark.createDataFrame([("a",), ("b",), ("b",), ("unknown",)], "hash string")
    calls = []
    after = lifecycle.touch_and_refresh(projects(spark), asked, 1000, 300, calls.append)
    assert calls == [["b"]] and {r["hash"]: r["last_queried_unix"] for r in after.collect()} == {"a": 1000, "b": 1000, "c": None}
    lifecycle.touch_and_refresh(projects(spark), asked.where("hash = 'a'"), 1000, 300, calls.append)
    assert len(calls) == 1


def test_rebuilds_are_counted(spark):
    runs = spark.createDataFrame([("a", True, 10), ("a", False, 99), ("b", None, 5), ("none", True, 1)], "hash string, ok boolean, millis long")
    got = {r["hash"]: (r["auto_reindex_count"], r["auto_reindex_fail_count"], r["auto_reindex_total_ms"]) for r in lifecycle.record_rebuilds(projects(spark), runs).collect()}
    assert got == {"a": (2, 1, 60), "b": (0, 3, 0), "c": (0, 0, 0)}


def test_eviction_and_its_cooldown(spark):
    watched = lifecycle.last_queried(spark.createDataFrame([("/q",), ("/x//y/./z/",), ("/new",)], "path string"), projects(spark))
    assert lifecycle.least_recent(watched).first()["path"] == "/new"
    rest, cooling = lifecycle.evict(watched, spark.createDataFrame([("/old", 50)], "path string, until long"), F.lit(100))
    assert sorted(r["path"] for r in rest.collect()) == ["/q", "/x//y/./z/"]
    assert [r["path"] for r in lifecycle.still_cooling(cooling, F.lit(399)).collect()] == ["/new"] and lifecycle.still_cooling(cooling, F.lit(400)).count() == 0
    assert lifecycle.least_recent(watched.limit(0)).count() == 0


def test_answers_are_kept_while_the_version_stands(spark):
    rows = spark.createDataFrame([(1, "k", 7, 1), (2, "k", 7, 2), (3, "k", 8, 3), (4, "k", 8, 4), (5, "j", 8, 5), (6, "n", None, 6), (7, "n", None, 7)], "request long, name string, version long, at long")
    assert {r["request"]: r["hit"] for r in lifecycle.cached_answers(rows, "name").collect()} == {1: False, 2: True, 3: False, 4: True, 5: False, 6: False, 7: True}


def test_status_and_roots(spark):
    row = lifecycle.status(projects(spark), F.lit(1000), 300, 4096).first()
    assert (row["projects"], row["indexed"], row["warm"], row["rebuilds"], row["failures"], row["budget"]) == (3, 2, 1, 1, 2, 4096)
    assert {r["hash"]: r["root_path"] for r in lifecycle.healed_roots(projects(spark), F.lit(1000), 300).collect()} == {"a": "/x/y/z", "b": "/q", "c": "rel/"}
    assert lifecycle.status(projects(spark).limit(0), F.lit(1), 1, 1).first()["rebuilds"] == 0


def test_words_keep_their_underscores(spark):
    assert keyword_words("the _private_helper, (and) it's?") == ["_private_helper", "it's"]
    nodes = spark.createDataFrame([(1, "a_b", "q1"), (2, "axb", "q2"), (3, "ab", "q3")], "id long, name string, qualified_name string")
    assert sorted(r["id"] for r in keyword_search(nodes, "find a_b").collect()) == [1, 2]


def test_notes_of_one_name_are_all_kept(spark, tmp_path):
    notes = spark.createDataFrame([("a/x.md", "1"), ("b/x.md", "2"), ("y.md", "3"), ("x.md", "4")], "file_name string, note string")
    assert snapshot.write_notes(notes, str(tmp_path / "n")) == 4
    assert sorted(p.name for p in (tmp_path / "n").iterdir()) == ["x-2.md", "x-3.md", "x.md", "y.md"] and sorted(p.read_text() for p in (tmp_path / "n").iterdir()) == ["1", "2", "3", "4"]
