import math

from pyspark.sql import functions as F

from kelpgraph.functions import text as X
from kelpgraph.functions.vector import cosine, from_bytes, to_bytes, usable
from kelpgraph.operators import search
from kelpgraph.operators.files import line_window
from kelpgraph.plans.router import keyword_search, plan_query

NODE = "id long, kind string, name string, qualified_name string, file_path string, start_line int, end_line int"


def nodes_of(spark, names):
    return spark.createDataFrame([(i, "Function", n, f"q::{n}", "f.rs", 1, 2) for i, n in enumerate(names)], NODE)


def test_name_search_folds_ascii_only_and_takes_wildcards(spark):
    nodes = nodes_of(spark, ["HandleRequest", "a_b", "axb", "É", "a\\b"])
    find = lambda p: [r["name"] for r in search.search_by_name(nodes, p).collect()]
    assert find("request") == ["HandleRequest"] and find("a_b") == ["a\\b", "a_b", "axb"] and len(find("%")) == 5 and find("é") == [] and find("a\\") == ["a\\b"]


def test_phrase_search_matches_whole_folded_tokens(spark):
    texts = spark.createDataFrame([("1", "handle_request(x)"), ("2", "Handle Request élan"), ("3", "handle-request"), ("4", None), ("5", "")], "k string, content string")
    find = lambda q: sorted(r["k"] for r in search.search_phrase(texts, q, "k").collect())
    assert find("handle_request") == ["1", "2", "3"] and find("ELAN") == ["2"] and find("reques") == [] and find("++") == [] and find("") == []


def test_bm25_equals_its_formula(spark):
    texts = spark.createDataFrame([("1", "a b a b c"), ("2", "a b"), ("3", "x y z w"), ("4", "q"), ("5", "r s")], "k string, content string")
    got = {r["k"]: r["rank"] for r in search.search_phrase(texts, "a b", "k").collect()}
    mean, idf = (5 + 2 + 4 + 1 + 2) / 5, math.log((5 - 2 + 0.5) / 2.5)
    for key, hits, n in (("1", 2, 5), ("2", 1, 2)):
        assert abs(got[key] + idf * hits * 2.2 / (hits + 1.2 * (0.25 + 0.75 * n / mean))) < 1e-9


def test_neighbouring_hits_are_all_counted(spark):
    texts = spark.createDataFrame([("1", "a a a a")], "k string, content string")
    assert search.phrase_counts(texts, "a").first()["hits"] == 4


def test_snippet_marks_the_hit(spark):
    texts = spark.createDataFrame([("one two three Four five",), ("nothing",), (None,)], "content string")
    got = [r[0] for r in texts.select(search.snippet(F.col("content"), "three four", 4)).collect()]
    assert got == [" ... two >>>three Four<<< five", None, None]


def test_cosine_and_bytes(spark):
    rows = spark.createDataFrame([([1.0, 2.0, 3.0], [1.0, 2.0, 3.0]), ([1.0, 0.0], [0.0, 1.0]), ([0.0], [1.0]), ([1.0, 1.0], [1.0])], "a array<float>, b array<float>")
    got = [r[0] for r in rows.select(cosine(F.col("a"), F.col("b"))).collect()]
    assert abs(got[0] - 1) < 1e-6 and got[1] == 0 and got[2] == 0 and abs(got[3] - 1 / math.sqrt(2)) < 1e-6
    assert from_bytes(to_bytes([0.5, -2.5, 3.75, 0.0]) + b"xy") == [0.5, -2.5, 3.75, 0.0]


def test_usable_vectors(spark):
    rows = spark.createDataFrame([([1.0], 1), ([float("nan")], 1), ([0.0], 1), ([1.0], 2), (None, 1), ([None, 1.0], 2)], "v array<float>, dim int")
    assert [r[0] for r in rows.select(usable(F.col("v"), F.col("dim"))).collect()] == [True, False, False, False, False, False]


def test_reuse_split_is_scoped_by_model(spark):
    old = spark.createDataFrame([("unchanged", "m", "same text", 1, 1), ("changed", "m", "old text", 1, 2), ("other", "m2", "t", 1, 3)], "qualified_name string, model string, chunk_text string, embedded_at int, id long")
    new = spark.createDataFrame([(1, "unchanged", "m", "same text"), (2, "changed", "m", "new text"), (3, "brand_new", "m", "x"), (4, "other", "m", "t")], "node long, qualified_name string, model string, chunk_text string")
    assert {r["node"]: r["reuse"] for r in search.split_reusable(new, old).collect()} == {1: True, 2: False, 3: False, 4: False}


def test_byte_truncate(spark):
    rows = spark.createDataFrame([("short",), ("x" * 1000,), ("x" * 1500,), ("漢" * 1000,), (None,)], "t string")
    got = [tuple(r[0]) if r[0] else None for r in rows.select(X.byte_truncate(F.col("t"))).collect()]
    assert got[0] == ("short", False) and got[1] == ("x" * 1000, False) and got[2] == ("x" * 1000, True) and len(got[3][0].encode()) <= 1000 and got[3][1]


def windows(spark, n, **bounds):
    text = "\n".join(f"line {i}" for i in range(1, n + 1))
    return line_window(spark.createDataFrame([("f", text)], "file_path string, content string"), **bounds).first()


def test_line_windows(spark):
    assert not windows(spark, 10)["truncated"]
    r = windows(spark, 350)
    assert (r["last_line"], r["total"], r["truncated"]) == (300, 350, True)
    assert windows(spark, 350, start=10)["text"].startswith("line 10\n") and windows(spark, 350, start=10)["last_line"] == 309
    assert windows(spark, 400, end=350)["first_line"] == 51
    assert windows(spark, 350, full=True)["last_line"] == 350
    r = windows(spark, 4500, start=1, end=999_999)
    assert r["last_line"] == 4000 and r["truncated"]
    assert windows(spark, 10, start=8, end=3)["text"] == "" and windows(spark, 0)["total"] in (0, 1)


def test_line_window_byte_caps(spark):
    many = "\n".join("x" * 1000 for _ in range(1000))
    r = line_window(spark.createDataFrame([("f", many)], "file_path string, content string"), full=True).first()
    assert len(r["text"]) <= 300_000 and r["truncated"] and r["last_line"] == 299
    r = line_window(spark.createDataFrame([("f", "x" * 350_000)], "file_path string, content string"), full=True).first()
    assert len(r["text"]) == 300_000 and r["truncated"]


def test_router(spark):
    nodes = nodes_of(spark, ["anchor_one", "Anchor", "ferry", "pier"])
    contents = spark.createDataFrame([("f.rs", "a\nb")], "file_path string, content string")
    assert plan_query(nodes, contents, "x", file="f.rs").result.first()["text"] == "a\nb"
    assert plan_query(nodes, contents, "anchor").strategy == "graph_search"
    plan = plan_query(nodes, contents, "find the anchor ferry")
    assert plan.strategy == "keyword_fallback_graph_search" and sorted(r["name"] for r in plan.result.collect()) == ["Anchor", "anchor_one", "ferry"]
    assert keyword_search(nodes, "the of").count() == 0


def test_text_helpers(spark):
    rows = spark.createDataFrame([("a/b.tar.gz",), (".env",), ("Makefile",), ("x/.git/y",), (None,)], "p string")
    assert [r[0] for r in rows.select(X.path_extension(F.col("p"))).collect()] == ["gz", None, None, None, None]
    assert [r[0] for r in rows.select(X.is_noise(F.col("p"))).collect()][:4] == [False, False, False, True]
    one = spark.range(1)
    assert one.select(X.format_age(F.lit(7200)), X.format_size(F.lit(2048)), X.estimate_tokens(F.lit(40))).first()[:] == ("2h", "2.0 KB", 10)
