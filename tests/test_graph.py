import pytest

from kelpgraph.model import PropertyGraph
from kelpgraph.operators import graph as G
from kelpgraph.plans.pattern import PatternError, pattern_query

NODE = "id long, kind string, name string, qualified_name string, file_path string, start_line int, end_line int"


def graph_of(spark, functions, calls, extra_nodes=(), extra_edges=()):
    nodes = [(i, "Function", n, f"a.rs::{n}#1", "a.rs", 1, 2) for i, n in enumerate(functions, 1)] + list(extra_nodes)
    ids = {n: i for i, n in enumerate(functions, 1)}
    edges = [(ids[a], ids[b], "CALLS") for a, b in calls] + list(extra_edges)
    return PropertyGraph.of(spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, "src_id long, dst_id long, kind string"))


def names(frame):
    return sorted(r["name"] for r in frame.collect())


def test_trace_fans_out_and_returns_each_node_once(spark):
    g = graph_of(spark, ["open", "read", "parse", "trim", "count"], [("open", "read"), ("open", "parse"), ("parse", "trim"), ("read", "trim"), ("trim", "count"), ("parse", "count")])
    assert names(G.trace_calls(g, "open", depth=4)) == ["count", "parse", "read", "trim"]


def test_trace_inbound(spark):
    g = graph_of(spark, ["save", "sync", "main", "log"], [("save", "log"), ("sync", "save"), ("main", "sync")])
    assert names(G.trace_calls(g, "log", inbound=True, depth=2)) == ["save", "sync"]


def test_trace_depth_and_cycles(spark):
    g = graph_of(spark, ["a", "b", "c"], [("a", "b"), ("b", "c"), ("c", "a")])
    assert names(G.trace_calls(g, "a", depth=1)) == ["b"]
    assert names(G.trace_calls(g, "a", depth=9)) == ["b", "c"]
    assert names(G.trace_calls(g, "nobody", depth=2)) == []


def test_dead_functions_and_resolved_calls(spark):
    g = graph_of(spark, ["main", "helper", "lonely"], [("main", "helper")])
    assert names(G.dead_functions(g)) == ["lonely", "main"]
    g = graph_of(spark, ["main", "helper", "lonely"], [("main", "helper")], extra_edges=[(1, 3, "calls_resolved"), (1, 3, None), (None, 1, "CALLS")])
    assert names(G.dead_functions(g)) == ["main"]


def test_pattern_query(spark):
    g = graph_of(spark, ["x", "y"], [("x", "y"), ("x", "y")], extra_nodes=[(9, "File", "a.rs", "a.rs", "a.rs", 0, 0)], extra_edges=[(9, 1, "DEFINES"), (9, 2, "DEFINES")])
    assert names(pattern_query(g, "MATCH (a:Function)-[:CALLS]->(b:Function) RETURN a")) == ["x"]
    assert names(pattern_query(g, "match (f:file)-[:defines]->(g:function) where g.name = 'y' return f")) == ["a.rs"]
    assert names(pattern_query(g, "MATCH (a:File)-[:DEFINES]->(b:Function) RETURN b", limit=1)) == ["x"]
    assert names(pattern_query(g, "MATCH (a:File)-[:NOTHING]->(b:Function) RETURN b")) == []
    for bad in ("MATCH (a:Klass)-[:CALLS]->(b:Function) RETURN a", "MATCH (a:File)-[:CALLS]->(b:Function) RETURN c", "SELECT 1", "MATCH (a:File)-[:CALLS]->(b:Function) WHERE c.name='x' RETURN a"):
        with pytest.raises(PatternError):
            pattern_query(g, bad)


def test_same_variable_on_both_sides_means_the_left(spark):
    g = graph_of(spark, ["x", "y"], [("x", "y")])
    assert names(pattern_query(g, "MATCH (a:Function)-[:CALLS]->(a:Function) RETURN a")) == ["x"]


def test_overlap_touching_and_contained(spark):
    nodes = spark.createDataFrame([(1, "Function", "f", "f", "a", 5, 10), (2, "File", "a", "a", "a", 0, 0), (3, "Function", "g", "g", "a", 12, None)], NODE)
    hunks = spark.createDataFrame([("a", 10, 11), ("a", 6, 7), ("a", 12, 12), ("b", 5, 5)], "file_path string, start int, end int")
    assert sorted(r["id"] for r in G.nodes_overlapping(nodes, hunks).collect()) == [1, 1, 3]


def test_first_enclosing_takes_the_first_node(spark):
    nodes = spark.createDataFrame([(7, "Type", "T", "T", "a", 1, 20), (3, "Function", "f", "f", "a", 5, 10)], NODE)
    points = spark.createDataFrame([("a", 6), ("a", 15), ("a", 30)], "file_path string, line int")
    assert {(r["line"], r["node_id"]) for r in G.first_enclosing(nodes, points).collect()} == {(6, 3), (15, 7)}


def test_subgraph_counts_and_dot(spark):
    g = graph_of(spark, ["a", "b", 'c"q'], [("a", "b"), ("a", "b"), ("b", 'c"q')])
    ids = g.nodes.where("name in ('a', 'b')").select("id")
    assert [(r["src_id"], r["dst_id"]) for r in G.subgraph_edges(g, ids).collect()] == [(1, 2)]
    assert G.graph_stats(g).collect()[0].asDict() == {"nodes": 3, "edges": 3}
    text = G.call_graph_dot(g, "a")
    assert '\\"q' in text and "n1 -> n2;" in text


def test_busiest_files_and_extensions(spark):
    nodes = spark.createDataFrame([(i, "File", p, p, p, 0, 0) for i, p in enumerate(["a.tar.gz", ".env", "Makefile", "X.PY", "b.py"])] + [(10 + i, "Function", "f", f"q{i}", p, 1, 1) for i, p in enumerate(["b.py", "b.py", "X.PY", "Makefile"])], NODE)
    assert {(r["extension"], r["n"]) for r in G.extension_counts(nodes).collect()} == {("gz", 1), ("(no extension)", 2), ("PY", 1), ("py", 1)}
    assert [(r["file_path"], r["n"]) for r in G.busiest_files(nodes, limit=2).collect()] == [("b.py", 2), ("Makefile", 1)]


def test_notes_link_sorted_distinct_neighbours(spark):
    g = graph_of(spark, ["a", "b"], [("a", "b"), ("a", "b")])
    notes = {r["file_name"]: r["note"] for r in G.call_notes(g).collect()}
    assert set(notes) == {"a_rs__a_1.md", "a_rs__b_1.md"}
    assert notes["a_rs__a_1.md"].count("[[a_rs__b_1]]") == 1 and "## Called by" in notes["a_rs__b_1.md"]


def test_empty_graph(spark):
    g = PropertyGraph.of(spark.createDataFrame([], NODE), spark.createDataFrame([], "src_id long, dst_id long, kind string"))
    assert G.dead_functions(g).count() == 0 and G.trace_calls(g, "x").count() == 0 and G.neighbour_names(g).count() == 0
