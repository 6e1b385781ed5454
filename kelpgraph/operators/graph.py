"""Structural operators over a property graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpgraph.functions.text import dot_escape, fence_language, path_extension, wikilink_name
from kelpgraph.model import PropertyGraph
from kelpgraph.session import cut_lineage

NODE_COLUMNS = ("id", "kind", "name", "qualified_name", "file_path", "start_line", "end_line")


def match_pattern(graph: PropertyGraph, kind_a: str, edge_kind: str, kind_b: str, *, name_a: str | None = None, name_b: str | None = None, returns: str = "a", limit: int | None = None) -> DataFrame:
    """Distinct nodes on side ``returns`` of ``(a:kind_a)-[:edge_kind]->(b:kind_b)``, at most ``limit`` by id."""
    a = graph.nodes.where(F.col("kind") == kind_a)
    b = graph.nodes.where(F.col("kind") == kind_b)
    a = a.where(F.col("name") == name_a) if name_a is not None else a
    b = b.where(F.col("name") == name_b) if name_b is not None else b
    edges = graph.edges.where(F.col("kind") == edge_kind).select("src_id", "dst_id").distinct()
    kept, other, near, far = (a, b, "src_id", "dst_id") if returns == "a" else (b, a, "dst_id", "src_id")
    # the far side only has to exist, and the near side is wanted once: two semi joins, no node is carried along an edge
    ends = edges.join(other.select(F.col("id").alias(far)), far, "left_semi").select(F.col(near).alias("id"))
    found = kept.join(ends, "id", "left_semi").select(*NODE_COLUMNS)
    return found.orderBy("id").limit(limit) if limit is not None else found


def trace_calls(graph: PropertyGraph, name: str, *, inbound: bool = False, depth: int = 3) -> DataFrame:
    """(node columns, depth) reached from all functions named ``name`` over call edges, each once, starts left out.

    One join a level; levels are deduplicated before they meet the visited set
    and cut from their lineage by a checkpoint. The hops are laid down once, by
    their near end, so that a level does not read the edges again. Ends when a
    level adds nothing.
    """
    near, far = ("dst_id", "src_id") if inbound else ("src_id", "dst_id")
    hops = graph.calls().select(F.col(near).alias("id"), F.col(far).alias("next")).distinct().repartition("id")
    hops = cut_lineage(hops) if depth > 1 else hops
    frontier = graph.nodes.where((F.col("kind") == "Function") & (F.col("name") == name)).select("id")
    visited = frontier.withColumn("depth", F.lit(0))
    for level in range(1, depth + 1):
        reached = frontier.join(hops, "id").select(F.col("next").alias("id")).distinct()
        frontier = cut_lineage(reached.join(visited, "id", "left_anti"))
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier.withColumn("depth", F.lit(level)))
    return graph.nodes.join(visited.where("depth > 0"), "id").select(*NODE_COLUMNS, "depth")


def dead_functions(graph: PropertyGraph) -> DataFrame:
    """Functions that no call edge reaches."""
    called = graph.calls().select(F.col("dst_id").alias("id"))
    return graph.nodes.where("kind = 'Function'").join(called, "id", "left_anti").select(*NODE_COLUMNS)


#: Lines of a bin: ranges and points meet only inside the bins that they touch.
BIN_LINES = 64


def _bins(start: Column, end: Column) -> Column:
    low, high = (F.floor(F.greatest(x, F.lit(0)) / BIN_LINES).cast("int") for x in (start, end))
    return F.explode(F.sequence(low, F.greatest(low, high)))


def nodes_overlapping(nodes: DataFrame, hunks: DataFrame, *keys: str) -> DataFrame:
    """Non-file nodes whose lines meet a hunk (start, end) of the same ``keys``; once for each hunk they meet.

    An open end_line means the start line. Both sides are laid out over bins of
    ``BIN_LINES`` lines, so that a long file is no product of its nodes and
    hunks; a pair counts in the first bin that both touch.
    """
    keys = keys or ("file_path",)
    last = F.coalesce("end_line", "start_line")
    h = hunks.select(*keys, "start", "end").where(F.col("start") <= F.col("end")).withColumn("_bin", _bins(F.col("start"), F.col("end")))
    n = nodes.where("kind <> 'File'").withColumn("_bin", _bins(F.col("start_line"), last))
    joined = n.join(h, [*keys, "_bin"]).where((F.col("start_line") <= F.col("end")) & (last >= F.col("start")))
    first = F.floor(F.greatest(F.greatest("start_line", "start"), F.lit(0)) / BIN_LINES).cast("int")
    return joined.where(F.col("_bin") == first).drop("_bin")


def first_enclosing(nodes: DataFrame, points: DataFrame, *keys: str) -> DataFrame:
    """For each point (keys, line) the enclosing node that comes first by id: (keys, line, node_id). A point meets the nodes of its bin of lines."""
    keys = keys or ("file_path",)
    last = F.coalesce("end_line", "start_line")
    binned = nodes.select(*keys, "id", "start_line", last.alias("last")).where(F.col("start_line") <= F.col("last")).withColumn("_bin", _bins(F.col("start_line"), F.col("last")))
    asked = points.select(*keys, "line").distinct().withColumn("_bin", F.floor(F.greatest("line", F.lit(0)) / BIN_LINES).cast("int"))
    inside = asked.join(binned, [*keys, "_bin"]).where((F.col("start_line") <= F.col("line")) & (F.col("line") <= F.col("last")))
    return inside.groupBy(*keys, "line").agg(F.min("id").alias("node_id"))


def subgraph_edges(graph: PropertyGraph, ids: DataFrame) -> DataFrame:
    """Distinct call edges with both ends among ``ids`` (id)."""
    return graph.calls().distinct().join(ids.select(F.col("id").alias("src_id")), "src_id", "left_semi").join(ids.select(F.col("id").alias("dst_id")), "dst_id", "left_semi").select("src_id", "dst_id")


def busiest_files(nodes: DataFrame, *keys: str, limit: int | None = 10) -> DataFrame:
    """Files by number of other nodes in them, most first, ties by path."""
    keys = keys or ("file_path",)
    counts = nodes.where("kind <> 'File'").groupBy(*keys).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), *keys).limit(limit) if limit is not None else counts


def extension_counts(nodes: DataFrame) -> DataFrame:
    """File nodes by extension, ``(no extension)`` where there is none."""
    ext = F.coalesce(path_extension(F.col("file_path")), F.lit("(no extension)"))
    return nodes.where("kind = 'File'").groupBy(ext.alias("extension")).agg(F.count("*").alias("n"))


def graph_stats(graph: PropertyGraph) -> DataFrame:
    """One row: number of nodes and of edges."""
    return graph.nodes.agg(F.count("*").alias("nodes")).crossJoin(graph.edges.agg(F.count("*").alias("edges")))  # one row each


def architecture(nodes: DataFrame, edges: DataFrame, *, top: int = 10) -> DataFrame:
    """(project_id, part, label, n): counts of nodes and edges, the busiest files and the extensions of every project.

    The nodes are counted once by file; all parts but the edges come of these counts.
    """
    is_file = F.col("kind") == "File"
    per_file = nodes.groupBy("project_id", "file_path").agg(F.count("*").alias("all"), F.count_if(is_file).alias("files"), F.count_if(~is_file).alias("n"))
    ext = F.coalesce(path_extension(F.col("file_path")), F.lit("(no extension)"))
    entry = lambda part, label, n: F.struct(F.lit(part).alias("part"), label.alias("label"), n.alias("n"))
    counted = per_file.select("project_id", F.explode(F.array(entry("total", F.lit("nodes"), F.col("all")), entry("extension", ext, F.col("files")))).alias("e")).select("project_id", "e.*")
    sums = counted.groupBy("project_id", "part", "label").agg(F.sum("n").alias("n")).where(F.col("n") > 0)
    links = edges.groupBy("project_id").agg(F.count("*").alias("n")).select("project_id", F.lit("total").alias("part"), F.lit("edges").alias("label"), "n")
    order = Window.partitionBy("project_id").orderBy(F.desc("n"), "file_path")
    busy = per_file.where("n > 0").withColumn("r", F.row_number().over(order)).where(F.col("r") <= top)
    return sums.unionByName(links).unionByName(busy.select("project_id", F.lit("busiest").alias("part"), F.col("file_path").alias("label"), "n"))


def neighbour_names(graph: PropertyGraph) -> DataFrame:
    """(id, callees, callers): sorted distinct qualified names of the nodes each node calls and is called by."""
    names = graph.nodes.select("id", "qualified_name")
    pairs = graph.calls().distinct()
    out = pairs.join(names.withColumnsRenamed({"id": "dst_id", "qualified_name": "q"}), "dst_id").groupBy(F.col("src_id").alias("id")).agg(F.array_sort(F.collect_set("q")).alias("callees"))
    into = pairs.join(names.withColumnsRenamed({"id": "src_id", "qualified_name": "q"}), "src_id").groupBy(F.col("dst_id").alias("id")).agg(F.array_sort(F.collect_set("q")).alias("callers"))
    none = F.array().cast("array<string>")
    full = graph.nodes.select("id").join(out, "id", "left").join(into, "id", "left")
    return full.select("id", F.coalesce("callees", none).alias("callees"), F.coalesce("callers", none).alias("callers"))


def call_notes(graph: PropertyGraph, chunks: DataFrame | None = None) -> DataFrame:
    """(id, file_name, note): a markdown note for each node that is no file, with links to callees and callers.

    ``chunks`` (id, chunk_text) adds the source text in a fence.
    """
    nodes = graph.nodes.where("kind <> 'File'").join(neighbour_names(graph), "id")
    nodes = nodes.join(chunks.select("id", "chunk_text"), "id", "left") if chunks is not None else nodes.withColumn("chunk_text", F.lit(None).cast("string"))

    def links(title: str, names: str) -> Column:
        rows = F.transform(F.col(names), lambda q: F.concat(F.lit("- [["), wikilink_name(q), F.lit("]]")))
        return F.when(F.size(names) > 0, F.concat(F.lit(f"\n## {title}\n\n"), F.array_join(rows, "\n"), F.lit("\n"))).otherwise(F.lit(""))

    last = F.coalesce(F.col("end_line"), F.col("start_line"))
    header = F.concat(F.lit("# "), "name", F.lit("\n\n"), F.col("kind"), F.lit(" in `"), F.col("file_path"), F.lit("`, lines "), F.col("start_line").cast("string"), F.lit("-"), last.cast("string"), F.lit("\n"))
    body = F.when(F.col("chunk_text").isNotNull(), F.concat(F.lit("\n```"), fence_language(F.col("kind"), F.col("file_path")), F.lit("\n"), F.col("chunk_text"), F.lit("\n```\n"))).otherwise(F.lit(""))
    return nodes.select("id", F.concat(wikilink_name(F.col("qualified_name")), F.lit(".md")).alias("file_name"), F.concat(header, body, links("Calls", "callees"), links("Called by", "callers")).alias("note"))


def call_dot_lines(graph: PropertyGraph, name: str, *, depth: int = 2) -> DataFrame:
    """(part, src_id, dst_id, line): the DOT lines of the nodes (part 0) and calls (part 1) among the neighbours of the functions named ``name``."""
    starts = graph.nodes.where((F.col("kind") == "Function") & (F.col("name") == name)).select(*NODE_COLUMNS)
    around = trace_calls(graph, name, depth=depth).drop("depth").unionByName(trace_calls(graph, name, inbound=True, depth=depth).drop("depth")).unionByName(starts).dropDuplicates(["id"])
    nodes = around.select(F.lit(0).alias("part"), F.col("id").alias("src_id"), F.lit(None).cast("long").alias("dst_id"), F.format_string('  n%d [label="%s"];', F.col("id"), dot_escape(F.col("name"))).alias("line"))
    calls = subgraph_edges(graph, around).select(F.lit(1).alias("part"), "src_id", "dst_id", F.format_string("  n%d -> n%d;", "src_id", "dst_id").alias("line"))
    return nodes.unionByName(calls)


def call_graph_dot(graph: PropertyGraph, name: str, *, depth: int = 2, most: int = 10_000) -> str:
    """DOT text of the calls among the neighbours of the functions named ``name``; an error above ``most`` lines, which are for ``call_dot_lines``."""
    lines = call_dot_lines(graph, name, depth=depth).orderBy("part", "src_id", "dst_id").select("line").limit(most + 1).collect()
    if len(lines) > most:
        raise ValueError(f"the neighbourhood has more than {most} nodes and calls")
    return "\n".join(["digraph calls {", "  rankdir=LR;", *[r[0] for r in lines], "}"]) + "\n"
