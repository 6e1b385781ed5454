"""Answers to a caller: bounded lists with totals, cut texts, notes, JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpgraph.functions.text import byte_truncate
from kelpgraph.operators.registry import clamp_limit, clamp_semantic_limit

# The tools of each preset; a larger one has those of the smaller ones too.
MINIMAL = ("index_repository", "search_code", "get_file_context", "get_architecture", "trace_call_path")
STANDARD = (*MINIMAL, "search_graph", "detect_changes", "detect_dead_code", "query_planner", "get_session_usage")
FULL = (*STANDARD, "delete_project", "query_graph", "search_codebase", "query_memory")
PRESETS = {"minimal": MINIMAL, "standard": STANDARD, "full": FULL}


def bounded_answer(rows: DataFrame, order: list, *, limit: int = 100, cap=clamp_limit) -> DataFrame:
    """The first ``limit`` rows by ``order`` (at most the cap), with ``total`` of all rows and ``shown`` of those returned.

    The total is a partial sum beside the top rows; neither sorts the whole.
    """
    most = cap(limit)
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).limit(most).crossJoin(F.broadcast(total)).withColumn("shown", F.least("total", F.lit(most)))  # total is one row


def node_answer(nodes: DataFrame) -> DataFrame:
    """Nodes as a caller sees them: without ids, the path as ``file``."""
    return nodes.select("kind", "name", "qualified_name", F.col("file_path").alias("file"), "start_line", "end_line")


def hit_answer(hits: DataFrame, *, limit: int = 30) -> DataFrame:
    """Semantic hits by falling score: node columns, score, the text cut to 1,000 bytes and whether it was, total and shown."""
    cut = hits.withColumn("cut", byte_truncate(F.col("chunk_text")))
    seen = cut.select("id", "kind", "name", "qualified_name", F.col("file_path").alias("file"), "start_line", "end_line", "score", F.col("cut.text").alias("chunk_text"), F.col("cut.truncated").alias("chunk_truncated"))
    return bounded_answer(seen, [F.desc("score"), "id"], limit=limit, cap=clamp_semantic_limit)


def as_json(rows: DataFrame) -> DataFrame:
    """(json): each row as one text with sorted keys; nulls are kept."""
    return rows.select(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}).alias("json"))


def window_note(windows: DataFrame) -> DataFrame:
    """``windows`` of ``line_window`` with a note on what was left out; null where all is there."""
    note = F.format_string("... lines %d-%d of %d shown, ask for a range to see more", F.col("first_line"), F.col("last_line"), F.col("total"))
    return windows.withColumn("note", F.when(F.col("truncated"), note))


def freshness_note(since: Column, warm: Column) -> Column:
    """A note for an answer from a stale index; null for a warm one."""
    return F.when(~warm, F.when(since.isNull(), F.lit("not indexed yet")).otherwise(F.concat(F.lit("index is "), F.floor(since / 60).cast("string"), F.lit(" minutes old"))))


def resolved_tools(preset: str = "standard", explicit: list[str] | None = None) -> list[str]:
    """The tools that are on. A list that is given, even an empty one, goes before the preset; unknown names in it are dropped."""
    if explicit is None:
        return list(PRESETS[preset])
    return [name for name in FULL if name in set(explicit)]


def enabled_definitions(catalog: DataFrame, names: list[str]) -> DataFrame:
    """The rows of a catalog (name, ...) whose tools are on."""
    return catalog.where(F.col("name").isin(*names)) if names else catalog.limit(0)


def session_usage(calls: DataFrame, *keys: str) -> DataFrame:
    """(keys, calls, errors, bytes, share): counters of one session by tool, most bytes first; share of all bytes of the session."""
    rows = calls.groupBy(*keys).agg(F.count("*").alias("calls"), F.sum(F.col("error").cast("long")).alias("errors"), F.sum("bytes").alias("bytes"))
    total = F.sum("bytes").over(Window.partitionBy())  # a row a tool
    return rows.withColumn("share", F.when(total > 0, F.col("bytes") / total).otherwise(0.0)).orderBy(F.desc("bytes"), *keys)


def session_totals(usage: DataFrame, schema_bytes: int = 0) -> DataFrame:
    """One row: calls, errors, bytes, and tokens of the answers and of the tools' descriptions."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("calls", "errors", "bytes")]
    return usage.agg(*sums).withColumns({"tokens": F.floor(F.col("bytes") / 4).cast("long"), "schema_tokens": F.lit(schema_bytes // 4)})
