"""Rule-based routing of a query to the operator that answers it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kelpgraph.functions.text import keyword_words, like_ascii
from kelpgraph.operators.files import line_window
from kelpgraph.operators.search import search_by_name

WORD_LIMIT, NAME_LIMIT = 10, 20


@dataclass
class Plan:
    """What was chosen, its result, and a note for the caller."""

    strategy: str
    result: DataFrame
    note: str | None = None


def keyword_search(nodes: DataFrame, query: str, *, per_word: int = WORD_LIMIT) -> DataFrame:
    """Nodes whose name holds a kept word of the query: the first ``per_word`` by name for each word, each node once where it comes first."""
    words = keyword_words(query)
    if not words:
        return nodes.limit(0).withColumns({"word_at": F.lit(0), "place": F.lit(0)})
    # a word is a pattern as in a search by name: _ stands for any character
    held = F.array_compact(F.array(*[F.when(like_ascii(F.col("name"), w), F.struct(F.lit(i).alias("word_at"))) for i, w in enumerate(words)]))
    hits = nodes.withColumn("w", F.explode(held))
    order = Window.partitionBy("w.word_at").orderBy("name", "id")
    ranked = hits.withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_word).withColumn("word_at", F.col("w.word_at")).drop("w")
    first = Window.partitionBy("qualified_name").orderBy("word_at", "place")
    return ranked.withColumn("r", F.row_number().over(first)).where("r = 1").drop("r")


def plan_query(nodes: DataFrame, contents: DataFrame, query: str, *, file: str | None = None, start: int | None = None, end: int | None = None, policy: str = "NotConfigured") -> Plan:
    """A given file is read; one identifier is searched by name; anything else word by word. Never routes to meaning."""
    if file is not None:
        return Plan("file_read", line_window(contents.where(F.col("file_path") == file), start=start, end=end))
    if query.isidentifier():
        return Plan("graph_search", search_by_name(nodes, query, limit=NAME_LIMIT))
    notes = {"NotConfigured": "embeddings are not configured", "Disabled": "embeddings are disabled", "RemoteBlocked": "the embedding endpoint is remote and not allowed", "Allowed": "search_codebase searches by meaning"}
    return Plan("keyword_fallback_graph_search", keyword_search(nodes, query), notes[policy])
