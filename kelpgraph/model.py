"""Data model: schemas, vocabulary and the property graph."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NODE_KINDS = ("File", "Function", "Type", "Section")
EDGE_KINDS = ("DEFINES", "CONTAINS", "CALLS", "CALLS_RESOLVED")
CALL_KINDS = ("CALLS", "CALLS_RESOLVED")


def _struct(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(n, t, null) for n, t, null in fields])


_S, _L, _I = T.StringType(), T.LongType(), T.IntegerType()
NODES = _struct(("id", _L, False), ("kind", _S, False), ("name", _S, False), ("qualified_name", _S, False), ("file_path", _S, False), ("start_line", _I, False), ("end_line", _I, True))
EDGES = _struct(("src_id", _L, False), ("dst_id", _L, False), ("kind", _S, False))
CONTENTS = _struct(("file_path", _S, False), ("content", _S, False))
EMBEDDINGS = _struct(("node_id", _L, False), ("model", _S, False), ("dim", _I, False), ("chunk_text", _S, False), ("embedding", T.ArrayType(T.FloatType()), False))
PROJECTS = _struct(
    ("root_path", _S, False), ("hash", _S, False), ("last_indexed_unix", _L, True), ("nodes", _L, True), ("edges", _L, True), ("files_indexed", _L, True), ("last_queried_unix", _L, True),
    ("auto_reindex_count", _L, True), ("auto_reindex_fail_count", _L, True), ("auto_reindex_total_ms", _L, True), ("last_auto_reindex_ms", _L, True), ("last_auto_reindex_unix", _L, True),
)
USAGE = _struct(("bucket", _S, False), ("name", _S, False), ("call_count", _L, False), ("error_count", _L, False), ("total_latency_ms", _L, False), ("max_latency_ms", _L, False), ("total_output_bytes", _L, False), ("last_called_unix", _L, True))


def lenient_kind(kind):
    """A node kind as stored, anything unknown read as ``Type``."""
    return F.when(kind.isin(*NODE_KINDS), kind).otherwise(F.lit("Type"))


@dataclass(frozen=True)
class PropertyGraph:
    """Nodes (one row an id) and edges (a multiset of src_id, dst_id, kind)."""

    nodes: DataFrame
    edges: DataFrame

    @classmethod
    def of(cls, nodes: DataFrame, edges: DataFrame) -> PropertyGraph:
        """A graph from stored tables: repeated node rows count once, edge kinds are upper case, edges without a kind or an end leave."""
        tidy = edges.where("kind is not null and src_id is not null and dst_id is not null").withColumn("kind", F.upper(F.trim("kind")))
        return cls(nodes.where("id is not null").dropDuplicates(["id"]), tidy)

    def calls(self) -> DataFrame:
        """(src_id, dst_id) of all call edges, resolved ones too; parallel calls stay."""
        return self.edges.where(F.col("kind").isin(*CALL_KINDS)).select("src_id", "dst_id")
