"""Projects, usage counters, freshness, admission and change gates, on tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WARM_SECONDS = 21_600
# Tools whose answers stand for reading files.
READS_AVOIDED = ("get_file_context", "trace_call_path", "search_graph", "get_architecture", "detect_changes", "query_planner")


def usage_stats(calls: DataFrame, *keys: str) -> DataFrame:
    """Counters of calls (keys, error, latency, bytes, at): count, errors, sum and maximum of latency, bytes, last time, mean."""
    stats = calls.groupBy(*keys).agg(
        F.count("*").alias("call_count"), F.sum(F.col("error").cast("long")).alias("error_count"), F.sum("latency").alias("total_latency"), F.max("latency").alias("max_latency"),
        F.sum("bytes").alias("total_output_bytes"), F.max("at").alias("last_called"),
    )
    return stats.withColumn("avg_latency", mean(F.col("total_latency"), F.col("call_count")))


def mean(total: Column, count: Column) -> Column:
    """0 where nothing was counted."""
    return F.when(count == 0, F.lit(0.0)).otherwise(total / count)


def reads_avoided(stats: DataFrame, name: str = "name", tools: tuple[str, ...] = READS_AVOIDED) -> DataFrame:
    """One row over the tools that save reads: calls without errors, all bytes, tokens these stand for."""
    sums = stats.where(F.col(name).isin(*tools)).agg(F.coalesce(F.sum(F.col("call_count") - F.col("error_count")), F.lit(0)).alias("reads"), F.coalesce(F.sum("total_output_bytes"), F.lit(0)).alias("bytes"))
    return sums.withColumn("tokens", F.floor(F.col("bytes") / 4).cast("long"))


def is_warm(last_queried: Column, now: Column, window: int = WARM_SECONDS) -> Column:
    """Queried at all and at most ``window`` seconds ago."""
    last = F.coalesce(last_queried, F.lit(0))
    return (last != 0) & (F.greatest(now - last, F.lit(0)) <= window)


def freshness(projects: DataFrame, now: Column, window: int = WARM_SECONDS) -> DataFrame:
    """``projects`` with indexed, seconds_since_indexed and warm."""
    known = F.col("last_indexed_unix").isNotNull() & (F.col("last_indexed_unix") != 0)
    since = F.when(known, F.greatest(now - F.col("last_indexed_unix"), F.lit(0)))
    return projects.withColumns({"indexed": known, "seconds_since_indexed": since, "warm": is_warm(F.col("last_queried_unix"), now, window)})


def latest_projects(projects: DataFrame) -> DataFrame:
    """One row for each hash: the one indexed last, then queried last. Rows without a hash leave."""
    rest = [c for c in projects.columns if c != "hash"]
    order = F.struct(F.coalesce("last_indexed_unix", F.lit(0)), F.coalesce("last_queried_unix", F.lit(0)), "root_path")
    return projects.where("hash is not null").groupBy("hash").agg(F.max_by(F.struct(*rest), order).alias("p")).select("hash", "p.*")


def plan_admission(watched: DataFrame, estimate: int, budget: int) -> DataFrame:
    """(path, weight, last_queried): what is evicted to admit ``estimate``, least recently queried first, ties by path.

    Nothing if it fits or is larger than the whole budget. The watch set is one
    machine's, so its running sum is one partition.
    """
    order = Window.partitionBy().orderBy("last_queried", "path").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("weight").over(Window.partitionBy())
    free = F.greatest(F.lit(budget) - (total - F.coalesce(F.sum("weight").over(order), F.lit(0))), F.lit(0))
    return watched.withColumn("free", free).where((F.col("free") < estimate) & F.lit(estimate <= budget)).drop("free")


def watch_changes(watched: DataFrame, current: DataFrame, cooling: DataFrame | None = None) -> DataFrame:
    """(path, action): watched paths to drop, and current ones to add that are not cooling down."""
    drop = watched.select("path").join(current.select("path"), "path", "left_anti").select("path", F.lit("drop").alias("action"))
    add = current.select("path").distinct().join(watched.select("path"), "path", "left_anti")
    add = add.join(cooling.select("path"), "path", "left_anti") if cooling is not None else add
    return drop.distinct().unionByName(add.select("path", F.lit("add").alias("action")))


def dirty_roots(paths: DataFrame, roots: DataFrame, *keys: str) -> DataFrame:
    """(keys, path, root): the longest root each path lies at or below; paths below none leave.

    Each path is turned into its ancestors and joined on them, which is an equi
    join in place of a comparison of every path with every root.
    """
    parts = F.split("path", "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    up = paths.select(*keys, "path", F.explode(ancestors).alias("root"))
    hits = up.join(roots.select(*keys, "root").distinct(), [*keys, "root"])
    return hits.groupBy(*keys, "path").agg(F.max_by("root", F.length("root")).alias("root"))


def debounce_sessions(events: DataFrame, keys: list[str], at: str, gap_seconds: float) -> DataFrame:
    """(keys, session, first_at, last_at, events): bursts whose gaps are shorter than ``gap_seconds``."""
    order = Window.partitionBy(*keys).orderBy(at)
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    gap = micros - F.lag(micros).over(order)
    marked = events.withColumn("_new", F.when(gap.isNull() | (gap >= int(gap_seconds * 1_000_000)), 1).otherwise(0))
    numbered = marked.withColumn("session", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "session").agg(F.min(at).alias("first_at"), F.max(at).alias("last_at"), F.count("*").alias("events"))


def cooldown_filter(events: DataFrame, keys: list[str], at: str, seconds: float) -> DataFrame:
    """The events that pass a cooldown: the first of each key, then each that comes ``seconds`` or more after the last that passed.

    Greedy, hence sequential within a key; rows are sorted by the shuffle and
    read as a stream of Arrow batches, so a key of any size takes constant memory.
    """
    import pyarrow as pa

    schema = events.schema
    column = events.columns.index(at)
    key_at = [events.columns.index(k) for k in keys]

    def run(batches):
        last_key, last = None, None
        for batch in batches:
            times = batch.column(column).cast(pa.int64()).to_pylist() if pa.types.is_timestamp(batch.schema.field(column).type) else batch.column(column).to_pylist()
            scale = 1e6 if pa.types.is_timestamp(batch.schema.field(column).type) else 1
            rows = list(zip(*(batch.column(i).to_pylist() for i in key_at)))
            keep = []
            for i, (key, time) in enumerate(zip(rows, times)):
                if time is None:
                    continue
                if key != last_key or last is None or time - last >= seconds * scale:
                    keep.append(i)
                    last_key, last = key, time
            yield batch.take(pa.array(keep, pa.int64()))

    return events.repartition(*keys).sortWithinPartitions(*keys, at).mapInArrow(run, schema)


def reindex_totals(projects: DataFrame) -> DataFrame:
    """Automatic rebuilds by project, those with any: ok, failed, total and mean milliseconds."""
    ok, failed, spent = (F.coalesce(c, F.lit(0)) for c in ("auto_reindex_count", "auto_reindex_fail_count", "auto_reindex_total_ms"))
    rows = projects.select("hash", ok.alias("ok"), failed.alias("failed"), spent.alias("total_ms")).where("ok + failed > 0")
    return rows.withColumn("avg_ms", mean(F.col("total_ms"), F.col("ok")))


def project_list(projects: DataFrame, nodes: DataFrame, edges: DataFrame, contents: DataFrame) -> DataFrame:
    """Registered projects with their live counts of nodes, edges and stored bytes."""
    n = nodes.groupBy(F.col("project_id").alias("hash")).agg(F.count("*").alias("nodes"))
    e = edges.groupBy(F.col("project_id").alias("hash")).agg(F.count("*").alias("edges"))
    b = contents.groupBy(F.col("project_id").alias("hash")).agg(F.sum(F.octet_length("content")).alias("bytes"))
    out = projects.select("hash", "root_path").join(n, "hash", "left").join(e, "hash", "left").join(b, "hash", "left")
    return out.na.fill(0, ["nodes", "edges", "bytes"])


def watch_budget(limit: int | None) -> int:
    """Half of the system's limit, at least 256; 8192 where it is unknown."""
    return max(int((limit if limit is not None else 8192) * 0.5), 256)


def clamp_limit(requested: int) -> int:
    return min(requested, 200)


def clamp_semantic_limit(requested: int) -> int:
    return min(requested, 30)
