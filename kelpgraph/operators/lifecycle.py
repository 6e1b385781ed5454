"""The life of a registered project: queried, refreshed, rebuilt, watched, evicted; answers kept while its index stands."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpgraph.operators.registry import is_warm

COOLDOWN, EVICTION_COOLDOWN = 180, 300


def touch_queried(projects: DataFrame, touches: DataFrame) -> DataFrame:
    """``projects`` with ``last_queried_unix`` moved up by the latest touch (hash, at); unknown hashes are ignored."""
    last = touches.groupBy("hash").agg(F.max("at").alias("_at"))
    moved = projects.join(last, "hash", "left").withColumn("last_queried_unix", F.greatest("last_queried_unix", "_at"))
    return moved.select(*projects.columns)


def cold_projects(projects: DataFrame, asked: DataFrame, now: Column, window: int) -> DataFrame:
    """Of the asked hashes the registered ones that are not warm; an unregistered project is not cold."""
    return projects.where(~is_warm(F.col("last_queried_unix"), now, window)).join(asked.select("hash"), "hash", "left_semi")


def touch_and_refresh(projects: DataFrame, asked: DataFrame, now: int, window: int, rebuild: Callable[[list[str]], None]) -> DataFrame:
    """Reads that find a project cold have it rebuilt, then all asked projects are marked as queried now.

    ``rebuild`` gets the cold hashes, which are bounded by the asked ones; it
    is called at most once and not at all if all are warm.
    """
    cold = sorted(r["hash"] for r in cold_projects(projects, asked, F.lit(now), window).select("hash").distinct().collect())
    if cold:
        rebuild(cold)
    return touch_queried(projects, asked.select("hash").distinct().withColumn("at", F.lit(now)))


def record_rebuilds(projects: DataFrame, runs: DataFrame) -> DataFrame:
    """``projects`` with automatic rebuilds added: (hash, ok, millis, at) counts and sums successes, counts failures, keeps the last."""
    ok = F.coalesce(F.col("ok"), F.lit(False))
    sums = runs.groupBy("hash").agg(F.sum(ok.cast("long")).alias("_ok"), F.sum((~ok).cast("long")).alias("_bad"), F.sum(F.when(ok, F.col("millis")).otherwise(0)).alias("_ms"))
    plus = lambda name, more: (F.coalesce(F.col(name), F.lit(0)) + F.coalesce(F.col(more), F.lit(0))).alias(name)
    changed = {"auto_reindex_count": "_ok", "auto_reindex_fail_count": "_bad", "auto_reindex_total_ms": "_ms"}
    both = projects.join(sums, "hash", "left")
    return both.select(*[plus(c, changed[c]) if c in changed else F.col(c) for c in projects.columns])


def last_queried(watched: DataFrame, projects: DataFrame) -> DataFrame:
    """The watch set (path, ...) with the registry's ``last_queried``; 0 for what is not registered."""
    known = projects.groupBy(F.col("root_path").alias("path")).agg(F.max("last_queried_unix").alias("_q"))
    return watched.join(known, "path", "left").withColumn("last_queried", F.coalesce("_q", F.lit(0))).drop("_q")


def least_recent(watched: DataFrame) -> DataFrame:
    """The one watched row that was queried longest ago, ties by path; none of none."""
    return watched.orderBy("last_queried", "path").limit(1)


def evict(watched: DataFrame, cooling: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """The watch set without its least recent path, and the cooling paths (path, until) with it."""
    gone = least_recent(watched).select("path")
    rest = watched.join(gone, "path", "left_anti")
    return rest, cooling.select("path", "until").unionByName(gone.withColumn("until", now + EVICTION_COOLDOWN))


def still_cooling(cooling: DataFrame, now: Column) -> DataFrame:
    """(path): evicted paths that are not yet let in again."""
    return cooling.groupBy("path").agg(F.max("until").alias("until")).where(F.col("until") > now).select("path")


def drained(messages: DataFrame, *keys: str) -> DataFrame:
    """(keys, messages, last_at): all queued messages folded into one set of dirty keys."""
    return messages.groupBy(*keys).agg(F.count("*").alias("messages"), F.max("at").alias("last_at"))


def cached_answers(requests: DataFrame, *keys: str) -> DataFrame:
    """``requests`` (keys, version, at) with ``hit``: an earlier request of the same keys saw the same version of the index.

    An answer is kept until the version changes, so a request hits if the one
    before it has its version.
    """
    order = Window.partitionBy(*keys).orderBy("at", "request")
    return requests.withColumn("hit", F.coalesce(F.lag("version").over(order).eqNullSafe(F.col("version")) & F.lag("request").over(order).isNotNull(), F.lit(False)))


def stored_bytes(contents: DataFrame, *keys: str) -> DataFrame:
    """(keys, files, bytes): what all stored versions take, by project."""
    return contents.groupBy(*keys).agg(F.count("*").alias("files"), F.sum(F.octet_length("content").cast("long")).alias("bytes"))


def status(projects: DataFrame, now: Column, window: int, budget: int) -> DataFrame:
    """One row: registered, indexed and warm projects, rebuilds, failures, and the watch budget."""
    indexed = F.coalesce(F.col("last_indexed_unix"), F.lit(0)) != 0
    return projects.agg(
        F.count("*").alias("projects"), F.count_if(indexed).alias("indexed"), F.count_if(is_warm(F.col("last_queried_unix"), now, window)).alias("warm"),
        F.coalesce(F.sum("auto_reindex_count"), F.lit(0)).alias("rebuilds"), F.coalesce(F.sum("auto_reindex_fail_count"), F.lit(0)).alias("failures"),
    ).withColumn("budget", F.lit(budget))


def healed_roots(projects: DataFrame, now: Column, window: int) -> DataFrame:
    """``projects`` with the root paths of warm rows in their plain form: no empty or ``.`` parts, no slash at the end."""
    parts = F.filter(F.split("root_path", "/"), lambda p: (p != "") & (p != "."))
    plain = F.concat(F.when(F.startswith("root_path", F.lit("/")), F.lit("/")).otherwise(F.lit("")), F.array_join(parts, "/"))
    return projects.withColumn("root_path", F.when(is_warm(F.col("last_queried_unix"), now, window), plain).otherwise(F.col("root_path")))
