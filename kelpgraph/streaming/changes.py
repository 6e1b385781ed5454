"""Change streams: debounced bursts, cooldowns and a gate on content signatures."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpgraph.session import ensure_checkpoint_dir

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_available(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there and returns what it gave out, written below the shared checkpoint folder.

    ``complete`` keeps the last state of the result; ``append`` all rows given out.
    """
    folder = f"{ensure_checkpoint_dir(stream.sparkSession)}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    if mode == "complete":
        query = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{folder}/rows")).start()
    else:
        query = writer.format("parquet").start(f"{folder}/rows")
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")


def debounced(events: DataFrame, keys: list[str], at: str, gap: str = "2 seconds", late: str = "10 seconds") -> DataFrame:
    """Bursts of a stream as session windows: (keys, first_at, until, events), given out once the watermark passes them."""
    sessions = events.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), *keys).agg(F.count("*").alias("events"))
    return sessions.select(*keys, F.col("w.start").alias("first_at"), F.col("w.end").alias("until"), "events")


def counted_windows(events: DataFrame, keys: list[str], at: str, width: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Events by tumbling or sliding window."""
    window = F.window(at, width, slide) if slide else F.window(at, width)
    return events.withWatermark(at, late).groupBy(window.alias("w"), *keys).agg(F.count("*").alias("events")).select(F.col("w.start").alias("begin"), F.col("w.end").alias("until"), *keys, "events")


def gated_changes(events: DataFrame, seconds: int = 180, late: str = "10 seconds", forget: int = 86_400) -> DataFrame:
    """Of a stream (path, at, signature): changes whose path is not cooling down and whose signature is new.

    A change passes if its signature differs from that of the last one that
    passed and that one is at least ``seconds`` ago. State is one row a path and
    is dropped after ``forget`` seconds of event time without events.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, signature = state.get if state.exists else (None, None)
        out = []
        rows = pd.concat(list(parts)).sort_values(["at", "signature"])
        for at, mark in zip(rows["at"], rows["signature"]):
            second = int(at.timestamp())
            if last is None or (second - last >= seconds and mark != signature):
                out.append((key[0], at, mark))
                last, signature = second, mark
        state.update((last, signature))
        state.setTimeoutTimestamp(max(int(rows["at"].max().timestamp()), state.getCurrentWatermarkMs() // 1000) * 1000 + forget * 1000)
        yield pd.DataFrame(out, columns=["path", "at", "signature"])

    stamped = events.select("path", "at", "signature").withWatermark("at", late)
    return stamped.groupBy("path").applyInPandasWithState(run, "path string, at timestamp, signature long", "last long, signature long", "append", "EventTimeTimeout")
