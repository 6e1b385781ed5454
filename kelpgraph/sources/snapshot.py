"""Versioned stores, export and import, and note files."""

from __future__ import annotations

import json
import os
import shutil
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kelpgraph.sources.scan import NotIndexed

POINTER = "CURRENT"
MOST_BYTES = 2 << 30


def write_version(tables: dict[str, DataFrame], store: str, *, keep: int = 2) -> int:
    """Writes all tables as a new version, then moves the pointer in one step; readers see the old or the new one.

    ``store`` is a folder that all executors share. Older versions but for
    ``keep`` are removed.
    """
    os.makedirs(store, mode=0o700, exist_ok=True)
    version = max([0, *(int(x[1:]) for x in os.listdir(store) if x.startswith("v") and x[1:].isdigit())]) + 1
    for name, frame in tables.items():
        frame.write.mode("overwrite").option("compression", "zstd").parquet(os.path.join(store, f"v{version}", name))
    part = os.path.join(store, POINTER + ".part")
    with open(part, "w", encoding="utf-8") as file:
        file.write(str(version))
    os.replace(part, os.path.join(store, POINTER))
    for old in range(1, version - keep + 1):
        shutil.rmtree(os.path.join(store, f"v{old}"), ignore_errors=True)
    return version


def current_version(store: str) -> int:
    try:
        with open(os.path.join(store, POINTER), encoding="utf-8") as file:
            return int(file.read())
    except (OSError, ValueError) as error:
        raise NotIndexed(f"no index found in {store}; index the project first") from error


def read_version(spark: SparkSession, store: str) -> dict[str, DataFrame]:
    """The tables of the current version."""
    folder = os.path.join(store, f"v{current_version(store)}")
    return {name: spark.read.parquet(os.path.join(folder, name)) for name in sorted(os.listdir(folder))}


def export_store(tables: dict[str, DataFrame], target: str) -> dict[str, int]:
    """Writes zstd parquet and a manifest of row counts."""
    counts = {}
    for name, frame in tables.items():
        frame.write.mode("overwrite").option("compression", "zstd").parquet(os.path.join(target, name))
        counts[name] = frame.sparkSession.read.parquet(os.path.join(target, name)).count()
    with open(os.path.join(target, "manifest.json"), "w", encoding="utf-8") as file:
        json.dump(counts, file, sort_keys=True)
    return counts


def import_store(spark: SparkSession, source: str, *, most_bytes: int = MOST_BYTES) -> dict[str, DataFrame]:
    """The tables of an export; refused above ``most_bytes`` on disk, and if the counts differ from the manifest's."""
    size = sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(source) for f in files)
    if size > most_bytes:
        raise ValueError(f"the export has {size} bytes, more than {most_bytes}")
    with open(os.path.join(source, "manifest.json"), encoding="utf-8") as file:
        counts = json.load(file)
    tables = {name: spark.read.parquet(os.path.join(source, name)) for name in counts}
    for name, frame in tables.items():
        if frame.count() != counts[name]:
            raise ValueError(f"{name} has another number of rows than its manifest says")
    return tables


def delete_store(store: str) -> None:
    """Removes a project's store; its sources stay."""
    shutil.rmtree(store, ignore_errors=True)


def write_notes(notes: DataFrame, folder: str) -> int:
    """Writes (file_name, note) rows as files into a folder that all executors share; returns their number.

    Of several notes of one base name the first by its text keeps the name, the
    others get -2, -3 and so on before the extension; no note is lost.
    """
    os.makedirs(folder, exist_ok=True)
    base = F.element_at(F.split("file_name", "/"), -1)
    place = F.row_number().over(Window.partitionBy("_base").orderBy("file_name", "note"))
    named = notes.select(base.alias("_base"), "file_name", "note").withColumn("_place", place)
    unique = F.when(F.col("_place") == 1, F.col("_base")).otherwise(F.concat(F.regexp_replace("_base", r"\.[^.]*$", ""), F.lit("-"), F.col("_place").cast("string"), F.regexp_extract("_base", r"(\.[^.]*)$", 1)))
    notes = named.select(unique.alias("file_name"), "note")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, note in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                path = os.path.join(folder, os.path.basename(name))
                with open(path + ".part", "w", encoding="utf-8") as file:
                    file.write(note)
                os.replace(path + ".part", path)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    rows = notes.select("file_name", "note").mapInArrow(run, "n long").groupBy().sum("n").collect()
    return rows[0][0] or 0
