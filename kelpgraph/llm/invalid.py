"""Source files that are no valid text of their language.

Each stored version is lexed and parsed whole where it is read, by the tables
of its language's bundled grammar; only the verdict and the line of the first
error that no parse can get over are shuffled, to pick the current version.

Scale: the tables are built once on the driver and broadcast (their size is
that of the bundled grammars); workers keep what they have learnt of a language
from file to file, so that a token costs one look-up.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpgraph.llm.parsing.lexers import LEXERS, Lexer, build_tables
from kelpgraph.llm.parsing.tables import Tables
from kelpgraph.llm.sources import latest_of, source_versions

_READY: dict[str, Lexer] = {}


@lru_cache(maxsize=1)
def all_tables() -> dict[str, Tables]:
    """The tables of all languages; built once per process."""
    return build_tables()


def lexer_of(name: str, tables: dict[str, Tables]) -> Lexer:
    """The language's lexer and parser; one for each worker process."""
    if name not in _READY:
        _READY[name] = LEXERS[name](tables[name])
    return _READY[name]


def parsed_files(contents: DataFrame) -> DataFrame:
    """(project_id, file_path, language, error_token): current source files; error_token is -1 for valid ones.

    Every text is decided, however ambiguous its grammar is there. An empty or
    null content is an empty file, valid in languages that allow one. Markdown
    and unknown extensions are left out.
    """
    shared = contents.sparkSession.sparkContext.broadcast(all_tables())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column("content").to_pylist(), batch.column("language").to_pylist())
            errors = [lexer_of(name, shared.value).first_error(text) for text, name in pairs]
            names = [n for n in batch.schema.names if n != "content"]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(errors, pa.int32())], names=[*names, "error_token"])

    versions = source_versions(contents)
    kept = ", ".join(f"{n} {t}" for n, t in versions.dtypes if n != "content")
    return latest_of(versions.mapInArrow(run, f"{kept}, error_token int"), "language", "error_token")


def invalid_files(contents: DataFrame) -> DataFrame:
    """(project_id, file_path, language, error_token) of the files that a parser of their language must reject."""
    return parsed_files(contents).where("error_token >= 0")


def invalid_rates(contents: DataFrame, runs: DataFrame) -> DataFrame:
    """A row for each project and language: files, invalid and undecided files, the rate of invalid ones, and what the project's runs report.

    ``files_reported`` is the sum of files_indexed over the project's distinct
    runs that have finished, ``files_stored`` the distinct files of these runs in
    file_contents; runs without a count add nothing. ``undecided`` is 0, as every
    file is decided.
    """
    rates = parsed_files(contents).groupBy("project_id", "language").agg(F.count("*").alias("files"), F.sum((F.col("error_token") >= 0).cast("long")).alias("invalid"), F.sum((F.col("error_token") == -2).cast("long")).alias("undecided"))
    reported = runs.where("files_indexed is not null and project_id is not null").groupBy("project_id", "run_id").agg(F.max("files_indexed").alias("n")).groupBy("project_id").agg(F.sum("n").alias("files_reported"))
    known = runs.where("files_indexed is not null").select("run_id").distinct()
    stored = contents.where("project_id is not null and file_path is not null").join(known, "run_id").select("project_id", "run_id", "file_path").distinct().groupBy("project_id").agg(F.count("*").alias("files_stored"))
    out = rates.join(reported, "project_id", "left").join(stored, "project_id", "left")
    return out.withColumn("rate", F.round(F.col("invalid") / F.col("files"), 6))
