"""Current file contents and what a path says about a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Extension to language; fixed by the tables' notes.
LANGUAGE_OF = {
    "py": "python", "js": "module", "mjs": "module", "cjs": "script", "ts": "typescript", "go": "go", "rs": "rust",
    "java": "java", "rb": "ruby", "cs": "csharp", "php": "php", "c": "c", "h": "c",
}


ORDER = ("indexed_at", "run_id", "version")


def file_versions(contents: DataFrame) -> DataFrame:
    """(project_id, file_path, indexed_at, run_id, version, content) of all rows that name a file.

    A null content is empty; rows with a null project or path leave. ``version``
    is a hash of the content, which decides between rows of equal time and run.
    """
    rows = contents.where("project_id is not null and file_path is not null")
    text = F.coalesce("content", F.lit(""))
    return rows.select("project_id", "file_path", "indexed_at", "run_id", F.xxhash64(text).alias("version"), text.alias("content"))


def latest_of(versions: DataFrame, *columns: str) -> DataFrame:
    """(project_id, file_path, *columns) of the version with the latest ``indexed_at`` of each file."""
    last = F.max_by(F.struct(*columns), F.struct(*ORDER)).alias("last")
    return versions.groupBy("project_id", "file_path").agg(last).select("project_id", "file_path", *[F.col(f"last.{c}").alias(c) for c in columns])


def current_files(contents: DataFrame) -> DataFrame:
    """(project_id, file_path, content): the row with the latest ``indexed_at`` of each file."""
    return latest_of(file_versions(contents), "content")


def extension(path: Column) -> Column:
    """The part after the last dot of the file name; empty if there is none."""
    return F.regexp_extract(path, r"[^/.][^/]*\.([^./]+)$", 1)


def language(path: Column) -> Column:
    """Language of a source file by its extension; null for anything else."""
    names = F.create_map(*[F.lit(x) for pair in LANGUAGE_OF.items() for x in pair])
    return F.try_element_at(names, extension(path))


def source_versions(contents: DataFrame) -> DataFrame:
    """All stored versions of source files, with their language; markdown and other files are left out."""
    rows = file_versions(contents.where(language(F.col("file_path")).isNotNull()))
    return rows.withColumn("language", language(F.col("file_path")))


def source_files(contents: DataFrame) -> DataFrame:
    """(project_id, file_path, content, language) of the current source files."""
    return latest_of(source_versions(contents), "content", "language")
