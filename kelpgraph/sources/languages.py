"""Which files are indexed, and as what."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kelpgraph.functions.text import path_extension

# Indexed extensions, case-sensitive.
EXTENSIONS = {
    "rs": "Rust", "py": "Python", "js": "JavaScript", "jsx": "JavaScript", "mjs": "JavaScript", "cjs": "JavaScript", "ts": "TypeScript", "mts": "TypeScript", "cts": "TypeScript", "tsx": "Tsx",
    "go": "Go", "java": "Java", "c": "C", "h": "C", "cpp": "Cpp", "cc": "Cpp", "cxx": "Cpp", "hpp": "Cpp", "hh": "Cpp", "hxx": "Cpp", "cs": "CSharp", "rb": "Ruby", "php": "Php",
}
MARKDOWN = ("md", "markdown")
MINIFIED_LINE_BYTES = 2000


def language_of(path: Column) -> Column:
    """Language of a source path; null if it is not indexed as code."""
    names = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    return F.try_element_at(names, path_extension(path))


def is_markdown(path: Column) -> Column:
    return F.coalesce(path_extension(path).isin(*MARKDOWN), F.lit(False))


def is_indexed(path: Column) -> Column:
    return language_of(path).isNotNull() | is_markdown(path)
