"""Text and path expressions; all but ``byte_truncate`` stay in the JVM."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CHUNK_CHARACTERS = 6000
RESULT_BYTES = 1000
# Words a keyword search leaves out.
STOPWORDS = ("the", "a", "an", "is", "are", "of", "to", "in", "for", "and", "or", "find", "get", "where", "how", "what", "does", "do")
# Fence language of a path's extension.
FENCES = {"rs": "rust", "py": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "mts": "typescript", "cts": "typescript", "tsx": "tsx", "go": "go", "java": "java", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "hh": "cpp", "hxx": "cpp", "cs": "csharp", "rb": "ruby", "php": "php"}


def ascii_lower(text: Column) -> Column:
    """Lower case of the ASCII letters only, as LIKE folds them."""
    return F.translate(text, UPPER, LOWER)


def like_ascii(text: Column, pattern: str) -> Column:
    """``text LIKE %pattern%``: ASCII letters match in any case; % and _ of the pattern are wildcards, nothing escapes."""
    return ascii_lower(text).like("%" + pattern.translate(str.maketrans(UPPER, LOWER)).replace("\\", "\\\\") + "%")


@lru_cache(maxsize=1)
def _accents() -> tuple[str, str]:
    """Accented letters of the Latin, Greek and Cyrillic blocks and their base letters, by canonical decomposition."""
    pairs = []
    for code in (*range(0xC0, 0x530), *range(0x1E00, 0x2000)):
        base = unicodedata.normalize("NFD", chr(code))
        kept = "".join(c for c in base if not unicodedata.combining(c))
        if len(kept) == 1 and kept != chr(code):
            pairs.append((chr(code), kept))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def folded_tokens(text: Column) -> Column:
    """Tokens joined and enclosed by one blank: case folded, accents off, cut at what is no letter or digit."""
    source, target = _accents()
    plain = F.translate(F.lower(text), source, target)
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(plain, r"[^\p{L}\p{N}]+", " ")), F.lit(" "))


def fold(text: str) -> str:
    """A Python text case folded and without accents, of the same length."""
    source, target = _accents()
    return text.lower().translate(str.maketrans(source, target))


def folded_phrase(query: str) -> str:
    """``folded_tokens`` of a query, on the driver; empty if it has no token."""
    plain = fold(query)
    return " ".join("".join(c if c.isalpha() or c.isnumeric() else " " for c in plain).split())


def chunk_truncate(text: Column, characters: int = CHUNK_CHARACTERS) -> Column:
    return F.substring(text, 1, characters)


def byte_truncate(text: Column, limit: int = RESULT_BYTES) -> Column:
    """(text, truncated): at most ``limit`` bytes of UTF-8, cut between characters. Nulls stay null."""
    kind = T.StructType([T.StructField("text", T.StringType()), T.StructField("truncated", T.BooleanType())])

    @F.pandas_udf(kind)
    def run(texts: pd.Series) -> pd.DataFrame:
        raw = [None if t is None else t.encode() for t in texts]
        return pd.DataFrame({"text": [None if b is None else b[:limit].decode(errors="ignore") for b in raw], "truncated": [None if b is None else len(b) > limit for b in raw]})

    return run(text)


def path_extension(path: Column) -> Column:
    """Text after the last dot of the file name; null for none and for dotfiles."""
    found = F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"^.+\.([^.]+)$", 1)
    return F.when(found != "", found)


def wikilink_name(name: Column) -> Column:
    """Every character that is no letter, digit, - or _ becomes _."""
    return F.regexp_replace(name, r"[^\p{L}\p{N}_-]", "_")


def dot_escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def is_identifier(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^[\p{L}_][\p{L}\p{N}_]*$"), F.lit(False))


def is_noise(path: Column) -> Column:
    """The path has a component that is build output or version control."""
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, (".git", "target", "node_modules", ".kelpgraph"))))


def longest_line(content: Column) -> Column:
    """Bytes of the longest line."""
    return F.array_max(F.transform(F.split(content, "\n"), F.octet_length))


def text_lines(content: Column) -> Column:
    """Lines without their ends; none after a last line end."""
    unix = F.replace(content, F.lit("\r\n"), F.lit("\n"))
    lines = F.split(unix, "\n", -1)
    return F.when(F.endswith(unix, F.lit("\n")) | (unix == ""), F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)


def keyword_words(query: str) -> list[str]:
    """Words of a query: outer marks off but for ``_``, below 3 bytes and stopwords left out."""
    out = []
    for word in query.split():
        bare = word.strip("".join({c for c in word if not c.isalnum() and c != "_"}))
        if len(bare.encode()) >= 3 and bare.lower() not in STOPWORDS:
            out.append(bare)
    return out


def project_hash(path: Column) -> Column:
    """16 hexadecimal digits that name a project's root path."""
    return F.lower(F.lpad(F.hex(F.xxhash64(path)), 16, "0"))


def estimate_tokens(size: Column) -> Column:
    return F.floor(size / 4).cast("long")


def fence_language(kind: Column, path: Column) -> Column:
    """Fence tag of a node's text: markdown for sections, else by extension, else empty."""
    tags = F.create_map(*[F.lit(x) for pair in FENCES.items() for x in pair])
    return F.when(kind == "Section", F.lit("markdown")).otherwise(F.coalesce(F.try_element_at(tags, path_extension(path)), F.lit("")))


def format_age(seconds: Column) -> Column:
    s = F.greatest(seconds, F.lit(0))
    unit = lambda n, tag: F.concat(F.floor(s / n).cast("string"), F.lit(tag))
    return F.when(s < 60, unit(1, "s")).when(s < 3600, unit(60, "m")).when(s < 86400, unit(3600, "h")).otherwise(unit(86400, "d"))


def format_size(size: Column) -> Column:
    step = lambda n, tag: F.concat(F.format_number(size / n, 1), F.lit(tag))
    return F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B"))).when(size < 1 << 20, step(1 << 10, " KB")).when(size < 1 << 30, step(1 << 20, " MB")).otherwise(step(1 << 30, " GB"))
