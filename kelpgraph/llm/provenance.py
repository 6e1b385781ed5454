"""Generated, minified, vendored and data-only source files.

Every stored version of a file is profiled where it is read, over its stream of
normalised tokens (without comments). Fingerprints are chosen by winnowing: the
smallest hash of each window of token k-grams. A file is a vendored copy if
most of its fingerprints recur in at least ``min_projects`` projects; that way
every copy counts, whatever its folder or header says. A file is generated if
the shapes of its tokens (names and numbers made equal) repeat themselves, most
of its shape grams standing in it three times or more, while the numbers in its
names count up; also if a comment says, in the customary words, that a tool made it and that it
is not edited. Data and minified files are told by the share of their
characters in rows of literals and in long lines. Only the profiles are
shuffled, to pick the current version.

Scale: fingerprints are (hash, file, project) rows. They are counted in two
steps, by (hash, project) and by hash, and the recurring ones meet the files'
rows again by salted hashes, so that the fingerprint of a licence text in a
third of all files is spread over ``SALTS`` tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpgraph.llm.sources import latest_of, source_versions

K, WINDOW = 48, 32
MIN_PROJECTS = 3
RECURRING = 0.6
_TOKEN = re.compile(r"[^\W\d]\w*|\d[\w.]*|[^\s\w]")
_HASHED = re.compile(r"/\*[\s\S]*?\*/|\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?'''|^=begin[\s\S]*?^=end|^[ \t]*(?:#(?!!?\[|include|define|if|endif|else|pragma|undef)|//)[^\n]*|(?<=\s)//[^\n]*|(?<=\s)# [^\n]*", re.M)
_COMMENT = re.compile(r"^\s*(?://|#(?!\[|!|include|define|if|endif|else|pragma|undef)|/?\*|<!--|--|\"\"\"|''')")
#: The customary words of a comment that says a tool wrote the file, and that its text is not edited by hand.
_MADE = re.compile(r"@generated\b|<auto-?generated>|\b(?:auto-?|automatically |code )generated\b|\bgenerated (?:by|from|with)\b|\bautomatisch (?:generiert|erzeugt|erstellt)\b|\bg[ée]n[ée]r[ée] automatiquement\b|\bgenerado autom[áa]ticamente\b|自動生成", re.I)
_HANDS_OFF = re.compile(r"\bdo not (?:edit|modify|change)\b|\bdon't edit\b|\b(?:edits|changes)\b.{0,30}\b(?:lost|overwritten)\b|\bnicht (?:bearbeiten|ändern)\b|\bno (?:editar|modificar)\b|\bne pas (?:modifier|éditer)\b|編集しない", re.I)
_ENDING = re.compile(r"[^\W\d]\w*?(\d{1,9})")
#: Words of languages that keep their place in the shape of a token stream.
_KEPT = frozenset("if else for while return def class func fn function let const var int long static pub public import from in end do".split())
_DATA_ROW = re.compile(r"^\s*(?:[\[({]\s*)?(?:[-+]?(?:0[xX][\da-fA-F]+|\d[\d.eE+-]*)[uUlLfF]*\s*[,;]?\s*){3,}[\])}]*[,;]?\s*$|^\s*[\[({].*[\])}],?;?\s*$|^\s*(?:\"[^\"]*\"|'[^']*')(?:\s*(?:,|\.|\+|=>|:)\s*(?:\"[^\"]*\"|'[^']*'|[\d.]+))*\s*,?\s*[)\]};]*$|^-?[\w.\"]+(?:[;,|\t][-\w.\" ]*){3,}$|^\s*\"?[A-Za-z0-9+/=_-]{60,}\"?[,;)]*$")
_LITERAL = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`]*`")
LONG = 200
#: A smaller text is a small table or a long line, no blob and no bundle.
SMALL = 400
#: Shape grams of this many tokens; this share of them must recur in the file, of at least one window of grams.
SHAPE_K, REPEATED = 24, 0.75
SALTS = 64
#: So large a share of the characters stands in data rows and long lines.
ROWS = 0.9
_ROW_STARTS = frozenset("[({\"'0123456789+-.")
class _Codes(dict):
    """Stable 64-bit codes of tokens."""

    def __missing__(self, token: str) -> int:
        import zlib

        data = token.encode("utf-8", "surrogatepass")
        code = (zlib.crc32(data) << 32) | zlib.adler32(data) ^ (len(data) * 0x9E3779B1 & 0xFFFFFFFF)
        if len(self) < 500_000:
            self[token] = code
        return code


def stream(text: str) -> list[str]:
    """The tokens of a text without its comments."""
    return _TOKEN.findall(_HASHED.sub(" ", text))


def _grams(values: np.ndarray, k: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        grams = _spans(_mixed(values, 29, 0xBF58476D1CE4E5B9), k, lambda left, right, width: left * np.uint64(pow(0x100000001B3, width, 1 << 64)) + right)
        return _mixed(grams, 31, 0x94D049BB133111EB)


def fingerprints(text: str, codes: dict, k: int = K, window: int = WINDOW) -> np.ndarray:
    """Winnowed hashes of the token k-grams of a text without its comments; a shorter text gives one hash."""
    return _winnowed(stream(text), codes, k, window)


def _winnowed(tokens: list[str], codes: dict, k: int = K, window: int = WINDOW) -> np.ndarray:
    if not tokens:
        return np.zeros(0, dtype=np.int64)
    grams = _grams(np.fromiter(map(codes.__getitem__, tokens), dtype=np.uint64), min(k, len(tokens)))
    if len(grams) <= window:
        return grams.min(keepdims=True).view(np.int64)
    return np.unique(_spans(grams, window, lambda left, right, width: np.minimum(left, right))).view(np.int64)


class _Shapes(dict):
    """Codes of the shapes of tokens: kept words and signs as they are, other names, numbers."""

    def __missing__(self, token: str) -> int:
        shape = "0" if token[0].isdigit() else "a" if (token[0].isalpha() or token[0] == "_") and token not in _KEPT else token
        code = 77 + sum(ord(c) << 7 * i for i, c in enumerate(shape[:8]))
        if len(self) < 500_000:
            self[token] = code
        return code


def repeated_share(tokens: list[str], shapes: dict, k: int = SHAPE_K, window: int = WINDOW) -> float:
    """The share of the shape k-grams that stand in the text three times or more; 0 for less than a window of grams."""
    if len(tokens) < k + window - 1:
        return 0.0
    _, counts = np.unique(_grams(np.fromiter(map(shapes.__getitem__, tokens), dtype=np.uint64), k), return_counts=True)
    return float(counts[counts >= 3].sum() / counts.sum())


def _mixed(values: np.ndarray, shift: int, factor: int) -> np.ndarray:
    return (values ^ (values >> np.uint64(shift))) * np.uint64(factor)


def _spans(values: np.ndarray, width: int, join) -> np.ndarray:
    """``join`` over every run of ``width`` values, by doubling: spans of 1, 2, 4, ... put together to ``width``."""
    total = len(values) - width + 1
    done, size, at = None, 1, 0
    block = values
    while width >> at:
        if width >> at & 1:
            # spans so far cover the first ``done_width`` values; this block covers the next ``size``
            if done is None:
                done, done_width = block, size
            else:
                done = join(done[:total], block[done_width : done_width + total], size)
                done_width += size
        at += 1
        if width >> at:
            block = join(block[:-size], block[size:], size)
            size *= 2
    return done[:total]


def counts_up(tokens: list[str]) -> bool:
    """The numbers at the ends of the distinct names mostly follow each other, as a tool counts them."""
    numbers = [int(m.group(1)) for m in map(_ENDING.fullmatch, dict.fromkeys(tokens)) if m]
    return len(numbers) >= 8 and sum(b == a + 1 for a, b in zip(numbers, numbers[1:])) >= 0.6 * (len(numbers) - 1)


def _shape(lines: list[str]) -> str | None:
    """``data`` or ``minified`` if most characters of the code stand in rows of data or in long lines."""
    long, rows, size, ordinary = [], 0, 0, 0
    spare = (1 - ROWS) * sum(map(len, lines))
    for line in lines:
        bare = line.strip()
        if not bare or _COMMENT.match(line):
            continue
        size += len(line)
        if len(line) > LONG:
            long.append(line)
        elif (bare[0] in _ROW_STARTS or sum(map(bare.count, ";,|\t")) >= 3 or (len(bare) >= 60 and " " not in bare)) and _DATA_ROW.match(line):
            rows += len(line)
        else:
            ordinary += len(line)
            if ordinary > spare:
                return None
    wide = sum(map(len, long))
    if size < SMALL or wide + rows < ROWS * size:
        return None
    literal = sum(len(m.group()) for line in long for m in _LITERAL.finditer(line) if len(m.group()) > 60)
    if 2 * (literal + rows) >= size:
        return "data"
    signs = sum(map("".join(long).count, "(){}[];,.=?:"))
    return "minified" if signs >= 0.15 * wide else None


def kind_of(text: str, path: str = "", tokens: list[str] | None = None, shapes: dict | None = None) -> str | None:
    """``data``, ``minified``, ``generated``, or None for what may be source; the path says nothing."""
    tokens = stream(text) if tokens is None else tokens
    shapes = _Shapes() if shapes is None else shapes
    lines = text.split("\n")
    shape = _shape(lines)
    if shape:
        return shape
    if counts_up(tokens) and repeated_share(tokens, shapes) >= REPEATED:
        return "generated"
    if _MADE.search(text):
        comments = [line for line in lines if _COMMENT.match(line)]
        for i, line in enumerate(comments):
            if "@generated" in line or _MADE.search(line) and any(_HANDS_OFF.search(x) for x in comments[max(0, i - 1) : i + 2]):
                return "generated"
    return None


PROFILE = "kind string, prints array<long>"


def profile_files(contents: DataFrame) -> DataFrame:
    """(project_id, file_path, kind, prints) of the current version of each source file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, shapes = _Codes(), _Shapes()
        for batch in batches:
            kinds, prints = [], []
            for text in batch.column("content").to_pylist():
                tokens = stream(text)
                kinds.append(kind_of(text, "", tokens, shapes))
                # a text of less than one gram could be anyone's and is no copy
                prints.append(_winnowed(tokens, codes) if len(tokens) >= K else np.zeros(0, dtype=np.int64))
            keep = [batch.column(i) for i, n in enumerate(batch.schema.names) if n not in ("content", "language")]
            names = [n for n in batch.schema.names if n not in ("content", "language")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(kinds, pa.string()), pa.array(prints, pa.list_(pa.int64()))], names=[*names, "kind", "prints"])

    versions = source_versions(contents)
    kept = ", ".join(f"{n} {t}" for n, t in versions.dtypes if n not in ("content", "language"))
    return latest_of(versions.mapInArrow(run, f"{kept}, {PROFILE}"), "kind", "prints")


def recurring_files(profiles: DataFrame, *, min_projects: int = MIN_PROJECTS, share: float = RECURRING) -> DataFrame:
    """(file_id): files of whose fingerprints at least ``share`` recur in ``min_projects`` projects or more."""
    rows = profiles.select(F.xxhash64("project_id", "file_path").alias("file_id"), F.hash("project_id").alias("project"), F.size("prints").alias("total"), F.explode("prints").alias("fp"))
    spread = rows.groupBy("fp", "project").count().groupBy("fp").agg(F.count("*").alias("projects")).where(F.col("projects") >= min_projects)
    # the fingerprint of a text that very many files hold is one key with a row for each of them: both sides are salted
    salted = spread.select("fp", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    hits = rows.withColumn("salt", F.pmod("file_id", F.lit(SALTS)).cast("int")).select("file_id", "total", "fp", "salt").join(salted, ["fp", "salt"])
    return hits.groupBy("file_id").agg(F.count("*").alias("hits"), F.max("total").alias("total")).where(F.col("hits") >= share * F.col("total")).select("file_id")


def foreign_files(profiles: DataFrame, **options) -> DataFrame:
    """(project_id, file_path, kind): the files that no one of the project wrote by hand.

    ``kind`` is generated, minified, data or vendored. Null contents
    count as empty, and empty files are source; repeated rows and older
    versions of a file change nothing.
    """
    copies = recurring_files(profiles, **options).withColumn("copied", F.lit(True))
    named = profiles.select("project_id", "file_path", "kind", F.xxhash64("project_id", "file_path").alias("file_id"))
    both = named.join(copies, "file_id", "left")
    kind = F.coalesce("kind", F.when(F.col("copied"), F.lit("vendored")))
    return both.select("project_id", "file_path", kind.alias("kind")).where("kind is not null")
