"""Reading source trees, side files and settings."""

from __future__ import annotations

import ipaddress
import json
import os
import re
import tomllib
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpgraph.functions.text import is_noise
from kelpgraph.model import PROJECTS, USAGE
from kelpgraph.sources.languages import is_indexed, language_of

IGNORE_FILES = (".gitignore", ".ignore", ".kelpgraphignore")
NOISE = frozenset([".git", "target", "node_modules", ".kelpgraph"])


class NotIndexed(FileNotFoundError):
    """A project has no index yet."""


def ignore_rules(root: str) -> list[tuple[str, str]]:
    """(folder, rule) of the ignore files of the root and of all folders below it, outer ones first; comments are left out."""
    out = []
    for folder, below, names in os.walk(root):
        below[:] = sorted(d for d in below if d not in NOISE)
        for name in IGNORE_FILES:
            if name in names:
                with open(os.path.join(folder, name), encoding="utf-8", errors="replace") as file:
                    rules = [line.rstrip("\n").rstrip() for line in file]
                inner = os.path.relpath(folder, root)
                out += [("" if inner == "." else inner + "/", rule) for rule in rules if rule and not rule.startswith("#")]
    return out


def _rule_regex(folder: str, rule: str) -> str:
    """A regular expression for the paths that a rule names: ``*`` within a part, ``**`` across parts, a slash at the end for folders only."""
    bare = rule.strip("/")
    anchored = "/" in rule.rstrip("/")
    out, at = [], 0
    while at < len(bare):
        if bare.startswith("**/", at):
            out.append("(?:.*/)?")
            at += 3
        elif bare.startswith("**", at):
            out.append(".*")
            at += 2
        elif bare[at] == "[" and "]" in bare[at + 2 :]:
            close = bare.index("]", at + 2)
            body = bare[at + 1 : close]
            out.append("[" + ("^" + body[1:] if body[0] in "!^" else body) + "]")
            at = close + 1
        else:
            out.append({"*": "[^/]*", "?": "[^/]"}.get(bare[at], re.escape(bare[at])))
            at += 1
    return "^" + re.escape(folder) + ("" if anchored else "(?:.*/)?") + "".join(out) + ("/" if rule.endswith("/") else "(?:/|$)")


def is_ignored(path: Column, rules: list[tuple[str, str]]) -> Column:
    """Whether a path is ignored: the last rule that names it or a folder above it counts, and one with ``!`` takes it in again."""
    ignored = F.lit(False)
    for folder, rule in rules:
        back = rule.startswith("!")
        ignored = F.when(path.rlike(_rule_regex(folder, rule[1:] if back else rule)), F.lit(not back)).otherwise(ignored)
    return ignored


def tree_listing(spark: SparkSession, root: str) -> DataFrame:
    """(file_path, length, modified) of the indexed files below a root, ignore rules applied; contents are not read."""
    base = os.path.realpath(root)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load("file://" + base)
    relative = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), "^" + re.escape(base) + "/", "")
    rows = files.select(relative.alias("file_path"), "path", "length", F.col("modificationTime").alias("modified")).where(is_indexed(F.col("file_path")) & ~is_noise(F.col("file_path")))
    return rows.where(~is_ignored(F.col("file_path"), ignore_rules(base)))


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """(file_path, content, language) of the indexed files below a root; bad UTF-8 becomes replacement characters.

    Only the files that the listing keeps are opened, by the executors; the
    root lies on storage that all of them mount.
    """
    base = os.path.realpath(root)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with open(os.path.join(base, path), "rb") as file:
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([file.read().decode("utf-8", errors="replace")], pa.string())], names=["file_path", "content"])

    kept = tree_listing(spark, root).select("file_path").repartition("file_path")
    return kept.mapInArrow(read, "file_path string, content string").withColumn("language", language_of(F.col("file_path")))


def content_signature(listing: DataFrame, *keys: str) -> DataFrame:
    """(keys, files, signature): a number for each set of files that changes with any path, size or time, in any order."""
    each = F.xxhash64("file_path", "length", F.col("modified").cast("string"))
    sums = [F.count("*").alias("files"), F.coalesce(F.expr("bit_xor(h)"), F.lit(0)).alias("signature")]
    rows = listing.select(*keys, "file_path", "length", "modified").distinct().withColumn("h", each)
    return rows.groupBy(*keys).agg(*sums) if keys else rows.agg(*sums)


def estimate_watches(root: str, budget: int) -> int:
    """Folders below a root with the root itself, ignore rules off; the walk stops once there are more than ``budget``."""
    n = 0
    for _ in os.walk(root, followlinks=False):
        n += 1
        if n > budget:
            break
    return n


def load_projects(spark: SparkSession, path: str) -> DataFrame:
    """The project registry; a missing or broken file is an empty one."""
    return _side_file(spark, path, "projects", PROJECTS)


def load_usage(spark: SparkSession, path: str) -> DataFrame:
    """Usage counters; a missing or broken file is an empty one."""
    return _side_file(spark, path, "usage", USAGE)


def _side_file(spark: SparkSession, path: str, key: str, schema) -> DataFrame:
    try:
        with open(path, encoding="utf-8") as file:
            rows = json.load(file)[key]
        cells = [tuple(r.get(f.name) for f in schema) for r in rows]
        return spark.createDataFrame(cells, schema)
    except (OSError, ValueError, KeyError, TypeError, AttributeError):
        return spark.createDataFrame([], schema)


def save_rows(path: str, key: str, rows: list[dict]) -> None:
    """Writes a side file at once, readable by the owner only."""
    os.makedirs(os.path.dirname(path) or ".", mode=0o700, exist_ok=True)
    part = f"{path}.{os.getpid()}.part"
    with os.fdopen(os.open(part, os.O_WRONLY | os.O_CREAT | os.O_TRUNC, 0o600), "w", encoding="utf-8") as file:
        json.dump({key: rows}, file, sort_keys=True, default=str)
    os.replace(part, path)


def log_tail(spark: SparkSession, path: str, lines: int = 300) -> DataFrame:
    """(line_no, value) of the last lines of a log of any size."""
    rows = spark.read.text(path).withColumn("at", F.monotonically_increasing_id())
    return rows.orderBy(F.desc("at")).limit(lines).orderBy("at").select("at", "value")


@dataclass
class Settings:
    """Settings that change results; read from TOML."""

    endpoint: str = ""
    model: str = ""
    enabled: bool = False
    allow_remote: bool = False
    api_key: str = ""
    timeout_secs: int = 30
    allowed_roots: list[str] = field(default_factory=list)
    warm_window_secs: int = 21_600
    preset: str = "standard"
    tools: list[str] = field(default_factory=list)


def load_settings(path: str) -> Settings:
    """Defaults if the file is missing; a malformed file is an error."""
    if not os.path.exists(path):
        return Settings()
    with open(path, "rb") as file:
        raw = tomllib.load(file)
    e, w, t = raw.get("embeddings", {}), raw.get("watcher", {}), raw.get("tools", {})
    known = {k: e[k] for k in ("endpoint", "model", "enabled", "allow_remote", "api_key", "timeout_secs") if k in e}
    return Settings(**known, allowed_roots=raw.get("allowed_roots", []), warm_window_secs=w.get("warm_window_secs", 21_600), preset=t.get("preset", "standard"), tools=t.get("enabled", []))


def redacted(settings: Settings) -> dict:
    """The settings without the key itself."""
    out = {k: v for k, v in vars(settings).items() if k != "api_key"}
    return out | {"has_api_key": bool(settings.api_key)}


def is_loopback_or_private(host: str) -> bool:
    if host.lower() == "localhost":
        return True
    try:
        ip = ipaddress.ip_address(host.strip("[]"))
    except ValueError:
        return False
    return ip.is_loopback or ip.version == 4 and any(ip in ipaddress.ip_network(n) for n in ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16"))


def embeddings_policy(settings: Settings) -> str:
    """NotConfigured, Disabled, Allowed or RemoteBlocked."""
    if not settings.endpoint or not settings.model:
        return "NotConfigured"
    if not settings.enabled:
        return "Disabled"
    host = urlparse(settings.endpoint if "://" in settings.endpoint else "//" + settings.endpoint).hostname or ""
    return "Allowed" if is_loopback_or_private(host) or settings.allow_remote else "RemoteBlocked"


def is_path_allowed(path: str, allowed: list[str]) -> bool:
    """An empty list allows all; else the real path must lie at or below one of the roots."""
    real = os.path.realpath(path)
    roots = [os.path.realpath(r) for r in allowed]
    return not roots or any(real == r or real.startswith(r.rstrip("/") + "/") for r in roots)
