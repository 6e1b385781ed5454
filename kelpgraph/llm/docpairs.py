"""Functions paired with their documentation, by windows over lexed tokens.

The current version of each file is lexed by one regular expression per
language family into token rows: comments, strings, brackets, line breaks and
runs of code. Running sums over a file give each token its line and bracket
depth. Tokens that stand first on their line are its heads. A running count of
starts puts adjacent heads into islands: comment lines, then any number of
decorators, annotations, attributes or instructions to tools, then the line
they stand above, found by lags; the island's comment belongs to the lines
after it. In Python a string that is the first statement after a ``def`` is
attached to it by a running last value. Matching brackets (the next token at
the same depth) delimit functions whose end is unknown.

Scale: file contents are shuffled once, by file, and lexed once for the
comments; all windows run on that partitioning, in one order, so no window is
larger than a file.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpgraph.llm.sources import ORDER, source_versions

_STRING = r"""\"[^\"\\\n]*+(?:\\.[^\"\\\n]*+)*+\"|'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'"""
_BREAK = r"[ \t\r\f]*+\n\s*+"
#: Token patterns of the language families; a run of code never holds a special character but as its first.
LEXERS = {
    "c": rf"{_BREAK}|/\*[\s\S]*?(?:\*/|\z)|//[^\n]*+|`[^`]*+`|{_STRING}|[{{}}]|[^\n\"'`/{{}}]++|[\s\S]",
    "rust": rf"{_BREAK}|/\*[\s\S]*?(?:\*/|\z)|//[^\n]*+|\"[^\"\\]*+(?:\\[\s\S][^\"\\]*+)*+\"|'(?:\\.[^'\n]*+|[^\\'\n])'|[{{}}]|[^\n\"'/{{}}]++|[\s\S]",
    "php": rf"{_BREAK}|/\*[\s\S]*?(?:\*/|\z)|//[^\n]*+|#(?!\[)[^\n]*+|\"[^\"\\]*+(?:\\[\s\S][^\"\\]*+)*+\"|'[^'\\]*+(?:\\[\s\S][^'\\]*+)*+'|[{{}}]|[^\n\"'#/{{}}]++|[\s\S]",
    "ruby": rf"{_BREAK}|(?m:^=begin[\s\S]*?^=end[^\n]*+)|#(?!\{{)[^\n]*+|{_STRING}|[{{}}]|[^\n\"'#{{}}]++|[\s\S]",
    "python": rf"{_BREAK}|#[^\n]*+|[a-zA-Z]{{0,2}}(?:\"\"\"[\s\S]*?(?:\"\"\"|\z)|'''[\s\S]*?(?:'''|\z))|[a-zA-Z]{{0,2}}(?:{_STRING})|[({{\[]|[)}}\]]|[^\n\"'#(){{}}\[\]]++|[\s\S]",
}
FAMILY = {"python": "python", "ruby": "ruby", "php": "php", "rust": "rust"}
_MARKS = re.compile(r"^[\s/*#!<>\-=~.\"'`|]*|[\s/*#!\-=~.\"'`|]*$")
# What makes a comment no documentation.
_TOOL = re.compile(
    r"^\W*(?:eslint|tslint|jshint|jslint|prettier|istanbul|c8|v8|webpack|noqa|nosec|pylint|flake8|mypy|pyright|type:\s*ignore|pragma|fmt:|isort|yapf|black:|ruff|rubocop|frozen_string_literal|encoding|coding|-\*-|go:|nolint|\+build|lint|clang|cppcheck|coverity|clippy|rustfmt|noinspection|phpcs|psalm|phpstan|@?codecoverageignore|sonar|resharper|checkstyle|spotbugs|suppress|@suppress|@ts-|ts-|@flow|@jsx|sourcemapping|region|endregion|cspell|spell-?checker|codespell|vim:|line \d|bazel|buildifier|stylecop|ignore-|skip-|nosonar|no-?check|@?formatter:|rustfmt|allow\(|deny\(|GENERATED-|pyre-|bandit|cov(?:erage)?:|standard:|deno-lint|biome-ignore|swiftlint|ktlint|detekt|pmd\b)",
    re.I,
)
_LATER = re.compile(r"^\W*(?:to[- ]?do|fixme|xxx+|tbd|tba|wip|hack|pending|later|undocumented|to be (?:written|done|documented|filled|added)|(?:add|write|fill|insert|needs?|missing|no|put|update) (?:\w+ ){0,3}(?:docs?|documentation|description|comment|summary|text|here|in|me|yet)\b|(?:docs?|documentation|description|comment) (?:goes here|here|to follow|missing|needed|pending|later|tbd)|(?:noch )?zu (?:dokumentieren|schreiben)|folgt|por (?:documentar|hacer)|pendiente|à (?:documenter|faire|compléter)|後で|未記入)(?:\b|$)(?P<rest>.*)$", re.I | re.S)
_HOLLOW = frozenset(
    "description descriptions desc summary documentation docs doc docstring comment comments function method func procedure routine helper constructor getter setter inheritdoc internal private public deprecated param params parameter parameters args arguments returns return see note none null n a na nothing placeholder text example examples overview details brief abstract info information remarks beschreibung descripción descripcion résumé resume zusammenfassung kommentar funktion função fonction función 説明 概要".split()
)
_FILLERS = frozenset("the a an this that it its function method func routine helper procedure will does do is are was to of for and in on by with from used which s here be can call called calls simply just implements implementation new".split())
_CODE = re.compile(
    r"^\s*(?:(?:let|var|const|int|long|auto|final|static|pub|mut|local|my)\s+[\w$:<>\[\] *]+=.*|\$?[\w.$\[\]>-]+\s*(?::=|[-+*/|&]?=)\s*\S.*|(?:if|else if|elsif|elif|while|for|foreach|switch|unless)\b.*[:{]\s*|(?:if|unless|while)\s+\w+\s*[<>=!]+\s*\w+(?:\s+then)?|(?:}\s*)?else\b.*[{:]?\s*|.*[;{}]\s*|return\b.*|(?:def|func|fn|function|class|import|from|require|use|end|break|continue|pass|yield|throw|raise)\b[^.]*[\w)\"';:{]?|[\w.$:>-]+\([^)]*\)[;.]?|[)\]}]+[;,)]*)\s*$"
)
_BANNER = re.compile(r"^/\*!|@license\b|\bcopyright\b|\bcode generated\b|@generated\b|<auto-?generated>|\bdo not edit\b", re.I)


def _stem(word: str) -> str:
    """A crude stem that makes the inflections of one verb or noun equal."""
    w = word.lower()
    for end in ("ization", "ingly", "ings", "ing", "ations", "ation", "ions", "ion", "ies", "ied", "ers", "er", "ors", "or", "ed", "es", "s"):
        if w.endswith(end) and len(w) - len(end) >= 3:
            w = w[: -len(end)]
            break
    if len(w) > 3 and w[-1] in "eyi":
        w = w[:-1]
    return w[:-1] if len(w) > 3 and w[-1] == w[-2] and w[-1] not in "aeiou" else w


def clean_doc(text: str) -> str:
    """The words of a comment or docstring, without delimiters and line marks."""
    body = re.sub(r"^\s*[a-zA-Z]{0,2}(\"\"\"|'''|\"|')", "", text.strip())
    body = re.sub(r"(\"\"\"|'''|\"|')\s*$", "", body) if body != text.strip() else body
    body = re.sub(r"^/\*+!?|\*+/$|^<!--|-->$|^=begin|^=end.*$", "", body.strip(), flags=re.M)
    lines = [re.sub(r"^\s*(?://[/!]*|#+(?!\[)|\*+(?!\w)|--+|;+)\s?", "", line).rstrip() for line in body.splitlines()]
    return "\n".join(lines).strip()


def useful_doc(raw: str | None, name: str | None) -> str | None:
    """The cleaned documentation, or None if it is worthless.

    Worthless is: empty or marks only, a note to write it later, a hollow word,
    the name in words in any inflection, disabled code, instructions to tools,
    a licence or generator's banner.
    """
    if not raw or _BANNER.search(raw.strip()):
        return None
    lines = [line for line in clean_doc(raw).splitlines() if not _TOOL.match(line)]
    text = "\n".join(lines).strip()
    bare = re.sub(r"</?[a-zA-Z][^>]*>|\{@?inheritDoc\}", " ", text, flags=re.I)
    words = re.findall(r"[^\W\d_]+", bare)
    if not words:
        return None
    later = _LATER.match(bare.strip())
    if later and len(re.findall(r"[^\W\d_]+", later.group("rest"))) <= 6:
        return None
    if not raw.lstrip()[:4].lstrip("rRuUbBfF").startswith(("\"", "'")):
        filled = [line for line in lines if line.strip()]
        coded = sum(1 for line in filled if _CODE.match(line))
        if filled and coded >= 0.6 * len(filled):
            return None
    plain = [w for w in (w.lower() for w in words) if w not in _FILLERS]
    if all(w in _HOLLOW for w in plain):
        return None
    parts = {_stem(p) for p in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\d_]+", name or "")} | {(name or "").lower()}
    if all(_stem(w) in parts or w in parts or w in _HOLLOW for w in plain):
        return None
    return text


def current_sources(contents: DataFrame) -> DataFrame:
    """(file_id, content, language) of the current source files, by file; equal plans share this one exchange."""
    versions = source_versions(contents).withColumn("file_id", F.xxhash64("project_id", "file_path"))
    return versions.groupBy("file_id").agg(F.max_by(F.struct("content", "language"), F.struct(*ORDER)).alias("last")).select("file_id", "last.content", "last.language")


def lexed_tokens(contents: DataFrame) -> DataFrame:
    """(file_id, family, pos, t, kind, line, end_line, depth) of the tokens of all current source files.

    kind is n (line break), b and l (block and line comment), s (string), o and
    x (opening and closing bracket), c (code). Blank runs are left out.
    """
    last = current_sources(contents)
    family = F.lit("c")
    for language, name in FAMILY.items():
        family = F.when(F.col("language") == language, F.lit(name)).otherwise(family)
    filed = last.withColumn("family", family)
    tokens = F.lit(None).cast("array<string>")
    for name, pattern in LEXERS.items():
        tokens = F.when(F.col("family") == name, F.regexp_extract_all("content", F.lit(pattern), 0)).otherwise(tokens)
    rows = filed.select("file_id", "family", F.posexplode(tokens).alias("pos", "t"))
    head = F.substring("t", 1, 1)
    two = F.substring("t", 1, 2)
    python = F.col("family") == "python"
    kind = (
        F.when(F.col("t").contains("\n") & (F.trim(F.translate("t", "\r\n\t\f", "    ")) == ""), "n")
        .when((two == "/*") | ((F.col("family") == "ruby") & F.startswith("t", F.lit("=begin"))), "b")
        .when(((two == "//") & ~python & (F.col("family") != "ruby")) | ((head == "#") & F.col("family").isin("python", "ruby", "php")), "l")
        .when(head.isin("{", "(", "[") & (F.length("t") == 1), "o")
        .when(head.isin("}", ")", "]") & (F.length("t") == 1), "x")
        .when(F.col("t").rlike(r"^[a-zA-Z]{0,2}[\"'`]"), "s")
        .otherwise("c")
    )
    rows = rows.withColumn("kind", kind).where((F.col("kind") != "c") | (F.trim("t") != ""))
    order = Window.partitionBy("file_id").orderBy("pos")
    breaks = F.length("t") - F.length(F.replace("t", F.lit("\n"), F.lit("")))
    step = F.when(F.col("kind") == "o", 1).when(F.col("kind") == "x", -1).otherwise(0)
    line = F.lit(1) + F.coalesce(F.sum(breaks).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    depth = F.sum(step).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumns({"line": line.cast("int"), "depth": depth, "step": step}).withColumn("end_line", F.col("line") + F.when(F.col("kind") == "n", 0).otherwise(breaks).cast("int"))


def line_heads(tokens: DataFrame) -> DataFrame:
    """The tokens that stand first on their line; ``alone`` if nothing follows there; what they are: doc, attr, str, code."""
    order = Window.partitionBy("file_id").orderBy("pos")
    around = tokens.withColumns({"before": F.lag("kind").over(order), "after": F.lead("kind").over(order)})
    heads = around.where((F.col("kind") != "n") & (F.col("before").isNull() | (F.col("before") == "n")))
    alone = F.col("after").isNull() | (F.col("after") == "n")
    marks = F.ltrim(F.col("t"))
    attr = (F.col("kind") == "c") & (F.startswith(marks, F.lit("@")) | F.startswith(marks, F.lit("#[")) | (F.startswith(marks, F.lit("[")) & (F.col("family") == "c"))) | ((F.col("kind") == "o") & (F.col("t") == "[") & (F.col("family") == "c"))
    what = F.when(F.col("kind").isin("b", "l") & alone, "doc").when(attr, "attr").when((F.col("kind") == "s") & alone, "str").otherwise("code")
    return heads.withColumn("what", what)


def attached_docs(heads: DataFrame) -> DataFrame:
    """(file_id, at_line, doc_line, text, rank): comments by the lines they stand above, docstrings by their def's line.

    An island is one comment (adjacent line comments are one), the attributes
    and tool lines directly after it, however many, and the line after these; a
    blank line between parts them. The lines of an open bracket of Python
    belong to what opened it. One pass: lags, a running sum and a running last
    value over one order, then one aggregate on the same partitioning.
    """
    order = Window.partitionBy("file_id").orderBy("pos")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    python = F.col("family") == "python"
    tool = (F.col("kind") == "l") & F.col("t").rlike(r"^//go:|^//\s*(?:eslint|@ts-|prettier|nolint|NOLINT)|^#\s*(?:noqa|pylint|rubocop|type:\s*ignore)")
    # a statement of Python begins on a head at bracket depth 0; its own bracket may open on it
    outer = F.col("depth") - F.greatest(F.col("step"), F.lit(0))
    statement = python & (outer == 0) & ~F.col("kind").isin("l", "x")
    inner = python & ((outer > 0) | (F.col("kind") == "x"))
    opener = F.last(F.when(statement, F.col("what")), ignorenulls=True).over(before)
    part = F.when(inner, F.when(opener == "attr", F.lit("attr")).otherwise(F.lit("code"))).when((F.col("what") == "doc") & tool, F.lit("attr")).when(F.col("what").isin("doc", "attr"), F.col("what")).otherwise(F.lit("code"))
    parted = heads.withColumn("part", part)
    above, upper = F.lag("part").over(order), F.lag("end_line").over(order)
    on = (upper + 1 == F.col("line")) & (above != "code")
    same = (F.col("part") != "doc") | (above == "doc") & (F.col("kind") == "l") & (F.lag("kind").over(order) == "l")
    ahead = F.last(F.when(statement, F.struct("t", "line")), ignorenulls=True).over(before)
    chained = parted.withColumns({"joined": F.coalesce(on & same, F.lit(False)), "ahead": F.when(statement & (F.col("what") == "str"), ahead)})
    island = chained.withColumn("island", F.sum(F.when(F.col("joined"), 0).otherwise(1)).over(so_far))
    inside = F.when(F.col("ahead.t").rlike(r"^\s*(?:async\s+)?def\b"), F.struct(F.col("ahead.line").alias("at_line"), F.col("line").alias("doc_line"), F.col("t").alias("text"), F.lit(0).alias("rank")))
    kept = island.withColumn("inside", inside).where((F.col("part") == "doc") | F.col("joined") | F.col("inside").isNotNull())
    is_doc = F.col("part") == "doc"
    comment = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(is_doc, F.struct("pos", "t")))), lambda x: x["t"]), "\n")
    units = kept.groupBy("file_id", "island").agg(F.min(F.when(is_doc, F.col("line"))).alias("doc_line"), comment.alias("text"), F.collect_list(F.when(~is_doc, F.col("line"))).alias("below"), F.first("inside", ignorenulls=True).alias("inside"))
    outside = F.transform(F.when(F.col("doc_line").isNotNull(), F.col("below")), lambda at: F.struct(at.alias("at_line"), F.col("doc_line"), F.col("text"), F.lit(1).alias("rank")))
    found = F.concat(F.coalesce(outside, F.expr("cast(array() as array<struct<at_line:int,doc_line:int,text:string,rank:int>>)")), F.array_compact(F.array("inside")))
    return units.select("file_id", F.explode(found).alias("d")).select("file_id", "d.at_line", "d.doc_line", "d.text", "d.rank")


def functions_of(nodes: DataFrame) -> DataFrame:
    """(file_id, node_id, name, project_id, file_path, start_line, end_line) of the distinct Function nodes."""
    rows = nodes.where("kind = 'Function' and id is not null and start_line is not null and project_id is not null and file_path is not null")
    one = rows.groupBy("id").agg(F.max(F.struct("name", "project_id", "file_path", "start_line", "end_line")).alias("n"))
    return one.select(F.xxhash64("n.project_id", "n.file_path").alias("file_id"), F.col("id").alias("node_id"), "n.name", "n.project_id", "n.file_path", "n.start_line", "n.end_line")


def documented_functions(nodes: DataFrame, contents: DataFrame) -> DataFrame:
    """(node_id, name, file_id, start_line, end_line, doc_line, doc): functions with useful documentation.

    A docstring goes before a comment. Repeated nodes count once; nodes without
    id, file or line, and files without content, give nothing. ``doc`` is the
    cleaned text. Null names are compared as empty.
    """
    docs = attached_docs(line_heads(lexed_tokens(contents)))
    pairs = functions_of(nodes).join(docs.withColumnRenamed("at_line", "start_line"), ["file_id", "start_line"])

    @F.pandas_udf("string")
    def useful(texts: pd.Series, names: pd.Series) -> pd.Series:
        return pd.Series([useful_doc(t, n) for t, n in zip(texts, names)], dtype=object)

    kept = pairs.withColumn("doc", useful("text", "name")).where("doc is not null")
    best = kept.groupBy("node_id").agg(F.min_by(F.struct("name", "file_id", "start_line", "end_line", "doc_line", "doc"), F.struct("rank", "doc_line")).alias("b"))
    return best.select("node_id", "b.*")


def bracket_extents(tokens: DataFrame) -> DataFrame:
    """(file_id, open_line, close_line) of the outermost bracket pair that opens on each line."""
    ends = tokens.where(F.col("kind").isin("o", "x") & F.col("t").isin("{", "}"))
    level = F.col("depth") + F.when(F.col("kind") == "x", 1).otherwise(0)
    order = Window.partitionBy("file_id", "level").orderBy("pos")
    matched = ends.withColumn("level", level).withColumns({"close_line": F.lead("line").over(order), "next": F.lead("kind").over(order)})
    opened = matched.where("kind = 'o' and next = 'x'")
    return opened.groupBy("file_id", F.col("line").alias("open_line")).agg(F.min_by("close_line", "level").alias("close_line"))


def code_pairs(nodes: DataFrame, contents: DataFrame) -> DataFrame:
    """(node_id, name, doc_line, doc, code): documented functions with their code.

    The code runs from the start line to the node's end line; where that is
    null, to the matching bracket, and without one to the line before the next
    that is indented no deeper.
    """
    found = documented_functions(nodes, contents)
    tokens = lexed_tokens(contents)
    extents = bracket_extents(tokens.where("family not in ('python', 'ruby')"))
    ended = found.join(extents.withColumnRenamed("open_line", "start_line"), ["file_id", "start_line"], "left").withColumn("stop", F.coalesce("end_line", "close_line"))
    last = current_sources(contents)
    lines = F.split(F.replace("content", F.lit("\r\n"), F.lit("\n")), "\n")
    joined = ended.join(last.select("file_id", lines.alias("lines")), "file_id")
    rest = F.expr("array_join(slice(lines, start_line, greatest(0, coalesce(stop, size(lines)) - start_line + 1)), '\n')")

    @F.pandas_udf("string")
    def by_indent(texts: pd.Series) -> pd.Series:
        return pd.Series([_by_indent(t) for t in texts], dtype=object)

    code = F.when(F.col("stop").isNotNull(), F.col("code")).otherwise(by_indent("code"))
    return joined.withColumn("code", rest).select("node_id", "name", "doc_line", "doc", code.alias("code"))


def _by_indent(text: str | None) -> str | None:
    if not text:
        return text
    lines = text.split("\n")
    indent = len(lines[0]) - len(lines[0].lstrip())
    end = 1
    while end < len(lines):
        line = lines[end]
        if line.strip() and len(line) - len(line.lstrip()) <= indent and not re.match(r"\s*(?:[)\]}]|end\b)", line):
            break
        end += 1
        if re.match(r"\s*end\b", line) and len(line) - len(line.lstrip()) == indent:
            break
    return "\n".join(lines[:end]).rstrip()
