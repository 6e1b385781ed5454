"""From source trees to graph tables: sections, tags, call attribution and resolution, upserts, rebuild."""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpgraph.functions.text import CHUNK_CHARACTERS, longest_line, text_lines
from kelpgraph.sources.languages import MINIFIED_LINE_BYTES, is_markdown, language_of

_HEADING = re.compile(r"^\s*(#{1,6})[ \t]+(.*)$")
_FENCE = re.compile(r"^\s*(`{3,}|~{3,})(.*)$")
_HUNK = re.compile(r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@")
SECTIONS = "name string, level int, start_line int, end_line int, parent int"
#: Over so many tasks the calls of one name are spread.
SALTS = 16
TAGS = "category string, name string, start_row int, end_row int, seq int"


def split_lines(text: str) -> list[str]:
    """Lines without their ends; none after a last line end."""
    lines = text.split("\n")
    if lines and lines[-1] == "":
        lines.pop()
    return [line[:-1] if line.endswith("\r") else line for line in lines]


def sections_of(text: str) -> list[tuple[str, int, int, int, int | None]]:
    """(name, level, start, end, parent) of the ATX headings outside fences; a section ends before the next of its level or above."""
    found: list[list] = []
    fence = ""
    lines = split_lines(text)
    for number, line in enumerate(lines, 1):
        mark = _FENCE.match(line)
        if fence:
            if mark and mark[1][0] == fence[0] and len(mark[1]) >= len(fence) and not mark[2].strip():
                fence = ""
            continue
        if mark and not (mark[1][0] == "`" and "`" in mark[2]):
            fence = mark[1]
            continue
        heading = _HEADING.match(line)
        if heading:
            name = heading[2].strip().rstrip("#").strip()
            if name:
                found.append([name, len(heading[1]), number, len(lines), None])
    open_at: list[int] = []
    for i, section in enumerate(found):
        while open_at and found[open_at[-1]][1] >= section[1]:
            found[open_at.pop()][3] = section[2] - 1
        section[4] = open_at[-1] if open_at else None
        open_at.append(i)
    return [tuple(s) for s in found]


def _rows_of(frame: DataFrame, keys: tuple[str, ...], text: str, extract: Callable[..., list[tuple]], schema: str, *more: str) -> DataFrame:
    """Applies ``extract(text, *more)`` to each row, keeping ``keys``; Arrow batches in and out."""
    kinds = {n: t for n, t in frame.dtypes}
    out_schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", " + schema
    fields = [f.strip().split(" ") for f in schema.split(",")]
    arrow = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(keys)).to_pylist()
            extra = [batch.column(len(keys) + 1 + i).to_pylist() for i in range(len(more))]
            at, rows = [], []
            for i, value in enumerate(texts):
                found = extract(value or "", *(e[i] for e in extra))
                at += [i] * len(found)
                rows += found
            take = pa.array(at, pa.int64())
            columns = [batch.column(i).take(take) for i in range(len(keys))]
            cells = list(zip(*rows)) if rows else [[] for _ in fields]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array(c, type=arrow[t]) for c, (_, t) in zip(cells, fields)]], names=[*keys, *[n for n, _ in fields]])

    return frame.select(*keys, text, *more).mapInArrow(run, out_schema)


def extract_sections(contents: DataFrame, *keys: str) -> DataFrame:
    """Sections of markdown texts: (keys, name, level, start_line, end_line, parent); parent counts the file's sections from 0."""
    return _rows_of(contents, keys or ("file_path",), "content", sections_of, SECTIONS)


def python_tags(source: str) -> list[tuple[str, str, int, int]]:
    """Functions, classes and calls of a Python text by its syntax tree; of one that does not parse, definitions by their indent."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return _indented_definitions(split_lines(source))
    out = []
    for node in ast.walk(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            out.append(("function", node.name, node.lineno - 1, (node.end_lineno or node.lineno) - 1))
        elif isinstance(node, ast.ClassDef):
            out.append(("type", node.name, node.lineno - 1, (node.end_lineno or node.lineno) - 1))
        elif isinstance(node, ast.Call):
            name = node.func.id if isinstance(node.func, ast.Name) else node.func.attr if isinstance(node.func, ast.Attribute) else None
            if name:
                out.append(("call", name, node.lineno - 1, node.lineno - 1))
    return out


_DEFINED = re.compile(r"([ \t]*)(?:async\s+)?(def|class)\s+([^\W\d]\w*+)(?!\s*\(\s*:)")


def _indented_definitions(lines: list[str]) -> list[tuple[str, str, int, int]]:
    """Definitions of a text by lines: one ends before the next line that is indented no deeper."""
    out, indents = [], [len(x) - len(x.lstrip()) if x.strip() else None for x in lines]
    for row, line in enumerate(lines):
        m = _DEFINED.match(line)
        if m:
            last = row
            for i in range(row + 1, len(lines)):
                if indents[i] is not None:
                    if indents[i] <= len(m.group(1)):
                        break
                    last = i
            out.append(("function" if m.group(2) == "def" else "type", m.group(3), row, last))
    return out


_MODS = r"(?:(?:export|default|public|private|protected|internal|static|final|abstract|sealed|async|override|virtual|inline|extern|unsafe|const|pub(?:\([\w ]+\))?|partial|readonly)\s+)*"
#: Definition patterns by language, and those languages' calls; a documented stand-in where no parser is at hand.
PATTERNS: dict[str, tuple[str, str, bool]] = {
    "JavaScript": (rf"^\s*{_MODS}function\s*\*?\s*([A-Za-z_$][\w$]*)|^\s+(?:static\s+|async\s+|get\s+|set\s+)*(?!if\b|for\b|while\b|switch\b|catch\b|return\b|function\b)([A-Za-z_$][\w$]*)\s*\([^)]*\)\s*\{{", rf"^\s*{_MODS}class\s+([A-Za-z_$][\w$]*)", True),
    "TypeScript": (rf"^\s*{_MODS}function\s*\*?\s*([A-Za-z_$][\w$]*)|^\s+{_MODS}(?!if\b|for\b|while\b|switch\b|catch\b|return\b|function\b)([A-Za-z_$][\w$]*)\s*\([^)]*\)\s*(?::\s*[\w<>\[\]| ]+)?\s*\{{", rf"^\s*{_MODS}(?:class|interface|enum|type)\s+([A-Za-z_$][\w$]*)", True),
    "Go": (r"^func\s+(?:\([^)]*\)\s*)?([A-Za-z_]\w*)", r"^type\s+([A-Za-z_]\w*)", True),
    "Rust": (rf"^\s*{_MODS}fn\s+([A-Za-z_]\w*)|^\s*macro_rules!\s+(\w+)", rf"^\s*{_MODS}(?:struct|enum|trait|union|type|mod)\s+([A-Za-z_]\w*)", True),
    "Java": (rf"^\s*{_MODS}(?:<[^>]+>\s*)?[\w<>\[\], .?]+\s+([A-Za-z_]\w*)\s*\([^;]*\{{\s*$", rf"^\s*{_MODS}(?:class|interface|enum|record)\s+([A-Za-z_]\w*)", True),
    "C": (r"^(?!\s*(?:return|else|if|for|while|switch)\b)[A-Za-z_][\w\s*]*?[\s*]([A-Za-z_]\w*)\s*\([^;]*\)\s*\{", r"^\s*(?:typedef\s+)?(?:struct|union|enum)\s+([A-Za-z_]\w*)\s*\{", False),
    "Cpp": (r"^(?!\s*(?:return|else|if|for|while|switch)\b)[A-Za-z_][\w\s*&:<>,]*?[\s*&:]([A-Za-z_~]\w*)\s*\([^;]*\)[^;]*\{", r"^\s*(?:class|struct|union|enum)\s+([A-Za-z_]\w*)", False),
    "CSharp": (rf"^\s*{_MODS}[\w<>\[\], .?]+\s+([A-Za-z_]\w*)\s*(?:<[^>]*>)?\([^;]*\)\s*(?:\{{|=>)", rf"^\s*{_MODS}(?:class|interface|struct|enum|record)\s+([A-Za-z_]\w*)", True),
    "Ruby": (r"^\s*def\s+(?:self\.)?([A-Za-z_]\w*[?!=]?)", r"^\s*(?:class|module)\s+([A-Z]\w*)", True),
    "Php": (rf"^\s*{_MODS}function\s+&?([A-Za-z_]\w*)", rf"^\s*{_MODS}(?:class|interface|trait|enum)\s+([A-Za-z_]\w*)", True),
}
_ARROW = r"^\s*(?:export\s+)?(?:default\s+)?(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*(?::[^=]+)?=\s*(?:async\s+)?(?:function\b|\([^)]*\)\s*(?::\s*[^=]+)?=>|[A-Za-z_$][\w$]*\s*=>)"
for _name in ("JavaScript", "TypeScript"):
    PATTERNS[_name] = (PATTERNS[_name][0] + "|" + _ARROW, *PATTERNS[_name][1:])
PATTERNS["Tsx"] = PATTERNS["TypeScript"]
_SCRIPTS = frozenset(["JavaScript", "TypeScript", "Tsx"])
#: Functions inside a line of a script, as bundles have them.
_ANYWHERE = re.compile(r"(?<![\w$.])function\s*\*?\s*([A-Za-z_$][\w$]*)|(?<![\w$.])(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s+)?function\b")
_READY = {name: (re.compile(f), re.compile(t), calls) for name, (f, t, calls) in PATTERNS.items()}
_CALL = re.compile(r"(?<![\w$.])(?:[\w$]+(?:\.|::|->))*([A-Za-z_$][\w$]*)\s*\(")
_NO_CALL = frozenset("if for while switch catch return function def func fn elif and or not in sizeof typeof new print echo".split())
_STRINGS = r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'"
#: Comments and strings by language; what is in them is no code.
_QUIET = {
    name: re.compile(body)
    for name, body in {
        "": rf"//[^\n]*|/\*[\s\S]*?\*/|`(?:[^`\\]|\\[\s\S])*`|{_STRINGS}",
        "Rust": r"//[^\n]*|/\*[\s\S]*?\*/|\"(?:[^\"\\]|\\[\s\S])*\"|'(?:\\[^'\n]+|[^'\\\n])'",
        "Php": rf"//[^\n]*|#(?!\[)[^\n]*|/\*[\s\S]*?\*/|{_STRINGS}",
        "Ruby": rf"#[^\n]*|{_STRINGS}",
    }.items()
}
_BRACE = re.compile(r"[{}]")
_OPENING = re.compile(r"[{;]")
_BLANKS = re.compile(r"\s*")


def _blanked(m: re.Match) -> str:
    text = m.group()
    return re.sub(r"[^\n]", " ", text) if "\n" in text else " " * len(text)


def quiet_code(source: str, language: str) -> str:
    """The text with its comments and strings blanked, of the same length and lines."""
    return _QUIET.get(language, _QUIET[""]).sub(_blanked, source)


def _closing_braces(code: str) -> dict[int, int]:
    """Offset of the brace that closes each opening one."""
    out, stack = {}, []
    for m in _BRACE.finditer(code):
        if m.group() == "{":
            stack.append(m.start())
        elif stack:
            out[stack.pop()] = m.start()
    return out


def tags_of(source: str, language: str | None) -> list[tuple[str, str, int, int, int]]:
    """(category, name, start row, end row, number in the file) of a text's definitions and calls, in row order.

    Python by its syntax tree. Elsewhere a definition ends with the brace that
    closes its body, found in the text without comments and strings; without a
    body it ends at its semicolon or on its row. Ruby's ends with the ``end`` of
    its own indent.
    """
    if language == "Python":
        found = python_tags(source)
    elif language in _READY:
        functions, types, calls = _READY[language]
        source = source.replace("\r\n", "\n")
        code = quiet_code(source, language)
        lines = code.split("\n")
        closing = _closing_braces(code) if language != "Ruby" else {}
        found, at = [], 0
        for row, line in enumerate(lines):
            if not line or line.isspace():
                at += len(line) + 1
                continue
            here = None
            for category, pattern in (("type", types), ("function", functions)):
                m = pattern.match(line)
                if m:
                    here = next(filter(None, m.groups()), None)
                    if here:
                        found.append((category, here, row, _last_row(code, lines, language, category, row, at, m, closing)))
            if language in _SCRIPTS:
                for m in _ANYWHERE.finditer(line):
                    inner = m.group(1) or m.group(2)
                    if inner != here:
                        found.append(("function", inner, row, _last_row(code, lines, language, "function", row, at, m, closing)))
            if calls:
                found += [("call", c, row, row) for c in _CALL.findall(line) if c != here and c not in _NO_CALL]
            at += len(line) + 1
    else:
        found = []
    found.sort(key=lambda t: (t[2], t[0] == "call"))
    return [(*t, i) for i, t in enumerate(found)]


def _last_row(code: str, lines: list[str], language: str, category: str, row: int, at: int, m: re.Match, closing: dict[int, int]) -> int:
    line = lines[row]
    if language == "Ruby":
        indent = len(line) - len(line.lstrip())
        ends = (i for i in range(row + 1, len(lines)) if lines[i].startswith("end", indent) and not lines[i][:indent].strip() and not lines[i][indent + 3 : indent + 4].isalnum())
        return row if re.search(r"\bend\s*$|\)\s*=\s|;\s*end\b", line) else next(ends, row)
    arrow = m.group().rstrip().endswith("=>")
    if arrow:
        begin = _BLANKS.match(code, at + m.end()).end()
        if code[begin : begin + 1] != "{":
            return row
    else:
        # the name may stand before the brace that the pattern ends with
        opening = _OPENING.search(code, at + (m.end() if not m.group().rstrip().endswith("{") else m.start() + m.group().rindex("{")))
        begin = opening.start() if opening else -1
        if category == "type" and opening and "\n" in code[at:begin].rstrip() and code[at:begin].count("\n") > 1 and language in ("Go", "Rust", "TypeScript", "Tsx", "Cpp"):
            return row
        if begin < 0 or language == "Go" and category == "type" and "\n" in code[at:begin]:
            return row
    stop = closing.get(begin, begin) if code[begin] == "{" else begin
    return row + code.count("\n", at, stop)


def extract_tags(contents: DataFrame, *keys: str) -> DataFrame:
    """(keys, category, name, start_row, end_row, seq) of source texts with a ``language`` column; rows count from 0."""
    return _rows_of(contents, keys or ("file_path",), "content", tags_of, TAGS, "language")


def parse_hunks(diff: str) -> list[tuple[str, int, int]]:
    """(file, start, end) of the new side's hunks of a unified diff; a removal names the line it stands at."""
    out, path = [], None
    for line in diff.split("\n"):
        if line.startswith("+++ "):
            path = line[6:].rstrip("\r") if line.startswith("+++ b/") else path
        m = _HUNK.match(line)
        if m and path:
            start, count = int(m[1]), int(m[2]) if m[2] is not None else 1
            out.append((path, start, start + max(count - 1, 0)))
    return out


def diff_hunks(diffs: DataFrame, *keys: str, text: str = "diff") -> DataFrame:
    """(keys, file_path, start, end) of the hunks of diff texts."""
    return _rows_of(diffs, keys, text, parse_hunks, "file_path string, start int, end int")


def attribute_asof(defs: DataFrame, points: DataFrame, keys: list[str], *, def_at: str, def_id: str, point_at: str) -> DataFrame:
    """``points`` with the id of the definition that starts last at or before them under the same keys; others leave.

    A backward as-of join: both sides in one window, the last id seen counts.
    One shuffle by the keys; equal places put definitions first, and of these
    the largest id last.
    """
    columns = [c for c in points.columns if c not in keys]
    payload = F.struct(*[F.col(c) for c in columns])
    left = defs.select(*keys, F.col(def_at).alias("_at"), F.lit(0).alias("_side"), F.col(def_id).alias("_id"))
    right = points.select(*keys, F.col(point_at).alias("_at"), F.lit(1).alias("_side"), payload.alias("_row"))
    both = left.unionByName(right, allowMissingColumns=True)
    order = Window.partitionBy(*keys).orderBy("_at", "_side", "_id").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("_last", F.last("_id", ignorenulls=True).over(order)).where("_side = 1 and _last is not null")
    return seen.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in columns], F.col("_last").alias(def_id))


def resolve_calls(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """(project_id, caller_id, callee_id, how): call sites resolved in the same file, else by a name unique in the project.

    ``calls`` has project_id, file_path, caller_id, callee_name; ``functions``
    project_id, file_path, name, id. In a file the last definition of a name
    counts (largest id). Calls of itself and unresolved calls leave; equal calls
    stay apart. A name that a third of all calls use is one key of the second
    join; the definitions are copied to ``SALTS`` salts, over which the calls
    spread.
    """
    local = functions.groupBy("project_id", "file_path", F.col("name").alias("callee_name")).agg(F.max("id").alias("local_id"))
    unique = functions.groupBy("project_id", F.col("name").alias("callee_name")).agg(F.count_distinct("id").alias("n"), F.first("id").alias("unique_id")).where("n = 1").drop("n")
    salted = unique.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    spread = calls.withColumn("_salt", F.pmod(F.xxhash64("file_path", "caller_id"), F.lit(SALTS)).cast("int"))
    first = spread.join(local, ["project_id", "file_path", "callee_name"], "left").join(salted, ["project_id", "callee_name", "_salt"], "left")
    callee = F.coalesce("local_id", "unique_id")
    how = F.when(F.col("local_id").isNotNull(), "file").otherwise("project")
    return first.select("project_id", "caller_id", callee.alias("callee_id"), how.alias("how")).where("callee_id is not null and callee_id <> caller_id")


def upsert(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with the same keys."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def latest_by(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The last row by ``order`` of each key: the state after upserts in that order."""
    rest = [c for c in rows.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(*order)).alias("last")
    return rows.groupBy(*keys).agg(last).select(*keys, *[F.col(f"last.{c}").alias(c) for c in rest])


def chunk_text(lines: Column, start: Column, end: Column) -> Column:
    """Lines start..end (from 1) joined, at most CHUNK_CHARACTERS characters."""
    return F.substring(F.array_join(F.slice(lines, start, F.greatest(end - start + 1, F.lit(0))), "\n"), 1, CHUNK_CHARACTERS)


@dataclass
class IndexedTree:
    """The tables of one build."""

    nodes: DataFrame
    edges: DataFrame
    contents: DataFrame
    chunks: DataFrame


def index_files(files: DataFrame, project_id: str | None = "local") -> IndexedTree:
    """Graph tables of (file_path, content, language) rows: nodes, DEFINES, CONTAINS and CALLS edges, contents, chunks.

    Of many projects at once if ``project_id`` is None: then the rows have one
    each, and so have the tables; the plan is the same, keyed by project and path.

    Ids are hashes of the qualified name, so equal trees give equal ids. Files
    with a line above 2,000 bytes give definitions but no calls. Of definitions
    with the same name on one row the later kind counts.
    """
    owner = F.col("project_id") if project_id is None else F.lit(project_id)
    files = files.select("file_path", F.coalesce("content", F.lit("")).alias("content"), "language", owner.alias("project_id"))
    key = lambda *parts: F.xxhash64(F.col("project_id"), F.concat(*parts))
    file_id = key(F.col("file_path"))
    file_nodes = files.select("project_id", file_id.alias("id"), F.lit("File").alias("kind"), F.col("file_path").alias("name"), F.col("file_path").alias("qualified_name"), "file_path", F.lit(0).alias("start_line"), F.lit(0).alias("end_line"))
    code = files.where(F.col("language").isNotNull())
    tags = extract_tags(code, "project_id", "file_path")
    qualified = F.concat("file_path", F.lit("::"), "name", F.lit("#"), F.col("start_row").cast("string"))
    defs = tags.where("category <> 'call'").withColumns({"qualified_name": qualified, "kind": F.when(F.col("category") == "function", "Function").otherwise("Type")})
    defs = latest_by(defs.select("project_id", "qualified_name", "kind", "name", "file_path", "start_row", "end_row", "seq"), ["project_id", "qualified_name"], "seq").withColumn("id", key(F.col("qualified_name")))
    def_nodes = defs.select("project_id", "id", "kind", "name", "qualified_name", "file_path", (F.col("start_row") + 1).alias("start_line"), (F.col("end_row") + 1).alias("end_line"))
    marked = extract_sections(files.where(is_markdown(F.col("file_path"))), "project_id", "file_path")
    position = Window.partitionBy("project_id", "file_path").orderBy("start_line")
    numbered = marked.withColumn("at", F.row_number().over(position) - 1).withColumn("qualified_name", F.concat("file_path", F.lit("::"), "name", F.lit("#"), F.col("start_line").cast("string"))).withColumn("id", key(F.col("qualified_name")))
    section_nodes = numbered.select("project_id", "id", F.lit("Section").alias("kind"), "name", "qualified_name", "file_path", "start_line", "end_line")
    nodes = file_nodes.unionByName(def_nodes).unionByName(section_nodes)
    defines = def_nodes.select("project_id", file_id.alias("src_id"), F.col("id").alias("dst_id"), F.lit("DEFINES").alias("kind"))
    parents = numbered.select("project_id", "file_path", F.col("at").alias("parent"), F.col("id").alias("src_id"))
    contains = numbered.where("parent is not null").join(parents, ["project_id", "file_path", "parent"]).select("project_id", "src_id", F.col("id").alias("dst_id"), F.lit("CONTAINS").alias("kind"))
    tops = numbered.where("parent is null").select("project_id", file_id.alias("src_id"), F.col("id").alias("dst_id"), F.lit("DEFINES").alias("kind"))
    plain = code.where(longest_line(F.col("content")) <= MINIFIED_LINE_BYTES).select("project_id", "file_path")
    sites = tags.where("category = 'call'").join(plain, ["project_id", "file_path"], "left_semi").select("project_id", "file_path", F.col("name").alias("callee_name"), "start_row")
    functions = defs.where("kind = 'Function'")
    owned = attribute_asof(functions.withColumn("caller_id", F.col("id")), sites, ["project_id", "file_path"], def_at="start_row", def_id="caller_id", point_at="start_row")
    calls = resolve_calls(owned, functions.select("project_id", "file_path", "name", "id")).select("project_id", F.col("caller_id").alias("src_id"), F.col("callee_id").alias("dst_id"), F.lit("CALLS").alias("kind"))
    lined = files.select("project_id", "file_path", text_lines(F.col("content")).alias("lines"))
    chunks = nodes.where("kind <> 'File'").join(lined, ["project_id", "file_path"]).select("project_id", F.col("id").alias("node_id"), "qualified_name", chunk_text(F.col("lines"), F.col("start_line"), F.col("end_line")).alias("chunk_text"))
    return IndexedTree(nodes, defines.unionByName(contains).unionByName(tops).unionByName(calls), files.select("project_id", "file_path", "content"), chunks)


def add_references(edges: DataFrame, nodes: DataFrame, references: DataFrame, *keys: str) -> DataFrame:
    """``edges`` with CALLS_RESOLVED rows for resolved references (keys, line, callee_id): the first node that encloses the line calls."""
    from kelpgraph.operators.graph import first_enclosing

    keys = keys or ("file_path",)
    callers = first_enclosing(nodes.where("kind <> 'File'"), references, *keys)
    found = references.join(callers, [*keys, "line"]).select(F.col("node_id").alias("src_id"), F.col("callee_id").alias("dst_id"), F.lit("CALLS_RESOLVED").alias("kind"))
    return edges.unionByName(found.distinct(), allowMissingColumns=True)


def embed_chunks(chunks: DataFrame, embedder: Callable[[list[str]], list[list[float]]], model: str, *, batch: int = 32) -> DataFrame:
    """(node_id, model, dim, chunk_text, embedding) of (node_id, chunk_text) rows, ``batch`` texts a call, order kept.

    A call that returns another number of vectors than texts is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            texts = rows.column(1).to_pylist()
            vectors: list[list[float]] = []
            for at in range(0, len(texts), batch):
                part = embedder(texts[at : at + batch])
                if len(part) != len(texts[at : at + batch]):
                    raise ValueError("the embedder returned another number of vectors than texts")
                vectors += part
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([model] * len(texts)), pa.array([len(v) for v in vectors], pa.int32()), rows.column(1), pa.array(vectors, pa.list_(pa.float32()))], names=["node_id", "model", "dim", "chunk_text", "embedding"])

    return chunks.select("node_id", "chunk_text").mapInArrow(run, "node_id long, model string, dim int, chunk_text string, embedding array<float>")


def hash_embedder(dim: int = 32) -> Callable[[list[str]], list[list[float]]]:
    """A deterministic embedder for tests: signed hashes of words."""

    def embed(texts: list[str]) -> list[list[float]]:
        from zlib import crc32

        out = []
        for text in texts:
            vector = [0.0] * dim
            for word in re.findall(r"\w+", (text or "").lower()):
                h = crc32(word.encode())
                vector[h % dim] += 1.0 if h & 1 << 20 else -1.0
            out.append(vector)
        return out

    return embed
