"""Queries of answers and of the projects' life, and of functions that the others only use inside, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kelpgraph.functions import text as X
from kelpgraph.functions.vector import cosine, usable
from kelpgraph.operators import answers, graph, ingest, lifecycle, registry, search
from kelpgraph.operators.files import line_window
from kelpgraph.queries.registry import _EDGES, _EMB, _FILES, _GOOD, _GRAPH, _NODES, _PROJECTS, _embeddings, _files, _graph, _nodes, _now, _projects, query
from kelpgraph.session import table
from kelpgraph.sources.languages import is_markdown, language_of
from kelpgraph.sources.scan import content_signature
from kelpgraph.streaming import changes

_NOW = "t AS (SELECT max(last_queried_unix) AS now FROM projects)"
_LINES = "lined AS (SELECT project_id, file_path, CASE WHEN right(c, 1) = chr(10) OR c = '' THEN x[1:len(x) - 1] ELSE x END AS x FROM (SELECT project_id, file_path, replace(content, chr(13) || chr(10), chr(10)) AS c, string_split(replace(content, chr(13) || chr(10), chr(10)), chr(10)) AS x FROM files))"


def _hub(spark: SparkSession, d: str) -> str:
    """The name of the function that calls the most different nodes, ties by the first name: a start that reaches far."""
    g = _graph(spark, d)
    starts = g.nodes.where("kind = 'Function'").select(F.col("id").alias("src_id"), "name")
    return g.calls().join(starts, "src_id").groupBy("name").agg(F.count_distinct("dst_id").alias("n")).orderBy(F.desc("n"), "name").first()["name"]


_HUB = "(SELECT name FROM calls c JOIN nodes_u n ON n.id = c.src_id WHERE n.kind = 'Function' GROUP BY name ORDER BY count(DISTINCT c.dst_id) DESC, name LIMIT 1)"


def _reach(near: str, far: str, depth: int) -> str:
    """Levels by name of the hub; each node at its least depth."""
    return f"""starts AS (SELECT id FROM nodes_u WHERE kind = 'Function' AND name = {_HUB}), hops AS (SELECT DISTINCT * FROM calls),
reach AS (SELECT id, 0 AS depth FROM starts UNION SELECT c.{far}, r.depth + 1 FROM reach r JOIN hops c ON c.{near} = r.id WHERE r.depth < {depth})"""


@query(f"WITH RECURSIVE {_GRAPH}, {_reach('src_id', 'dst_id', 4)} SELECT n.id, n.name, min(r.depth) AS depth FROM reach r JOIN nodes_u n ON n.id = r.id WHERE r.id NOT IN (SELECT id FROM starts) GROUP BY ALL")
def trace_hub(spark: SparkSession, d: str) -> DataFrame:
    return graph.trace_calls(_graph(spark, d), _hub(spark, d), depth=4).select("id", "name", "depth")


@query(f"WITH RECURSIVE {_GRAPH}, {_reach('dst_id', 'src_id', 4)} SELECT n.id, n.name, min(r.depth) AS depth FROM reach r JOIN nodes_u n ON n.id = r.id WHERE r.id NOT IN (SELECT id FROM starts) GROUP BY ALL")
def trace_hub_inbound(spark: SparkSession, d: str) -> DataFrame:
    return graph.trace_calls(_graph(spark, d), _hub(spark, d), inbound=True, depth=4).select("id", "name", "depth")


@query(f"WITH RECURSIVE {_GRAPH}, {_reach('src_id', 'dst_id', 3)}, a AS (SELECT n.*, min(r.depth) AS depth FROM reach r JOIN nodes_u n ON n.id = r.id WHERE r.id NOT IN (SELECT id FROM starts) GROUP BY ALL) SELECT kind, name, qualified_name, file_path AS file, start_line, end_line, depth, (SELECT count(*) FROM a) AS total, least((SELECT count(*) FROM a), 200) AS shown FROM a ORDER BY depth, id LIMIT 200")
def trace_answer(spark: SparkSession, d: str) -> DataFrame:
    """A trace as its tool answers: 500 nodes asked for, 200 given at most, with the total."""
    found = graph.trace_calls(_graph(spark, d), _hub(spark, d), depth=3)
    best = answers.bounded_answer(found, ["depth", "id"], limit=500)
    return best.select("kind", "name", "qualified_name", F.col("file_path").alias("file"), "start_line", "end_line", "depth", "total", "shown")


@query(f"WITH {_NODES}, a AS (SELECT * FROM nodes_u WHERE lower(name) LIKE '%or%') SELECT kind, name, qualified_name, file_path AS file, start_line, end_line, (SELECT count(*) FROM a) AS total, least((SELECT count(*) FROM a), 50) AS shown FROM a ORDER BY name, id LIMIT 50")
def search_answer(spark: SparkSession, d: str) -> DataFrame:
    found = answers.bounded_answer(search.search_by_name(_nodes(spark, d), "or", limit=None), ["name", "id"], limit=50)
    return found.select("kind", "name", "qualified_name", F.col("file_path").alias("file"), "start_line", "end_line", "total", "shown")


_CUT = "left(chunk_text, list_max([n for n in range(0, 1001) if strlen(left(chunk_text, n)) <= 1000])::INT)"


@query(f"""WITH {_EMB}, {_NODES}, good AS (SELECT * FROM emb WHERE model = 'marrow-code-v2' AND embedding IS NOT NULL AND {_GOOD}), q AS (SELECT arg_min(embedding, node_id) AS v FROM good),
s AS (SELECT n.id, n.kind, n.name, n.qualified_name, n.file_path AS file, round(list_dot_product(g.embedding::DOUBLE[], v::DOUBLE[]) / (sqrt(list_dot_product(g.embedding::DOUBLE[], g.embedding::DOUBLE[])) * sqrt(list_dot_product(v::DOUBLE[], v::DOUBLE[]))), 6) AS score, g.chunk_text FROM good g JOIN nodes_u n ON n.id = g.node_id, q)
SELECT id, kind, name, qualified_name, file, score, md5({_CUT}) AS text_md5, strlen(chunk_text) > 1000 AS chunk_truncated, (SELECT count(*) FROM s) AS total, 30 AS shown FROM s ORDER BY score DESC, id LIMIT 30""")
def semantic_answer(spark: SparkSession, d: str) -> DataFrame:
    """A search by meaning end to end: the current vectors of a model, scores, nodes, texts cut to 1,000 bytes, 30 at most."""
    rows = _embeddings(spark, d).where((F.col("model") == "marrow-code-v2") & F.col("embedding").isNotNull()).where(usable(F.col("embedding"), F.col("dim")))
    asked = F.broadcast(rows.agg(F.min_by("embedding", "node_id").alias("v")))  # one row
    scored = rows.crossJoin(asked).select(F.col("node_id").alias("id"), "chunk_text", F.round(cosine(F.col("embedding"), F.col("v")), 6).alias("score"))
    best = answers.hit_answer(scored.join(_nodes(spark, d), "id"), limit=100)
    return best.select("id", "kind", "name", "qualified_name", "file", "score", F.md5("chunk_text").alias("text_md5"), "chunk_truncated", "total", F.col("shown").cast("int").alias("shown"))


@query(f"WITH {_NODES} SELECT '{{\"file_path\":' || to_json(file_path) || ',\"id\":' || id || ',\"kind\":' || to_json(kind) || ',\"start_line\":' || start_line || '}}' AS json FROM nodes_u")
def json_rows(spark: SparkSession, d: str) -> DataFrame:
    return answers.as_json(_nodes(spark, d).select("kind", "id", "start_line", "file_path"))


@query(f"WITH {_FILES}, {_LINES} SELECT project_id, file_path, CASE WHEN len(x) > 300 THEN '... lines 1-300 of ' || len(x) || ' shown, ask for a range to see more' END AS note FROM lined")
def window_notes(spark: SparkSession, d: str) -> DataFrame:
    return answers.window_note(line_window(_files(spark, d), "project_id", "file_path")).select("project_id", "file_path", "note")


@query(f"WITH {_FILES}, {_LINES} SELECT project_id, file_path, least(39, len(x))::INT + 1 AS first_line, least(339, len(x))::INT AS last_line, len(x) > 339 AND false AS more, md5(array_to_string(x[40:339], chr(10))) AS text_md5 FROM lined")
def file_from_line(spark: SparkSession, d: str) -> DataFrame:
    """From line 40 on: one bound gives 300 lines."""
    found = line_window(_files(spark, d), "project_id", "file_path", start=40)
    return found.select("project_id", "file_path", "first_line", "last_line", F.col("truncated").alias("more"), F.md5("text").alias("text_md5"))


@query(f"WITH {_FILES}, {_LINES} SELECT project_id, file_path, least(350, len(x))::INT AS last_line, md5(array_to_string(x[greatest(least(350, len(x)) - 300, 0) + 1:least(350, len(x))], chr(10))) AS text_md5 FROM lined")
def file_to_line(spark: SparkSession, d: str) -> DataFrame:
    found = line_window(_files(spark, d), "project_id", "file_path", end=350)
    return found.select("project_id", "file_path", "last_line", F.md5("text").alias("text_md5"))


@query(f"WITH {_FILES}, {_LINES} SELECT project_id, file_path, len(x)::INT AS last_line, md5(array_to_string(x, chr(10))) AS text_md5 FROM lined WHERE len(x) <= 4000 AND strlen(array_to_string(x, chr(10))) <= 300000")
def file_whole(spark: SparkSession, d: str) -> DataFrame:
    """Files that fit one answer, whole."""
    found = line_window(_files(spark, d), "project_id", "file_path", full=True).where(~F.col("truncated"))
    return found.select("project_id", "file_path", "last_line", F.md5("text").alias("text_md5"))


@query(f"SELECT doc_id, md5(left(text, list_max([n for n in range(0, 1001) if strlen(left(text, n)) <= 1000])::INT)) AS text_md5, strlen(text) > 1000 AS truncated FROM documents WHERE text IS NOT NULL")
def byte_truncate(spark: SparkSession, d: str) -> DataFrame:
    cut = table(spark, d, "documents").where("text is not null").select("doc_id", X.byte_truncate(F.col("text")).alias("t"))
    return cut.select("doc_id", F.md5("t.text").alias("text_md5"), "t.truncated")


@query("SELECT id, md5(left(chunk_text, 6000)) AS text_md5 FROM (SELECT DISTINCT id, chunk_text FROM node_embeddings)")
def chunk_limit(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "node_embeddings").select("id", "chunk_text").distinct().select("id", F.md5(X.chunk_truncate(F.col("chunk_text"))).alias("text_md5"))


@query(f"WITH {_FILES}, {_LINES}, {_NODES} SELECT id, md5(left(array_to_string(x[start_line:end_line], chr(10)), 6000)) AS text_md5 FROM nodes_u JOIN lined USING (project_id, file_path) WHERE kind <> 'File' AND end_line IS NOT NULL")
def node_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The text of each node, cut from the lines of its file."""
    lined = _files(spark, d).select("project_id", "file_path", X.text_lines(F.col("content")).alias("lines"))
    rows = _nodes(spark, d).where("kind <> 'File' and end_line is not null").join(lined, ["project_id", "file_path"])
    return rows.select("id", F.md5(ingest.chunk_text(F.col("lines"), F.col("start_line"), F.col("end_line"))).alias("text_md5"))


@query(f"WITH {_NODES} SELECT id, CASE WHEN kind = 'Section' THEN 'markdown' ELSE coalesce(CASE string_split(file_path, '.')[-1] WHEN 'rs' THEN 'rust' WHEN 'py' THEN 'python' WHEN 'js' THEN 'javascript' WHEN 'mjs' THEN 'javascript' WHEN 'cjs' THEN 'javascript' WHEN 'ts' THEN 'typescript' WHEN 'go' THEN 'go' WHEN 'java' THEN 'java' WHEN 'c' THEN 'c' WHEN 'h' THEN 'c' WHEN 'cs' THEN 'csharp' WHEN 'rb' THEN 'ruby' WHEN 'php' THEN 'php' END, '') END AS tag FROM nodes_u")
def fence_tags(spark: SparkSession, d: str) -> DataFrame:
    return _nodes(spark, d).select("id", X.fence_language(F.col("kind"), F.col("file_path")).alias("tag"))


@query("""SELECT DISTINCT doc_id, replace(replace(left(text, 200), chr(92), chr(92) || chr(92)), chr(34), chr(92) || chr(34)) AS label FROM documents WHERE text IS NOT NULL""")
def dot_labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", X.dot_escape(F.substring("text", 1, 200)).alias("label")).distinct()


@query(f"WITH {_FILES} SELECT project_id, file_path FROM files WHERE lower(string_split(file_path, '.')[-1]) IN ('md', 'markdown') AND contains(file_path, '.')")
def markdown_files(spark: SparkSession, d: str) -> DataFrame:
    return _files(spark, d).where(is_markdown(F.col("file_path"))).select("project_id", "file_path")


@query(f"WITH {_PROJECTS}, {_NOW}, a AS (SELECT hash, now - x.li AS s FROM p, t WHERE x.li IS NOT NULL) SELECT hash, CASE WHEN greatest(s, 0) < 60 THEN greatest(s, 0) || 's' WHEN s < 3600 THEN (s // 60) || 'm' WHEN s < 86400 THEN (s // 3600) || 'h' ELSE (s // 86400) || 'd' END AS age FROM a")
def index_ages(spark: SparkSession, d: str) -> DataFrame:
    return _projects(spark, d).where("last_indexed_unix is not null").select("hash", X.format_age(F.lit(_now(spark, d)) - F.col("last_indexed_unix")).alias("age"))


@query("SELECT project_id, count(*) AS files, sum(strlen(content))::BIGINT AS bytes FROM file_contents WHERE project_id IS NOT NULL GROUP BY 1")
def stored_bytes(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.stored_bytes(table(spark, d, "file_contents").where("project_id is not null"), "project_id")


@query(f"WITH {_PROJECTS}, {_NOW} SELECT count(*) AS projects, count(*) FILTER (coalesce(x.li, 0) <> 0) AS indexed, count(*) FILTER (coalesce(x.lq, 0) <> 0 AND greatest(now - x.lq, 0) <= 172800) AS warm, coalesce(sum(x.ok), 0)::BIGINT AS rebuilds, coalesce(sum(x.bad), 0)::BIGINT AS failures, 4096 AS budget FROM p, t")
def status(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.status(_projects(spark, d), F.lit(_now(spark, d)), 172_800, registry.watch_budget(8192))


def _touches(spark: SparkSession, d: str) -> DataFrame:
    """Every recorded search touches its project."""
    return table(spark, d, "search_hits").where("project_id is not null").select(F.col("project_id").alias("hash"), F.unix_timestamp("searched_at").alias("at"))


@query(f"WITH {_PROJECTS}, h AS (SELECT project_id AS hash, max(epoch(searched_at)::BIGINT) AS a FROM search_hits WHERE project_id IS NOT NULL GROUP BY 1) SELECT hash, CASE WHEN h.a IS NULL THEN x.lq WHEN x.lq IS NULL THEN h.a ELSE greatest(x.lq, h.a) END AS last_queried_unix FROM p LEFT JOIN h USING (hash)")
def touch_queried(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.touch_queried(_projects(spark, d), _touches(spark, d)).select("hash", "last_queried_unix")


@query(f"WITH {_PROJECTS}, {_NOW} SELECT hash FROM p, t WHERE hash IN (SELECT project_id FROM search_hits) AND NOT (coalesce(x.lq, 0) <> 0 AND greatest(now - coalesce(x.lq, 0), 0) <= 172800)")
def cold_projects(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.cold_projects(_projects(spark, d), _touches(spark, d), F.lit(_now(spark, d)), 172_800).select("hash")


@query(f"WITH {_PROJECTS}, r AS (SELECT project_id AS hash, count(*) FILTER (finished_at IS NOT NULL) AS ok, count(*) FILTER (finished_at IS NULL) AS bad, sum(CASE WHEN finished_at IS NOT NULL THEN (epoch_us(finished_at) - epoch_us(started_at)) // 1000 ELSE 0 END)::BIGINT AS ms FROM (SELECT DISTINCT * FROM index_runs) GROUP BY 1) SELECT hash, coalesce(x.ok, 0) + coalesce(r.ok, 0) AS auto_reindex_count, coalesce(x.bad, 0) + coalesce(r.bad, 0) AS auto_reindex_fail_count, coalesce(x.ms, 0) + coalesce(r.ms, 0) AS auto_reindex_total_ms FROM p LEFT JOIN r USING (hash)")
def record_rebuilds(spark: SparkSession, d: str) -> DataFrame:
    """The registry's counters with every recorded run added as an automatic rebuild."""
    spent = F.expr("(unix_micros(cast(finished_at as timestamp)) - unix_micros(cast(started_at as timestamp))) div 1000")
    runs = table(spark, d, "index_runs").distinct().select(F.col("project_id").alias("hash"), F.col("finished_at").isNotNull().alias("ok"), spent.alias("millis"))
    return lifecycle.record_rebuilds(_projects(spark, d), runs).select("hash", "auto_reindex_count", "auto_reindex_fail_count", "auto_reindex_total_ms")


_WATCH = "w AS (SELECT x.root_path AS path, max(coalesce(x.lq, 0)) AS last_queried FROM p GROUP BY 1)"


def _watched(spark: SparkSession, d: str) -> DataFrame:
    projects = _projects(spark, d)
    return lifecycle.last_queried(projects.select(F.col("root_path").alias("path")).distinct(), projects)


@query(f"WITH {_PROJECTS}, {_WATCH} SELECT path, last_queried FROM w")
def watch_last_queried(spark: SparkSession, d: str) -> DataFrame:
    return _watched(spark, d)


@query(f"WITH {_PROJECTS}, {_WATCH} SELECT path, last_queried FROM w ORDER BY last_queried, path LIMIT 1")
def least_recent(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.least_recent(_watched(spark, d))


@query(f"WITH {_PROJECTS}, {_WATCH}, g AS (SELECT path FROM w ORDER BY last_queried, path LIMIT 1), k AS (SELECT x.root_path AS path, coalesce(x.lq, 0) + 300 AS until FROM p UNION ALL SELECT path, 1000 + 300 FROM g) SELECT path, max(until) > 1000 AS cooling FROM k GROUP BY 1")
def eviction_cooldown(spark: SparkSession, d: str) -> DataFrame:
    """Which paths may not come back at second 1,000, after the least recent one was evicted then and each when it was queried last."""
    watched = _watched(spark, d)
    before = watched.select("path", (F.col("last_queried") + lifecycle.EVICTION_COOLDOWN).alias("until"))
    _, cooling = lifecycle.evict(watched, before, F.lit(1000))
    held = lifecycle.still_cooling(cooling, F.lit(1000)).withColumn("cooling", F.lit(True))
    return watched.select("path").join(held, "path", "left").select("path", F.coalesce("cooling", F.lit(False)).alias("cooling"))


@query("SELECT user_id, event_type, count(*) AS messages, max(ts) AS last_at FROM events GROUP BY 1, 2")
def backlog_drain(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.drained(table(spark, d, "events").withColumnRenamed("ts", "at"), "user_id", "event_type")


@query("WITH r AS (SELECT event_id, user_id, event_type, ts, floor(epoch(ts) / 86400)::BIGINT AS version FROM events) SELECT event_id, coalesce(lag(version) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = version, false) AS hit FROM r")
def response_cache(spark: SparkSession, d: str) -> DataFrame:
    """Requests answered from the cache if an index version lasts a day."""
    version = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 86_400)
    requests = table(spark, d, "events").select(F.col("event_id").alias("request"), "user_id", "event_type", F.col("ts").alias("at"), version.alias("version"))
    return lifecycle.cached_answers(requests, "user_id", "event_type").select(F.col("request").alias("event_id"), "hit")


@query(f"WITH {_PROJECTS}, {_NOW} SELECT hash, CASE WHEN coalesce(x.lq, 0) <> 0 AND greatest(now - coalesce(x.lq, 0), 0) <= 172800 THEN CASE WHEN starts_with(x.root_path, '/') THEN '/' ELSE '' END || array_to_string([q for q in string_split(x.root_path, '/') if q <> '' AND q <> '.'], '/') ELSE x.root_path END AS root_path FROM p, t")
def healed_roots(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.healed_roots(_projects(spark, d), F.lit(_now(spark, d)), 172_800).select("hash", "root_path")


@query("SELECT event_type AS name, count(*) AS calls, count(*) FILTER (event_type = 'error') AS errors, sum(strlen(props))::BIGINT AS bytes, round(sum(strlen(props)) / (SELECT sum(strlen(props)) FROM events), 6) AS share FROM events GROUP BY 1")
def session_tools(spark: SparkSession, d: str) -> DataFrame:
    calls = table(spark, d, "events").select(F.col("event_type").alias("name"), (F.col("event_type") == "error").alias("error"), F.octet_length("props").cast("long").alias("bytes"))
    return answers.session_usage(calls, "name").withColumn("share", F.round("share", 6))


@query("SELECT count(*) AS calls, count(*) FILTER (event_type = 'error') AS errors, sum(strlen(props))::BIGINT AS bytes, (sum(strlen(props)) // 4)::BIGINT AS tokens, 2500 AS schema_tokens FROM events")
def session_totals(spark: SparkSession, d: str) -> DataFrame:
    calls = table(spark, d, "events").select(F.col("event_type").alias("name"), (F.col("event_type") == "error").alias("error"), F.octet_length("props").cast("long").alias("bytes"))
    return answers.session_totals(answers.session_usage(calls, "name"), 10_000)


@query("SELECT DISTINCT tool AS name, tool = 'search_code' AS minimal, tool IN ('search_code', 'search_codebase') AS whole FROM search_hits WHERE tool IS NOT NULL")
def enabled_tools(spark: SparkSession, d: str) -> DataFrame:
    """The tools of past searches, and which of them the smallest and the largest preset have on."""
    catalog = table(spark, d, "search_hits").where("tool is not null").select(F.col("tool").alias("name")).distinct()
    on = lambda preset, column: answers.enabled_definitions(catalog, answers.resolved_tools(preset)).withColumn(column, F.lit(True))
    both = catalog.join(on("minimal", "minimal"), "name", "left").join(on("full", "whole"), "name", "left")
    return both.na.fill(False, ["minimal", "whole"])


@query("WITH RECURSIVE o AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE ts IS NOT NULL), g AS (SELECT user_id, event_id, n, t AS last, true AS passed FROM o WHERE n = 1 UNION ALL SELECT o.user_id, o.event_id, o.n, CASE WHEN o.t - g.last >= 21600 * 1000000::BIGINT THEN o.t ELSE g.last END, o.t - g.last >= 21600 * 1000000::BIGINT FROM g JOIN o ON o.user_id = g.user_id AND o.n = g.n + 1) SELECT user_id, event_id FROM g WHERE passed")
def cooldown_filter(spark: SparkSession, d: str) -> DataFrame:
    return registry.cooldown_filter(table(spark, d, "events").select("user_id", "event_id", "ts"), ["user_id"], "ts", 6 * 3600).select("user_id", "event_id")


@query("SELECT time_bucket(INTERVAL '1 day', ts) AS begin, event_type, count(*) AS events FROM events GROUP BY 1, 2")
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    """The windows of the stream operator over the whole table as one batch."""
    return changes.counted_windows(table(spark, d, "events"), ["event_type"], "ts", "1 day").select("begin", "event_type", "events")


@query("SELECT DISTINCT project_id, file_path, name, level, start_line, coalesce(end_line, -1) AS end_line FROM sections s WHERE EXISTS (SELECT 1 FROM file_contents f WHERE f.project_id = s.project_id AND f.file_path = s.file_path) AND end_line IS NOT NULL")
def section_spans(spark: SparkSession, d: str) -> DataFrame:
    """Headings with their last lines, of the stored sections that have one."""
    found = ingest.extract_sections(_files(spark, d).where(is_markdown(F.col("file_path"))), "project_id", "file_path")
    keys = ["project_id", "file_path", "name", "level", "start_line"]
    stored = table(spark, d, "sections").where("end_line is not null").select(*keys, F.col("end_line").alias("stored")).distinct()
    # a stored end past the last line means the last line
    both = found.join(stored, keys)
    return both.select(*keys, F.when(F.col("stored") > F.col("end_line"), F.col("stored")).otherwise(F.col("end_line")).alias("end_line"))


@query(f"WITH {_NODES}, {_FILES} SELECT DISTINCT n.project_id, n.file_path, n.kind, n.name, n.start_line, n.end_line FROM nodes_u n JOIN files f USING (project_id, file_path) WHERE n.kind IN ('Function', 'Type') AND n.end_line IS NOT NULL")
def tag_spans(spark: SparkSession, d: str) -> DataFrame:
    """First and last line of every definition found in the current files, where the stored node has a last line."""
    files = _files(spark, d).withColumn("language", language_of(F.col("file_path"))).where("language is not null")
    tags = ingest.extract_tags(files, "project_id", "file_path").where("category <> 'call'")
    kind = F.when(F.col("category") == "function", "Function").otherwise("Type")
    found = tags.select("project_id", "file_path", kind.alias("kind"), "name", (F.col("start_row") + 1).alias("start_line"), (F.col("end_row") + 1).alias("end_line"))
    known = _nodes(spark, d).where("end_line is not null").select("project_id", "file_path", "kind", "name", "start_line")
    return found.join(known, ["project_id", "file_path", "kind", "name", "start_line"], "left_semi").distinct()


@query("SELECT DISTINCT s.project_id, s.file_path, s.start_line, p.start_line AS parent_line FROM sections s LEFT JOIN sections p ON p.section_id = s.parent_id WHERE EXISTS (SELECT 1 FROM file_contents f WHERE f.project_id = s.project_id AND f.file_path = s.file_path)")
def section_parents(spark: SparkSession, d: str) -> DataFrame:
    """The heading above each heading, by its line."""
    found = ingest.extract_sections(_files(spark, d).where(is_markdown(F.col("file_path"))), "project_id", "file_path")
    place = F.row_number().over(Window.partitionBy("project_id", "file_path").orderBy("start_line")) - 1
    above = found.select("project_id", "file_path", place.alias("parent"), F.col("start_line").alias("parent_line"))
    return found.join(above, ["project_id", "file_path", "parent"], "left").select("project_id", "file_path", "start_line", "parent_line")


@query(f"WITH {_FILES} SELECT project_id, count(*) AS files, true AS same_in_any_order, true AS moves FROM files GROUP BY 1")
def content_signatures(spark: SparkSession, d: str) -> DataFrame:
    """A signature is the same for the same files in any order, and another one if a size changes."""
    files = _files(spark, d).select("project_id", "file_path", F.octet_length("content").alias("length"), F.col("indexed_at").alias("modified"))
    last = F.row_number().over(Window.partitionBy("project_id").orderBy(F.desc("file_path"))) == 1
    grown = files.withColumn("length", F.when(last, F.col("length") + 1).otherwise(F.col("length")))
    one, two, other = (content_signature(x, "project_id") for x in (files, files.orderBy(F.desc("file_path")), grown))
    both = one.join(two.select("project_id", F.col("signature").alias("again")), "project_id").join(other.select("project_id", F.col("signature").alias("grown")), "project_id")
    return both.select("project_id", "files", (F.col("signature") == F.col("again")).alias("same_in_any_order"), (F.col("signature") != F.col("grown")).alias("moves"))


_TAG = "CASE WHEN kind = 'Section' THEN 'markdown' ELSE coalesce(CASE string_split(file_path, '.')[-1] WHEN 'rs' THEN 'rust' WHEN 'py' THEN 'python' WHEN 'js' THEN 'javascript' WHEN 'mjs' THEN 'javascript' WHEN 'cjs' THEN 'javascript' WHEN 'ts' THEN 'typescript' WHEN 'go' THEN 'go' WHEN 'java' THEN 'java' WHEN 'c' THEN 'c' WHEN 'h' THEN 'c' WHEN 'cs' THEN 'csharp' WHEN 'rb' THEN 'ruby' WHEN 'php' THEN 'php' END, '') END"
_LINK = "regexp_replace(q, '[^\\p{L}\\p{N}_-]', '_', 'g')"


@query(f"""WITH {_GRAPH}, {_EMB}, k AS (SELECT node_id AS id, arg_min(chunk_text, model) AS chunk_text FROM emb GROUP BY 1), c AS (SELECT DISTINCT * FROM calls),
o AS (SELECT id, string_agg('- [[' || {_LINK} || ']]', chr(10) ORDER BY q) AS x FROM (SELECT DISTINCT c.src_id AS id, n.qualified_name AS q FROM c JOIN nodes_u n ON n.id = c.dst_id) GROUP BY 1),
i AS (SELECT id, string_agg('- [[' || {_LINK} || ']]', chr(10) ORDER BY q) AS x FROM (SELECT DISTINCT c.dst_id AS id, n.qualified_name AS q FROM c JOIN nodes_u n ON n.id = c.src_id) GROUP BY 1)
SELECT n.id, md5('# ' || name || chr(10) || chr(10) || kind || ' in `' || file_path || '`, lines ' || start_line || '-' || coalesce(end_line, start_line) || chr(10) || coalesce(chr(10) || '```' || {_TAG} || chr(10) || chunk_text || chr(10) || '```' || chr(10), '') || coalesce(chr(10) || '## Calls' || chr(10) || chr(10) || o.x || chr(10), '') || coalesce(chr(10) || '## Called by' || chr(10) || chr(10) || i.x || chr(10), '')) AS note_md5
FROM nodes_u n LEFT JOIN k USING (id) LEFT JOIN o USING (id) LEFT JOIN i USING (id) WHERE kind <> 'File'""")
def call_notes(spark: SparkSession, d: str) -> DataFrame:
    chunks = _embeddings(spark, d).groupBy(F.col("node_id").alias("id")).agg(F.min_by("chunk_text", "model").alias("chunk_text"))
    return graph.call_notes(_graph(spark, d), chunks).select("id", F.md5("note").alias("note_md5"))


@query(f"WITH {_NODES}, {_FILES} SELECT DISTINCT n.project_id, n.file_path, n.kind, n.name, n.start_line FROM nodes_u n JOIN files f USING (project_id, file_path) WHERE n.kind IN ('Function', 'Type', 'Section', 'File')")
def index_nodes(spark: SparkSession, d: str) -> DataFrame:
    """The whole build over all current files, every project at once: those of its nodes that the store lists."""
    files = _files(spark, d).withColumn("language", language_of(F.col("file_path")))
    nodes = ingest.index_files(files, None).nodes
    stored = _nodes(spark, d)
    # bundles hold more functions than the store lists, so what is compared is what it lists
    keys = ["project_id", "file_path", "kind", "name", "start_line"]
    return nodes.join(stored.select(*keys), keys, "left_semi").select(*keys).distinct()


@query(f"WITH {_FILES}, old AS (SELECT project_id, file_path, arg_min(content, (indexed_at, run_id)) AS content FROM file_contents GROUP BY 1, 2) SELECT project_id, file_path, length(f.content) AS characters FROM old o JOIN files f USING (project_id, file_path)")
def upsert_rows(spark: SparkSession, d: str) -> DataFrame:
    """First versions with the current ones upserted over them."""
    contents = table(spark, d, "file_contents")
    keys = ["project_id", "file_path"]
    old = contents.groupBy(*keys).agg(F.min_by("content", F.struct("indexed_at", "run_id")).alias("content"))
    return ingest.upsert(old, _files(spark, d).select(*keys, "content"), *keys).select(*keys, F.length("content").alias("characters"))


@query(f"WITH {_NODES}, {_EDGES}, r AS (SELECT DISTINCT file_path, project_id, start_line + 1 AS line, id AS callee_id FROM nodes_u WHERE kind = 'Type'), c AS (SELECT r.project_id, r.file_path, r.line, min(n.id) AS node_id FROM r JOIN nodes_u n USING (project_id, file_path) WHERE n.kind <> 'File' AND n.start_line <= r.line AND r.line <= coalesce(n.end_line, n.start_line) GROUP BY 1, 2, 3) SELECT DISTINCT node_id AS src_id, callee_id AS dst_id FROM r JOIN c USING (project_id, file_path, line)")
def resolved_references(spark: SparkSession, d: str) -> DataFrame:
    """Edges of references that a language process found, here one inside each type."""
    nodes = _nodes(spark, d)
    references = nodes.where("kind = 'Type'").select("project_id", "file_path", (F.col("start_line") + 1).alias("line"), F.col("id").alias("callee_id"))
    none = spark.createDataFrame([], "src_id long, dst_id long, kind string")
    return ingest.add_references(none, nodes, references, "project_id", "file_path").select("src_id", "dst_id")


@query(f"WITH RECURSIVE {_GRAPH}, {_reach('src_id', 'dst_id', 2)}, starts2 AS (SELECT id FROM starts), back AS (SELECT id, 0 AS depth FROM starts2 UNION SELECT c.src_id, r.depth + 1 FROM back r JOIN hops c ON c.dst_id = r.id WHERE r.depth < 2), ids AS (SELECT id FROM reach UNION SELECT id FROM back), known AS (SELECT n.id, n.name FROM ids JOIN nodes_u n USING (id)) SELECT 0 AS part, id AS src_id, NULL::BIGINT AS dst_id, '  n' || id || ' [label=\"' || name || '\"];' AS line FROM known UNION ALL SELECT 1, src_id, dst_id, '  n' || src_id || ' -> n' || dst_id || ';' FROM hops WHERE src_id IN (SELECT id FROM known) AND dst_id IN (SELECT id FROM known)")
def call_dot(spark: SparkSession, d: str) -> DataFrame:
    return graph.call_dot_lines(_graph(spark, d), _hub(spark, d), depth=2)


def _stream(spark: SparkSession, d: str) -> DataFrame:
    """The events table as a stream of files; the pattern also names a table of one file."""
    rows = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/[e]vents.parquet")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT time_bucket(INTERVAL '1 day', ts) AS begin, event_type, count(*) AS events FROM events GROUP BY 1, 2")
def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """The events read as a stream, counted in windows of a day."""
    found = changes.run_available(changes.counted_windows(_stream(spark, d), ["event_type"], "ts", "1 day"), "complete")
    return found.select("begin", "event_type", "events")


@query("WITH RECURSIVE o AS (SELECT user_id AS path, epoch_us(ts) // 1000000 AS t, length(event_type) AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, length(event_type)) AS n FROM events WHERE ts IS NOT NULL), g AS (SELECT path, n, t AS last, s AS seen, true AS passed FROM o WHERE n = 1 UNION ALL SELECT o.path, o.n, CASE WHEN o.t - g.last >= 3600 AND o.s <> g.seen THEN o.t ELSE g.last END, CASE WHEN o.t - g.last >= 3600 AND o.s <> g.seen THEN o.s ELSE g.seen END, o.t - g.last >= 3600 AND o.s <> g.seen FROM g JOIN o ON o.path = g.path AND o.n = g.n + 1) SELECT path::VARCHAR AS path, count(*) AS passed, max(last) AS last FROM g WHERE passed GROUP BY 1")
def stream_gate(spark: SparkSession, d: str) -> DataFrame:
    """The events read as a stream through the gate: no change within an hour of the last one, nor with its signature."""
    events = _stream(spark, d).where("ts is not null").select(F.col("user_id").cast("string").alias("path"), F.col("ts").cast("timestamp").alias("at"), F.length("event_type").cast("long").alias("signature"))
    passed = changes.run_available(changes.gated_changes(events, 3600, forget=10 * 365 * 86_400))
    return passed.groupBy("path").agg(F.count("*").alias("passed"), F.max(F.unix_seconds("at")).alias("last"))
