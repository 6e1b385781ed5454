"""All queries of the graph engine over the driver's tables, each with the SQL it is checked against where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kelpgraph.functions import text as X
from kelpgraph.functions.vector import cosine, usable
from kelpgraph.model import PropertyGraph
from kelpgraph.operators import graph as G
from kelpgraph.operators import ingest, registry, search
from kelpgraph.operators.files import line_window
from kelpgraph.plans.pattern import pattern_query
from kelpgraph.plans.router import keyword_search
from kelpgraph.session import table
from kelpgraph.sources.languages import language_of

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_NODES = "nodes_u AS (SELECT DISTINCT ON (id) * FROM nodes WHERE id IS NOT NULL ORDER BY id)"
_EDGES = "edges_u AS (SELECT src_id, dst_id, upper(trim(kind)) AS kind, project_id FROM edges WHERE kind IS NOT NULL AND src_id IS NOT NULL AND dst_id IS NOT NULL)"
_CALLS = "calls AS (SELECT src_id, dst_id FROM edges_u WHERE kind IN ('CALLS', 'CALLS_RESOLVED'))"
_GRAPH = f"{_NODES}, {_EDGES}, {_CALLS}"
_FILES = "files AS (SELECT project_id, file_path, arg_max(content, (indexed_at, run_id)) AS content, arg_max(run_id, (indexed_at, run_id)) AS run_id FROM file_contents GROUP BY 1, 2)"
_EMB = "emb AS (SELECT DISTINCT ON (node_id, model) * FROM node_embeddings ORDER BY node_id, model, embedded_at DESC, id DESC)"
_GOOD = "len(embedding) = dim AND len([x for x in embedding if x IS NULL OR isnan(x)]) = 0 AND len([x for x in embedding if x <> 0]) > 0"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name."""

    def add(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return add


def _graph(spark: SparkSession, d: str) -> PropertyGraph:
    return PropertyGraph.of(table(spark, d, "nodes"), table(spark, d, "edges"))


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nodes").where("id is not null").dropDuplicates(["id"])


def _files(spark: SparkSession, d: str) -> DataFrame:
    return ingest.latest_by(table(spark, d, "file_contents"), ["project_id", "file_path"], "indexed_at", "run_id")


def _embeddings(spark: SparkSession, d: str) -> DataFrame:
    return search.current_embeddings(table(spark, d, "node_embeddings"))


def _first_function(spark: SparkSession, d: str) -> str:
    """The first function name, a parameter for traces."""
    return _nodes(spark, d).where("kind = 'Function'").agg(F.min("name")).first()[0]


# --- graph -----------------------------------------------------------------


@query(f"WITH {_GRAPH} SELECT DISTINCT a.id, a.kind, a.name, a.qualified_name, a.file_path, a.start_line, a.end_line FROM nodes_u a JOIN edges_u e ON a.id = e.src_id JOIN nodes_u b ON b.id = e.dst_id WHERE a.kind = 'Function' AND b.kind = 'Function' AND e.kind = 'CALLS'")
def pattern_match(spark: SparkSession, d: str) -> DataFrame:
    return pattern_query(_graph(spark, d), "MATCH (a:Function)-[:CALLS]->(b:Function) RETURN a")


@query(f"WITH {_GRAPH} SELECT DISTINCT b.id, b.kind, b.name, b.qualified_name, b.file_path, b.start_line, b.end_line FROM nodes_u a JOIN edges_u e ON a.id = e.src_id JOIN nodes_u b ON b.id = e.dst_id WHERE a.kind = 'File' AND b.kind = 'Type' AND e.kind = 'DEFINES' ORDER BY b.id LIMIT 200")
def pattern_limit(spark: SparkSession, d: str) -> DataFrame:
    return pattern_query(_graph(spark, d), "match (f:file)-[:defines]->(t:type) return t", limit=200)


@query(f"WITH {_GRAPH}, n AS (SELECT min(name) AS x FROM nodes_u WHERE kind = 'Function') SELECT DISTINCT a.id, a.kind, a.name, a.qualified_name, a.file_path, a.start_line, a.end_line FROM nodes_u a JOIN edges_u e ON a.id = e.src_id JOIN nodes_u b ON b.id = e.dst_id, n WHERE a.kind = 'File' AND b.kind = 'Function' AND e.kind = 'DEFINES' AND b.name = n.x")
def pattern_where(spark: SparkSession, d: str) -> DataFrame:
    return pattern_query(_graph(spark, d), f"MATCH (a:File)-[:DEFINES]->(b:Function) WHERE b.name = '{_first_function(spark, d)}' RETURN a")


def _trace_sql(near: str, far: str) -> str:
    return f"""WITH RECURSIVE {_GRAPH}, starts AS (SELECT id FROM nodes_u WHERE kind = 'Function' AND name = (SELECT min(name) FROM nodes_u WHERE kind = 'Function')),
reach AS (SELECT id, 0 AS depth FROM starts UNION SELECT c.{far}, r.depth + 1 FROM reach r JOIN (SELECT DISTINCT * FROM calls) c ON c.{near} = r.id WHERE r.depth < 4)
SELECT n.id, n.kind, n.name, n.qualified_name, n.file_path, n.start_line, n.end_line, min(r.depth) AS depth FROM reach r JOIN nodes_u n ON n.id = r.id
WHERE r.id NOT IN (SELECT id FROM starts) GROUP BY ALL"""


@query(_trace_sql("src_id", "dst_id"))
def trace_outbound(spark: SparkSession, d: str) -> DataFrame:
    return G.trace_calls(_graph(spark, d), _first_function(spark, d), depth=4)


@query(_trace_sql("dst_id", "src_id"))
def trace_inbound(spark: SparkSession, d: str) -> DataFrame:
    return G.trace_calls(_graph(spark, d), _first_function(spark, d), inbound=True, depth=4)


@query(f"WITH {_GRAPH} SELECT id, kind, name, qualified_name, file_path, start_line, end_line FROM nodes_u n WHERE kind = 'Function' AND NOT EXISTS (SELECT 1 FROM calls c WHERE c.dst_id = n.id)")
def dead_functions(spark: SparkSession, d: str) -> DataFrame:
    return G.dead_functions(_graph(spark, d))


@query(f"WITH {_GRAPH}, dead AS (SELECT * FROM nodes_u n WHERE kind = 'Function' AND NOT EXISTS (SELECT 1 FROM calls c WHERE c.dst_id = n.id)) SELECT id, file_path, start_line, (SELECT count(*) FROM dead) AS total FROM dead ORDER BY file_path, start_line, id LIMIT 50")
def dead_report(spark: SparkSession, d: str) -> DataFrame:
    """The first 50 dead functions by place, and how many there are."""
    dead = G.dead_functions(_graph(spark, d)).select("id", "file_path", "start_line")
    total = dead.agg(F.count("*").alias("total"))
    return dead.orderBy("file_path", "start_line", "id").limit(50).crossJoin(F.broadcast(total))  # total is one row


def _hunks(nodes: DataFrame) -> DataFrame:
    return nodes.where("kind = 'Type'").select("project_id", "file_path", (F.col("start_line") + 1).alias("start"), (F.col("start_line") + 4).alias("end"))


@query(f"WITH {_NODES}, hunks AS (SELECT project_id, file_path, start_line + 1 AS s, start_line + 4 AS e FROM nodes_u WHERE kind = 'Type') SELECT n.id, h.s AS start, h.e AS \"end\" FROM nodes_u n JOIN hunks h USING (project_id, file_path) WHERE n.kind <> 'File' AND n.start_line <= h.e AND coalesce(n.end_line, n.start_line) >= h.s")
def overlap_nodes(spark: SparkSession, d: str) -> DataFrame:
    nodes = _nodes(spark, d)
    return G.nodes_overlapping(nodes, _hunks(nodes), "project_id", "file_path").select("id", "start", "end")


@query(f"WITH {_NODES}, points AS (SELECT DISTINCT project_id, file_path, start_line + 2 AS line FROM nodes_u WHERE kind = 'Type') SELECT p.project_id, p.file_path, p.line, min(n.id) AS node_id FROM points p JOIN nodes_u n USING (project_id, file_path) WHERE n.kind <> 'File' AND n.start_line <= p.line AND p.line <= coalesce(n.end_line, n.start_line) GROUP BY 1, 2, 3")
def reference_nodes(spark: SparkSession, d: str) -> DataFrame:
    nodes = _nodes(spark, d)
    points = nodes.where("kind = 'Type'").select("project_id", "file_path", (F.col("start_line") + 2).alias("line"))
    return G.first_enclosing(nodes.where("kind <> 'File'"), points, "project_id", "file_path")


@query(f"WITH {_GRAPH}, ids AS (SELECT id FROM nodes_u WHERE name < 'c') SELECT DISTINCT src_id, dst_id FROM calls WHERE src_id IN (SELECT id FROM ids) AND dst_id IN (SELECT id FROM ids)")
def subgraph_edges(spark: SparkSession, d: str) -> DataFrame:
    graph = _graph(spark, d)
    return G.subgraph_edges(graph, graph.nodes.where("name < 'c'").select("id"))


@query(f"WITH {_NODES} SELECT project_id, file_path, count(*) AS n FROM nodes_u WHERE kind <> 'File' GROUP BY 1, 2 ORDER BY n DESC, project_id, file_path LIMIT 10")
def busiest_files(spark: SparkSession, d: str) -> DataFrame:
    return G.busiest_files(_nodes(spark, d), "project_id", "file_path")


@query(f"WITH {_NODES} SELECT CASE WHEN e = '' THEN '(no extension)' ELSE e END AS extension, count(*) AS n FROM (SELECT regexp_extract(string_split(file_path, '/')[-1], '^.+\\.([^.]+)$', 1) AS e FROM nodes_u WHERE kind = 'File') GROUP BY 1")
def extension_counts(spark: SparkSession, d: str) -> DataFrame:
    return G.extension_counts(_nodes(spark, d))


@query(f"WITH {_GRAPH} SELECT (SELECT count(*) FROM nodes_u) AS nodes, (SELECT count(*) FROM edges_u) AS edges")
def graph_stats(spark: SparkSession, d: str) -> DataFrame:
    return G.graph_stats(_graph(spark, d))


@query(f"""WITH {_GRAPH}, busy AS (SELECT project_id, file_path, count(*) AS n, row_number() OVER (PARTITION BY project_id ORDER BY count(*) DESC, file_path) AS r FROM nodes_u WHERE kind <> 'File' GROUP BY 1, 2)
SELECT project_id, 'total' AS part, 'nodes' AS label, count(*) AS n FROM nodes_u GROUP BY 1 UNION ALL SELECT project_id, 'total', 'edges', count(*) FROM edges_u GROUP BY 1
UNION ALL SELECT project_id, 'busiest', file_path, n FROM busy WHERE r <= 10
UNION ALL SELECT project_id, 'extension', CASE WHEN e = '' THEN '(no extension)' ELSE e END, count(*) FROM (SELECT project_id, regexp_extract(string_split(file_path, '/')[-1], '^.+\\.([^.]+)$', 1) AS e FROM nodes_u WHERE kind = 'File') GROUP BY 1, 3""")
def architecture(spark: SparkSession, d: str) -> DataFrame:
    graph = _graph(spark, d)
    return G.architecture(graph.nodes, graph.edges)


@query(f"WITH {_GRAPH} SELECT kind, count(*) AS edges, count(DISTINCT src_id) AS sources, count(DISTINCT dst_id) AS targets FROM edges_u GROUP BY 1")
def edge_kinds(spark: SparkSession, d: str) -> DataFrame:
    return _graph(spark, d).edges.groupBy("kind").agg(F.count("*").alias("edges"), F.count_distinct("src_id").alias("sources"), F.count_distinct("dst_id").alias("targets"))


@query(f"""WITH {_GRAPH}, c AS (SELECT DISTINCT * FROM calls),
o AS (SELECT c.src_id AS id, string_agg(DISTINCT n.qualified_name, '|' ORDER BY n.qualified_name) AS x FROM c JOIN nodes_u n ON n.id = c.dst_id GROUP BY 1),
i AS (SELECT c.dst_id AS id, string_agg(DISTINCT n.qualified_name, '|' ORDER BY n.qualified_name) AS x FROM c JOIN nodes_u n ON n.id = c.src_id GROUP BY 1)
SELECT n.id, coalesce(o.x, '') AS callees, coalesce(i.x, '') AS callers FROM nodes_u n LEFT JOIN o USING (id) LEFT JOIN i USING (id)""")
def neighbour_names(spark: SparkSession, d: str) -> DataFrame:
    return G.neighbour_names(_graph(spark, d)).select("id", F.array_join("callees", "|").alias("callees"), F.array_join("callers", "|").alias("callers"))


@query(f"WITH {_NODES} SELECT id, regexp_replace(qualified_name, '[^\\p{{L}}\\p{{N}}_-]', '_', 'g') AS link FROM nodes_u")
def wikilinks(spark: SparkSession, d: str) -> DataFrame:
    return _nodes(spark, d).select("id", X.wikilink_name(F.col("qualified_name")).alias("link"))


@query(f"WITH {_NODES}, ids AS (SELECT DISTINCT node_id AS id FROM search_hits WHERE node_id IS NOT NULL) SELECT n.id, n.kind, n.name FROM ids JOIN nodes_u n USING (id)")
def nodes_by_id(spark: SparkSession, d: str) -> DataFrame:
    return _nodes(spark, d).join(table(spark, d, "search_hits").select(F.col("node_id").alias("id")), "id", "left_semi").select("id", "kind", "name")


# --- search ----------------------------------------------------------------


@query(f"WITH {_NODES} SELECT id, name FROM nodes_u WHERE translate(name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE '%anchor%' ORDER BY name, id LIMIT 20")
def name_search(spark: SparkSession, d: str) -> DataFrame:
    return search.search_by_name(_nodes(spark, d), "Anchor").select("id", "name")


@query(f"WITH {_NODES} SELECT id, name FROM nodes_u WHERE translate(name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE '%o_e%t%'")
def name_search_wild(spark: SparkSession, d: str) -> DataFrame:
    return search.search_by_name(_nodes(spark, d), "O_e%T", limit=None).select("id", "name")


_FLAT = "' ' || trim(regexp_replace(strip_accents(lower(content)), '[^\\p{L}\\p{N}]+', ' ', 'g')) || ' '"
_PHRASE = f"""WITH {_FILES}, flat AS (SELECT project_id, file_path, {_FLAT} AS t FROM files WHERE content IS NOT NULL),
c AS (SELECT project_id, file_path, (length(replace(t, ' ', '  ')) - length(replace(replace(t, ' ', '  '), ' @1  @2 ', ''))) // length(' @1  @2 ') AS hits, CASE WHEN trim(t) = '' THEN 0 ELSE length(trim(t)) - length(replace(trim(t), ' ', '')) + 1 END AS tokens FROM flat),
s AS (SELECT count(*) AS n, avg(tokens) AS mean, count(*) FILTER (hits > 0) AS df FROM c)
SELECT project_id, file_path, -greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * hits * 2.2 / (hits + 1.2 * (0.25 + 0.75 * tokens / mean)) AS rank FROM c, s WHERE hits > 0"""


@query(_PHRASE.replace("@1", "nightly").replace("@2", "run").replace("SELECT project_id, file_path, -greatest", "SELECT project_id, file_path, round(-greatest").replace("/ mean)) AS rank", "/ mean)), 6) AS rank"))
def phrase_bm25(spark: SparkSession, d: str) -> DataFrame:
    found = search.search_phrase(_files(spark, d), "Nightly-RUN", "project_id", "file_path", limit=None)
    return found.withColumn("rank", F.round("rank", 6))


@query(f"WITH {_FILES}, flat AS (SELECT project_id, file_path, {_FLAT} AS t FROM files) SELECT project_id, file_path FROM flat WHERE contains(t, ' eintrage in ')")
def phrase_search(spark: SparkSession, d: str) -> DataFrame:
    return search.search_phrase(_files(spark, d), "Einträge in", "project_id", "file_path", limit=None).select("project_id", "file_path")


@query()
def phrase_snippets(spark: SparkSession, d: str) -> DataFrame:
    hits = search.phrase_counts(_files(spark, d), "nightly run").where("hits > 0")
    return hits.select("project_id", "file_path", search.snippet(F.col("content"), "nightly run").alias("snippet"))


@query(f"""WITH {_NODES}, w AS (SELECT unnest([0, 1, 2]) AS word_at, unnest(['anchor', 'ferry', '_or']) AS word),
h AS (SELECT n.*, w.word_at, row_number() OVER (PARTITION BY word_at ORDER BY name, id) AS place FROM nodes_u n JOIN w ON lower(n.name) LIKE '%' || w.word || '%'),
f AS (SELECT *, row_number() OVER (PARTITION BY qualified_name ORDER BY word_at, place) AS r FROM h WHERE place <= 10)
SELECT id, name, word_at, place FROM f WHERE r = 1""")
def keyword_router(spark: SparkSession, d: str) -> DataFrame:
    return keyword_search(_nodes(spark, d), "find the anchor, or a Ferry (_or)").select("id", "name", "word_at", "place")


@query(f"WITH {_NODES} SELECT regexp_matches(name, '^[\\p{{L}}_][\\p{{L}}\\p{{N}}_]*$') AS identifier, count(*) AS n FROM nodes_u GROUP BY 1")
def identifier_names(spark: SparkSession, d: str) -> DataFrame:
    return _nodes(spark, d).groupBy(X.is_identifier(F.col("name")).alias("identifier")).agg(F.count("*").alias("n"))


# --- vectors ---------------------------------------------------------------


@query(f"""WITH {_EMB}, good AS (SELECT * FROM emb WHERE model = 'marrow-code-v2' AND embedding IS NOT NULL AND {_GOOD}), q AS (SELECT arg_min(embedding, node_id) AS v FROM good)
SELECT node_id, round(list_dot_product(embedding::DOUBLE[], v::DOUBLE[]) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(v::DOUBLE[], v::DOUBLE[]))), 6) AS score FROM good, q ORDER BY score DESC, node_id LIMIT 10""")
def semantic_topk(spark: SparkSession, d: str) -> DataFrame:
    rows = _embeddings(spark, d)
    first = rows.where((F.col("model") == "marrow-code-v2") & usable(F.col("embedding"), F.col("dim"))).agg(F.min_by("embedding", "node_id")).first()[0]
    found = search.semantic_search(rows, "marrow-code-v2", first, limit=20)
    return found.select("node_id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "node_id").limit(10)


@query("""WITH a AS (SELECT label, arg_min(embedding, vec_id) AS v, min(vec_id) AS k FROM embeddings GROUP BY 1),
s AS (SELECT e.label, e.vec_id, round(list_dot_product(e.embedding::DOUBLE[], v::DOUBLE[]) / (sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_dot_product(v::DOUBLE[], v::DOUBLE[]))), 6) AS score FROM embeddings e JOIN a USING (label) WHERE e.vec_id <> a.k)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS place FROM s) WHERE place <= 3""")
def semantic_by_label(spark: SparkSession, d: str) -> DataFrame:
    return search.similar_within(table(spark, d, "embeddings"), "label", "vec_id", "embedding")


@query(f"WITH {_EMB} SELECT node_id, model, dim, md5(chunk_text) AS text_md5, len(embedding) AS size FROM emb")
def current_embeddings(spark: SparkSession, d: str) -> DataFrame:
    size = F.when(F.col("embedding").isNotNull(), F.size("embedding"))
    return _embeddings(spark, d).select("node_id", "model", "dim", F.md5("chunk_text").alias("text_md5"), size.alias("size"))


@query(f"WITH {_EMB} SELECT model, count(*) AS nodes, count(embedding) AS embedded, count(*) FILTER (embedding IS NOT NULL AND {_GOOD}) AS usable FROM emb GROUP BY 1")
def model_coverage(spark: SparkSession, d: str) -> DataFrame:
    good = usable(F.col("embedding"), F.col("dim"))
    return _embeddings(spark, d).groupBy("model").agg(F.count("*").alias("nodes"), F.count("embedding").alias("embedded"), F.sum((F.col("embedding").isNotNull() & good).cast("long")).alias("usable"))


@query("""WITH old AS (SELECT qualified_name, model, arg_max(chunk_text, (embedded_at, id)) AS t FROM node_embeddings WHERE embedding IS NOT NULL GROUP BY 1, 2)
SELECT p.id, p.model, coalesce(o.t = p.chunk_text, false) AS reuse FROM (SELECT DISTINCT id, qualified_name, model, chunk_text FROM node_embeddings WHERE embedding IS NULL) p LEFT JOIN old o USING (qualified_name, model)""")
def reuse_split(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "node_embeddings")
    pending = rows.where("embedding is null").select("id", "qualified_name", "model", "chunk_text").distinct()
    return search.split_reusable(pending, rows.where("embedding is not null")).select("id", "model", "reuse")


@query(f"WITH {_NODES}, h AS (SELECT DISTINCT * FROM search_hits) SELECT h.hit_id, h.node_id, n.kind, n.qualified_name FROM h JOIN nodes_u n ON n.id = h.node_id WHERE h.tool = 'search_codebase'")
def hit_nodes(spark: SparkSession, d: str) -> DataFrame:
    hits = table(spark, d, "search_hits").distinct().where("tool = 'search_codebase'").select("hit_id", "node_id")
    return search.enrich_hits(hits, _nodes(spark, d)).select("hit_id", "node_id", "kind", "qualified_name")


@query(f"""WITH {_EMB}, h AS (SELECT DISTINCT hit_id, query_text, query_node_id, node_id FROM search_hits WHERE tool = 'search_codebase'), good AS (SELECT node_id, model, embedding FROM emb WHERE embedding IS NOT NULL AND {_GOOD})
SELECT h.hit_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 5) AS score
FROM h JOIN good a ON a.node_id = h.query_node_id AND a.model = h.query_text JOIN good b ON b.node_id = h.node_id AND b.model = h.query_text WHERE len(a.embedding) = len(b.embedding)""")
def hit_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores of past semantic searches, worked out again."""
    good = _embeddings(spark, d).where("embedding is not null").where(usable(F.col("embedding"), F.col("dim"))).select("node_id", "model", "embedding")
    hits = table(spark, d, "search_hits").where("tool = 'search_codebase'").select("hit_id", F.col("query_text").alias("model"), "query_node_id", "node_id").distinct()
    both = hits.join(good.withColumnsRenamed({"node_id": "query_node_id", "embedding": "a"}), ["query_node_id", "model"]).join(good.withColumnRenamed("embedding", "b"), ["node_id", "model"])
    return both.where(F.size("a") == F.size("b")).select("hit_id", F.round(cosine(F.col("a"), F.col("b")), 5).alias("score"))


# --- ingest ----------------------------------------------------------------


@query("SELECT c.event_id, c.user_id, s.event_id AS signup_id FROM (SELECT * FROM events WHERE event_type = 'click') c ASOF JOIN (SELECT * FROM events WHERE event_type = 'signup') s ON c.user_id = s.user_id AND c.ts >= s.ts")
def asof_attribution(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    clicks = events.where("event_type = 'click'").select("user_id", "event_id", "ts")
    signups = events.where("event_type = 'signup'").withColumnRenamed("event_id", "signup_id")
    found = ingest.attribute_asof(signups, clicks, ["user_id"], def_at="ts", def_id="signup_id", point_at="ts")
    return found.select("event_id", "user_id", "signup_id")


@query(f"""WITH {_NODES}, p AS (SELECT project_id, file_path, id AS function_id, start_line FROM nodes_u WHERE kind = 'Function'), t AS (SELECT project_id, file_path, id, start_line FROM nodes_u WHERE kind = 'Type')
SELECT p.function_id, arg_max(t.id, (t.start_line, t.id)) AS type_id FROM p JOIN t USING (project_id, file_path) WHERE t.start_line <= p.start_line GROUP BY 1""")
def enclosing_asof(spark: SparkSession, d: str) -> DataFrame:
    """The type that starts last before each function of the same file."""
    nodes = _nodes(spark, d)
    points = nodes.where("kind = 'Function'").select("project_id", "file_path", F.col("id").alias("function_id"), "start_line")
    defs = nodes.where("kind = 'Type'").withColumnRenamed("id", "type_id")
    return ingest.attribute_asof(defs, points, ["project_id", "file_path"], def_at="start_line", def_id="type_id", point_at="start_line").select("function_id", "type_id")


@query(f"""WITH {_NODES}, f AS (SELECT * FROM nodes_u WHERE kind = 'Function'), c AS (SELECT project_id, file_path, id AS caller_id, lead(name) OVER (PARTITION BY project_id ORDER BY id) AS callee_name FROM f),
l AS (SELECT project_id, file_path, name AS callee_name, max(id) AS a FROM f GROUP BY 1, 2, 3), u AS (SELECT project_id, name AS callee_name, min(id) AS b FROM f GROUP BY 1, 2 HAVING count(DISTINCT id) = 1)
SELECT caller_id, coalesce(a, b) AS callee_id, CASE WHEN a IS NOT NULL THEN 'file' ELSE 'project' END AS how FROM c LEFT JOIN l USING (project_id, file_path, callee_name) LEFT JOIN u USING (project_id, callee_name) WHERE coalesce(a, b) IS NOT NULL AND coalesce(a, b) <> caller_id""")
def resolve_calls(spark: SparkSession, d: str) -> DataFrame:
    functions = _nodes(spark, d).where("kind = 'Function'").select("project_id", "file_path", "name", "id")
    following = F.lead("name").over(Window.partitionBy("project_id").orderBy("id"))
    calls = functions.select("project_id", "file_path", F.col("id").alias("caller_id"), following.alias("callee_name")).where("callee_name is not null")
    return ingest.resolve_calls(calls, functions).drop("project_id")


@query(f"WITH {_FILES} SELECT project_id, file_path, run_id, length(content) AS characters FROM files")
def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    return _files(spark, d).select("project_id", "file_path", "run_id", F.length("content").alias("characters"))


@query(f"""WITH {_FILES}, lined AS (SELECT project_id, file_path, len(CASE WHEN right(c, 1) = chr(10) OR c = '' THEN x[1:len(x) - 1] ELSE x END) AS total FROM (SELECT project_id, file_path, content AS c, string_split(content, chr(10)) AS x FROM files)),
s AS (SELECT DISTINCT section_id, project_id, file_path, name, level, start_line, end_line, parent_id FROM sections), n AS (SELECT *, row_number() OVER (PARTITION BY project_id, file_path ORDER BY start_line) - 1 AS at FROM s)
SELECT n.project_id, n.file_path, n.name, n.level, n.start_line, least(coalesce(n.end_line, total), total)::INT AS end_line, p.at::INT AS parent FROM n JOIN lined USING (project_id, file_path) LEFT JOIN n p ON p.section_id = n.parent_id""")
def section_rows(spark: SparkSession, d: str) -> DataFrame:
    return ingest.extract_sections(_files(spark, d).where(F.col("file_path").rlike(r"\.(md|markdown)$")), "project_id", "file_path")


@query("SELECT DISTINCT project_id, file_path, name, level, start_line FROM sections s WHERE EXISTS (SELECT 1 FROM file_contents f WHERE f.project_id = s.project_id AND f.file_path = s.file_path)")
def section_heads(spark: SparkSession, d: str) -> DataFrame:
    """Headings found in the current markdown files; the stored sections are the same."""
    return section_rows(spark, d).select("project_id", "file_path", "name", "level", "start_line")


@query()
def tag_rows(spark: SparkSession, d: str) -> DataFrame:
    files = _files(spark, d).withColumn("language", language_of(F.col("file_path"))).where("language is not null")
    return ingest.extract_tags(files, "project_id", "file_path")


@query(f"WITH {_NODES} SELECT DISTINCT project_id, file_path, start_line AS start, start_line + 3 AS \"end\" FROM nodes_u WHERE kind = 'Function'")
def diff_hunks(spark: SparkSession, d: str) -> DataFrame:
    """Hunks of one diff text for each file with functions, read back."""
    marks = _nodes(spark, d).where("kind = 'Function'").select("project_id", "file_path", "start_line").distinct()
    hunk = F.concat(F.lit("@@ -1,2 +"), F.col("start_line").cast("string"), F.lit(",4 @@ x"))
    texts = marks.groupBy("project_id", "file_path").agg(F.concat(F.lit("--- a/x\n+++ b/"), F.col("file_path"), F.lit("\n"), F.array_join(F.array_sort(F.collect_list(hunk)), "\n")).alias("diff"))
    return ingest.diff_hunks(texts.select("project_id", "diff"), "project_id")


@query(f"WITH {_FILES}, l AS (SELECT project_id, file_path, string_split(replace(content, chr(13) || chr(10), chr(10)), chr(10)) AS x, right(content, 1) = chr(10) OR content = '' AS ended FROM files), n AS (SELECT project_id, file_path, CASE WHEN ended THEN x[1:len(x) - 1] ELSE x END AS x FROM l) SELECT project_id, file_path, len(x)::INT AS total, least(len(x), 300)::INT AS last_line, len(x) > 300 AS truncated, md5(array_to_string(x[1:300], chr(10))) AS text_md5 FROM n")
def file_windows(spark: SparkSession, d: str) -> DataFrame:
    found = line_window(_files(spark, d), "project_id", "file_path")
    return found.select("project_id", "file_path", "total", "last_line", "truncated", F.md5("text").alias("text_md5"))


@query(f"WITH {_FILES}, l AS (SELECT project_id, file_path, string_split(replace(content, chr(13) || chr(10), chr(10)), chr(10)) AS x, right(content, 1) = chr(10) OR content = '' AS ended FROM files), n AS (SELECT project_id, file_path, CASE WHEN ended THEN x[1:len(x) - 1] ELSE x END AS x FROM l) SELECT project_id, file_path, md5(array_to_string(x[10:20], chr(10))) AS text_md5 FROM n")
def file_range(spark: SparkSession, d: str) -> DataFrame:
    return line_window(_files(spark, d), "project_id", "file_path", start=10, end=20).select("project_id", "file_path", F.md5("text").alias("text_md5"))


@query("SELECT id, md5(left(chunk_text, 500)) AS text_md5 FROM (SELECT DISTINCT id, chunk_text FROM node_embeddings)")
def chunk_truncate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "node_embeddings").select("id", "chunk_text").distinct().select("id", F.md5(X.chunk_truncate(F.col("chunk_text"), 500)).alias("text_md5"))


@query(f"WITH {_FILES} SELECT project_id, file_path, list_max([strlen(x) for x in string_split(content, chr(10))])::INT AS longest FROM files WHERE list_max([strlen(x) for x in string_split(content, chr(10))]) > 2000")
def minified_guard(spark: SparkSession, d: str) -> DataFrame:
    return _files(spark, d).select("project_id", "file_path", X.longest_line(F.col("content")).alias("longest")).where("longest > 2000")


@query(f"WITH {_FILES} SELECT len(list_intersect(string_split(file_path, '/'), ['.git', 'target', 'node_modules', '.kelpgraph'])) > 0 AS noise, count(*) AS n FROM files GROUP BY 1")
def noise_paths(spark: SparkSession, d: str) -> DataFrame:
    return _files(spark, d).groupBy(X.is_noise(F.col("file_path")).alias("noise")).agg(F.count("*").alias("n"))


@query(f"""WITH {_FILES} SELECT CASE string_split(file_path, '.')[-1] WHEN 'rs' THEN 'Rust' WHEN 'py' THEN 'Python' WHEN 'js' THEN 'JavaScript' WHEN 'mjs' THEN 'JavaScript' WHEN 'cjs' THEN 'JavaScript' WHEN 'ts' THEN 'TypeScript' WHEN 'go' THEN 'Go' WHEN 'java' THEN 'Java' WHEN 'c' THEN 'C' WHEN 'h' THEN 'C' WHEN 'cs' THEN 'CSharp' WHEN 'rb' THEN 'Ruby' WHEN 'php' THEN 'Php' END AS language, count(*) AS files FROM files GROUP BY 1""")
def language_files(spark: SparkSession, d: str) -> DataFrame:
    return _files(spark, d).groupBy(language_of(F.col("file_path")).alias("language")).agg(F.count("*").alias("files"))


# --- registry, usage, gates ------------------------------------------------


def _calls(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_type").alias("name"), (F.col("event_type") == "error").alias("error"), F.col("value").alias("latency"), F.octet_length("props").cast("long").alias("bytes"), F.col("ts").alias("at"))


@query("SELECT event_type AS name, count(*) AS call_count, count(*) FILTER (event_type = 'error') AS error_count, round(sum(value), 4) AS total_latency, max(value) AS max_latency, sum(strlen(props))::BIGINT AS total_output_bytes, max(ts) AS last_called, round(sum(value) / count(*), 6) AS avg_latency FROM events GROUP BY 1")
def usage_stats(spark: SparkSession, d: str) -> DataFrame:
    return registry.usage_stats(_calls(spark, d), "name").withColumns({"total_latency": F.round("total_latency", 4), "avg_latency": F.round("avg_latency", 6)})


@query("SELECT coalesce(sum(calls - errors), 0)::BIGINT AS reads, coalesce(sum(bytes), 0)::BIGINT AS bytes, (coalesce(sum(bytes), 0) // 4)::BIGINT AS tokens FROM (SELECT count(*) AS calls, count(*) FILTER (event_type = 'error') AS errors, sum(strlen(props)) AS bytes FROM events WHERE event_type IN ('view', 'click', 'error') GROUP BY event_type)")
def reads_avoided(spark: SparkSession, d: str) -> DataFrame:
    return registry.reads_avoided(registry.usage_stats(_calls(spark, d), "name"), tools=("view", "click", "error"))


@query("SELECT tool, project_id, count(*) AS hits, count(DISTINCT query_text) AS queries, sum(strlen(coalesce(snippet, '')))::BIGINT AS bytes FROM (SELECT DISTINCT * FROM search_hits) GROUP BY 1, 2")
def session_usage(spark: SparkSession, d: str) -> DataFrame:
    hits = table(spark, d, "search_hits").distinct()
    return hits.groupBy("tool", "project_id").agg(F.count("*").alias("hits"), F.count_distinct("query_text").alias("queries"), F.sum(F.octet_length(F.coalesce("snippet", F.lit("")))).alias("bytes"))


_PROJECTS = "p AS (SELECT hash, max_by(struct_pack(root_path := root_path, li := last_indexed_unix, lq := last_queried_unix, ok := auto_reindex_count, bad := auto_reindex_fail_count, ms := auto_reindex_total_ms), (coalesce(last_indexed_unix, 0), coalesce(last_queried_unix, 0), root_path)) AS x FROM projects WHERE hash IS NOT NULL GROUP BY 1)"


def _projects(spark: SparkSession, d: str) -> DataFrame:
    return registry.latest_projects(table(spark, d, "projects"))


def _now(spark: SparkSession, d: str) -> int:
    """The latest query of the registry, for want of a clock."""
    return table(spark, d, "projects").agg(F.max("last_queried_unix")).first()[0]


@query(f"WITH {_PROJECTS}, t AS (SELECT max(last_queried_unix) AS now FROM projects) SELECT hash, coalesce(x.lq, 0) <> 0 AND greatest(now - coalesce(x.lq, 0), 0) <= 172800 AS warm, x.li IS NOT NULL AND x.li <> 0 AS indexed, CASE WHEN x.li IS NOT NULL AND x.li <> 0 THEN greatest(now - x.li, 0) END AS seconds_since_indexed FROM p, t")
def freshness(spark: SparkSession, d: str) -> DataFrame:
    found = registry.freshness(_projects(spark, d), F.lit(_now(spark, d)), 172_800)
    return found.select("hash", "warm", "indexed", "seconds_since_indexed")


@query(f"WITH {_PROJECTS} SELECT hash, coalesce(x.ok, 0) AS ok, coalesce(x.bad, 0) AS failed, coalesce(x.ms, 0) AS total_ms, round(CASE WHEN coalesce(x.ok, 0) = 0 THEN 0.0 ELSE coalesce(x.ms, 0) / x.ok END, 6) AS avg_ms FROM p WHERE coalesce(x.ok, 0) + coalesce(x.bad, 0) > 0")
def reindex_totals(spark: SparkSession, d: str) -> DataFrame:
    return registry.reindex_totals(_projects(spark, d)).withColumn("avg_ms", F.round("avg_ms", 6))


@query(f"WITH {_PROJECTS}, {_GRAPH}, {_FILES} SELECT hash, x.root_path AS root_path, coalesce((SELECT count(*) FROM nodes_u n WHERE n.project_id = hash), 0) AS nodes, coalesce((SELECT count(*) FROM edges_u e WHERE e.project_id = hash), 0) AS edges, coalesce((SELECT sum(strlen(content)) FROM files f WHERE f.project_id = hash), 0)::BIGINT AS bytes FROM p")
def project_list(spark: SparkSession, d: str) -> DataFrame:
    graph = _graph(spark, d)
    return registry.project_list(_projects(spark, d), graph.nodes, graph.edges, _files(spark, d))


@query(f"WITH {_PROJECTS}, w AS (SELECT x.root_path AS path, greatest(coalesce(x.ok, 0), 1) AS weight, coalesce(x.lq, 0) AS last_queried FROM p), r AS (SELECT *, coalesce(sum(weight) OVER (ORDER BY last_queried, path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(weight) OVER () AS total FROM w) SELECT path, weight, last_queried FROM r WHERE greatest(400 - (total - before), 0) < 100")
def admission(spark: SparkSession, d: str) -> DataFrame:
    watched = _projects(spark, d).select(F.col("root_path").alias("path"), F.greatest(F.coalesce("auto_reindex_count", F.lit(0)), F.lit(1)).alias("weight"), F.coalesce("last_queried_unix", F.lit(0)).alias("last_queried"))
    return registry.plan_admission(watched, 100, 400)


@query(f"WITH {_PROJECTS}, w AS (SELECT DISTINCT project_id AS path FROM index_runs WHERE finished_at IS NULL), c AS (SELECT hash AS path FROM p WHERE coalesce(x.lq, 0) <> 0) SELECT path, 'drop' AS action FROM w WHERE path NOT IN (SELECT path FROM c) UNION ALL SELECT path, 'add' FROM c WHERE path NOT IN (SELECT path FROM w)")
def watch_changes(spark: SparkSession, d: str) -> DataFrame:
    """Projects of crashed runs against those that were ever queried."""
    watched = table(spark, d, "index_runs").where("finished_at is null and project_id is not null").select(F.col("project_id").alias("path")).distinct()
    current = _projects(spark, d).where("coalesce(last_queried_unix, 0) <> 0").select(F.col("hash").alias("path"))
    return registry.watch_changes(watched, current)


@query("""WITH paths AS (SELECT DISTINCT project_id, file_path AS path FROM file_contents), roots AS (SELECT DISTINCT project_id, array_to_string(string_split(path, '/')[1:n], '/') AS root FROM paths, (SELECT unnest([1, 2, 3]) AS n))
SELECT p.project_id, p.path, max_by(root, length(root)) AS root FROM paths p JOIN roots r ON r.project_id = p.project_id AND (p.path = r.root OR starts_with(p.path, r.root || '/')) GROUP BY 1, 2""")
def dirty_roots(spark: SparkSession, d: str) -> DataFrame:
    paths = table(spark, d, "file_contents").select("project_id", F.col("file_path").alias("path")).distinct()
    parts = F.split("path", "/")
    roots = paths.select("project_id", F.explode(F.array(*[F.array_join(F.slice(parts, 1, n), "/") for n in (1, 2, 3)])).alias("root")).distinct()
    return registry.dirty_roots(paths, roots, "project_id")


@query("""WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 3600 * 1000000::BIGINT THEN 0 ELSE 1 END AS n FROM events), s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id, session::BIGINT AS session, min(ts) AS first_at, max(ts) AS last_at, count(*) AS events FROM s GROUP BY 1, 2""")
def debounce_sessions(spark: SparkSession, d: str) -> DataFrame:
    return registry.debounce_sessions(table(spark, d, "events"), ["user_id"], "ts", 3600)


@query("SELECT project_id, count(*) AS runs, count(finished_at) AS finished, sum(files_indexed)::BIGINT AS files, sum(nodes)::BIGINT AS nodes, sum(edges)::BIGINT AS edges, max(finished_at) AS last_finished FROM (SELECT DISTINCT * FROM index_runs) GROUP BY 1")
def run_summary(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "index_runs").distinct()
    return runs.groupBy("project_id").agg(F.count("*").alias("runs"), F.count("finished_at").alias("finished"), F.sum("files_indexed").alias("files"), F.sum("nodes").alias("nodes"), F.sum("edges").alias("edges"), F.max("finished_at").alias("last_finished"))
