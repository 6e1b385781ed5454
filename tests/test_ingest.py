import pytest
from pyspark.sql import functions as F

from kelpgraph.operators import ingest
from kelpgraph.operators.ingest import parse_hunks, sections_of, tags_of
from kelpgraph.sources import scan, snapshot


def test_sections_nest_and_end():
    parents = lambda t: [s[4] for s in sections_of(t)]
    assert parents("# Harbour\n## Tides\nhigh\n### Spring tides\n### Neap tides\n## Moorings\n# Crew\n") == [None, 0, 1, 1, 0, None]
    assert parents("# Harbour\n\n#### Buoys\n## Moorings\n") == [None, 0, 0]
    assert [(s[1], s[4]) for s in sections_of("#### Tide table\n\n06:12 low\n")] == [(4, None)]
    assert sections_of("line one\nline two\n# Heading\n")[0][2] == 3
    assert [s[3] for s in sections_of("# A\nbody a\n## B\nbody b\n# C\nbody c\n")] == [4, 4, 6]
    assert [s[3] for s in sections_of("# A\n## B\n### C\n# D\n")] == [3, 3, 3, 4]


def test_sections_skip_fences_and_other_hashes():
    assert len(sections_of("# A\n```sh\n# sets the tide gauge\n```\n# B\n")) == 2
    assert len(sections_of("# A\n~~~\n# not a heading\n~~~\n")) == 1
    assert len(sections_of("```\n~~~\n# not a heading\n```\n## Real Heading\n")) == 1
    assert [s[0] for s in sections_of("#12 berths are free\n\n# Berths ##\n#   \n")] == ["Berths"]
    assert sections_of("") == [] and sections_of("# A\r\n# B\r\n")[0][0] == "A"


def test_hunks():
    diff = "--- a/x\n+++ b/x\n@@ -1,2 +3,4 @@ f\n@@ -9 +9 @@\n@@ -5,2 +4,0 @@\n--- a/y\n+++ b/y\n@@ -1 +1,2 @@\n"
    assert parse_hunks(diff) == [("x", 3, 6), ("x", 9, 9), ("x", 4, 4), ("y", 1, 2)]
    assert parse_hunks("") == []


def test_tags():
    tags = [(c, n) for c, n, *_ in tags_of("class A:\n    def f(self):\n        g(1)\n\ndef g(x):\n    return x.h()\n", "Python")]
    assert ("type", "A") in tags and ("function", "f") in tags and ("call", "g") in tags and ("call", "h") in tags
    assert tags_of("def broken(:\n", "Python") == [] and tags_of("x", None) == []
    assert [(c, n) for c, n, *_ in tags_of("func Top(a int) int {\n    return Other(a)\n}\n", "Go")] == [("function", "Top"), ("call", "Other")]
    assert [n for c, n, *_ in tags_of("pub fn a() {}\nstruct B {}\n", "Rust")] == ["a", "B"]


def test_asof_attribution(spark):
    defs = spark.createDataFrame([("f", 5, 1), ("f", 9, 2), ("f", 9, 3), ("g", 1, 4)], "file string, row int, fn long")
    calls = spark.createDataFrame([("f", 1, "before"), ("f", 5, "same"), ("f", 8, "in"), ("f", 99, "after"), ("h", 1, "none")], "file string, row int, name string")
    got = {r["name"]: r["fn"] for r in ingest.attribute_asof(defs, calls, ["file"], def_at="row", def_id="fn", point_at="row").collect()}
    assert got == {"same": 1, "in": 1, "after": 3}


def test_resolution_rules(spark):
    functions = spark.createDataFrame([("p", "a", "helper", 1), ("p", "a", "main", 2), ("p", "b", "helper", 3), ("p", "b", "only", 4), ("p", "c", "twice", 5), ("p", "c", "twice", 6)], "project_id string, file_path string, name string, id long")
    calls = spark.createDataFrame([("p", "a", 2, "helper"), ("p", "a", 2, "only"), ("p", "c", 5, "helper"), ("p", "b", 4, "only"), ("p", "c", 1, "twice"), ("p", "a", 2, "only"), ("p", "a", 2, "unknown")], "project_id string, file_path string, caller_id long, callee_name string")
    got = sorted((r["caller_id"], r["callee_id"], r["how"]) for r in ingest.resolve_calls(calls, functions).collect())
    assert got == [(1, 6, "file"), (2, 1, "file"), (2, 4, "project"), (2, 4, "project")]


def test_upsert_and_latest(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("b", 3), ("c", 4)], "k string, v int")
    assert sorted(map(tuple, ingest.upsert(old, new, "k").collect())) == [("a", 1), ("b", 3), ("c", 4)]
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "y")], "k string, at int, v string")
    assert [tuple(r) for r in ingest.latest_by(rows, ["k"], "at").collect()] == [("a", 2, "y")]


FILES = {
    "src/a.py": "def helper():\n    return 1\n\ndef main():\n    helper()\n    other()\n",
    "src/b.py": "def other():\n    return 2\n\ndef helper():\n    return 3\n",
    "README.md": "# Title\n\n## Part\ntext\n",
    "notes.txt": "no",
    "target/x.py": "def built(): pass\n",
    "skip/y.py": "def skipped(): pass\n",
}


@pytest.fixture
def tree(tmp_path):
    for name, text in FILES.items():
        path = tmp_path / "proj" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    (tmp_path / "proj/.gitignore").write_text("# c\nskip/\n")
    return tmp_path / "proj"


def test_index_a_tree(spark, tree):
    files = scan.read_tree(spark, str(tree)).cache()
    assert sorted(r["file_path"] for r in files.select("file_path").collect()) == ["README.md", "src/a.py", "src/b.py"]
    built = ingest.index_files(files)
    nodes = {r["qualified_name"]: r for r in built.nodes.collect()}
    assert "src/a.py::helper#0" in nodes and "README.md::Part#3" in nodes and nodes["src/a.py"]["start_line"] == 0
    by_id = {r["id"]: q for q, r in nodes.items()}
    edges = {(by_id[r["src_id"]], by_id[r["dst_id"]], r["kind"]) for r in built.edges.collect()}
    assert ("src/a.py::main#3", "src/a.py::helper#0", "CALLS") in edges and ("src/a.py::main#3", "src/b.py::other#0", "CALLS") in edges
    assert ("README.md::Title#1", "README.md::Part#3", "CONTAINS") in edges and ("src/b.py", "src/b.py::other#0", "DEFINES") in edges
    chunks = {r["qualified_name"]: r["chunk_text"] for r in built.chunks.collect()}
    assert chunks["src/a.py::helper#0"] == "def helper():\n    return 1"
    vectors = ingest.embed_chunks(built.chunks, ingest.hash_embedder(8), "m").collect()
    assert len(vectors) == len(chunks) and all(len(v["embedding"]) == 8 for v in vectors)


def test_ignore_rules_of_inner_folders(spark, tmp_path):
    for name in ("a/x.py", "a/keep/y.py", "a/out/z.py", "b/out/w.py", "b/deep/er/gen.py", "b/v1.py", "b/v2.py", "c/logs/l.py"):
        path = tmp_path / "p" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("x = 1\n")
    (tmp_path / "p/.gitignore").write_text("**/gen.py\nc/**\nv[1].py\n")
    (tmp_path / "p/a/.gitignore").write_text("*.py\n!keep/y.py\nout/\n")
    found = sorted(r["file_path"] for r in scan.read_tree(spark, str(tmp_path / "p")).collect())
    assert found == ["a/keep/y.py", "b/out/w.py", "b/v2.py"]


def test_spans_of_definitions():
    go = "func (s *Box) Put(\n    v int,\n) error {\n    if v > 0 { // }\n        return nil\n    }\n    return \"}\"\n}\n\ntype Id int\n\nfunc last() {}\n"
    assert [(t[1], t[2], t[3]) for t in tags_of(go, "Go") if t[0] != "call"] == [("Put", 0, 7), ("Id", 9, 9), ("last", 11, 11)]
    js = "const add = (a, b) => a + b;\nexport const twice = async (f) => {\n  f();\n};\nclass Box {\n  put(v) {\n    return v;\n  }\n}\n!function(){function in1(a){return a}var in2=function(b){return b}}();\n"
    assert [(t[1], t[2], t[3]) for t in tags_of(js, "JavaScript") if t[0] != "call"] == [("add", 0, 0), ("twice", 1, 3), ("Box", 4, 8), ("put", 5, 7), ("in1", 9, 9), ("in2", 9, 9)]
    ruby = "class Box\n  def put(v)\n    if v\n      1\n    end\n  end\nend\n"
    assert [(t[1], t[2], t[3]) for t in tags_of(ruby, "Ruby") if t[0] != "call"] == [("Box", 0, 6), ("put", 1, 5)]
    rust = "impl<'a> Box<'a> {\n    pub fn get(&self) -> char {\n        '}'\n    }\n}\n"
    assert [(t[1], t[2], t[3]) for t in tags_of(rust, "Rust") if t[0] == "function"] == [("get", 1, 3)]
    broken = "def one(a):\n    return a\n\ndef two(:\n\nclass C:\n    def m(self):\n        x = (\n"
    assert [(t[1], t[2], t[3]) for t in tags_of(broken, "Python")] == [("one", 0, 1), ("C", 5, 7), ("m", 6, 7)]


def test_references_add_resolved_calls(spark, tree):
    built = ingest.index_files(scan.read_tree(spark, str(tree)))
    target = built.nodes.where("qualified_name = 'src/b.py::helper#3'").first()["id"]
    references = spark.createDataFrame([("src/a.py", 5, target)], "file_path string, line int, callee_id long")
    kinds = [r["kind"] for r in ingest.add_references(built.edges, built.nodes, references).where(F.col("dst_id") == target).collect()]
    assert sorted(kinds) == ["CALLS_RESOLVED", "DEFINES"]


def test_content_signature(spark, tree):
    sign = lambda: scan.content_signature(scan.tree_listing(spark, str(tree))).first()["signature"]
    first = sign()
    assert sign() == first
    (tree / "notes.txt").write_text("changed")
    assert sign() == first
    (tree / "src/c.py").write_text("x = 1\n")
    assert sign() != first


def test_watch_estimate(tmp_path):
    (tmp_path / "a/b/c").mkdir(parents=True)
    (tmp_path / "d").mkdir()
    assert scan.estimate_watches(str(tmp_path), 100) == 5
    for i in range(60):
        (tmp_path / f"n{i}").mkdir()
    assert scan.estimate_watches(str(tmp_path), 10) == 11


def test_versions_export_and_notes(spark, tmp_path):
    store, target = str(tmp_path / "store"), str(tmp_path / "out")
    with pytest.raises(scan.NotIndexed):
        snapshot.read_version(spark, store)
    one, two = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([(1,), (2,)], "x int")
    assert snapshot.write_version({"t": one}, store) == 1 and snapshot.write_version({"t": two}, store) == 2
    tables = snapshot.read_version(spark, store)
    assert tables["t"].count() == 2 and snapshot.export_store(tables, target) == {"t": 2}
    assert snapshot.import_store(spark, target)["t"].count() == 2
    with pytest.raises(ValueError):
        snapshot.import_store(spark, target, most_bytes=10)
    notes = spark.createDataFrame([("a.md", "x"), ("b.md", "y")], "file_name string, note string")
    assert snapshot.write_notes(notes, str(tmp_path / "notes")) == 2 and (tmp_path / "notes/a.md").read_text() == "x"


def test_side_files_and_settings(spark, tmp_path):
    path = str(tmp_path / "reg/projects.json")
    assert scan.load_projects(spark, path).count() == 0
    scan.save_rows(path, "projects", [{"root_path": "/a", "hash": "h", "last_indexed_unix": 5}])
    assert scan.load_projects(spark, path).first()["hash"] == "h"
    (tmp_path / "reg/projects.json").write_text("{broken")
    assert scan.load_projects(spark, path).count() == 0
    conf = tmp_path / "c.toml"
    conf.write_text('[embeddings]\nendpoint = "http://10.0.0.5:1/v1"\nmodel = "m"\nenabled = true\napi_key = "k"\n')
    s = scan.load_settings(str(conf))
    assert scan.embeddings_policy(s) == "Allowed" and "api_key" not in scan.redacted(s) and scan.redacted(s)["has_api_key"]
    s.endpoint = "https://example.org/v1"
    assert scan.embeddings_policy(s) == "RemoteBlocked"
    s.enabled = False
    assert scan.embeddings_policy(s) == "Disabled" and scan.embeddings_policy(scan.Settings()) == "NotConfigured"
    conf.write_text("broken = = 1")
    with pytest.raises(ValueError):
        scan.load_settings(str(conf))
    assert scan.is_path_allowed("/x", []) and scan.is_path_allowed(str(tmp_path / "q"), [str(tmp_path)]) and not scan.is_path_allowed("/etc", [str(tmp_path)])
