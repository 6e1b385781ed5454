"""Provenance, documentation pairs and parsing of source files."""

import random
import warnings

import pytest
from pyspark.sql import functions as F

from kelpgraph.llm import docpairs, invalid, provenance
from kelpgraph.llm.parsing.lexers import LEXERS, build_tables
from kelpgraph.llm.parsing.tables import Grammar, Recogniser, build

FILE = "project_id string, file_path string, content string, run_id long, indexed_at int"
NODE = "id long, project_id string, kind string, name string, file_path string, start_line int, end_line int"


@pytest.fixture(scope="module")
def tables():
    return build_tables()


VALID = {
    "python": "import a\n@d\nasync def f(x: int = 1, *a, **k) -> int:\n    '''doc'''\n    if x > 2: return [i for i in a if i]\n    with open(x) as g, h():\n        pass\n    try:\n        y = lambda q: q\n    except* E as e:\n        raise\n    match x:\n        case {'a': [1, *r]} if r:\n            pass\n    return {**k}\n",
    "module": "import { a as b } from './x.js';\nexport default class A extends B { #p = 1; static async *g() { yield* h() } get x() { return this.#p } }\nconst f = async ({ a, ...r }, [b = 1]) => ({ a }) \nlet s = `t ${f(1)}`, r = /[/]x/g.test(s)\nfor (const k of s) { if (k) continue\n else break }\n",
    "script": "var x = 017; with (x) { y = 1 }\nmodule.exports = function (a) { return a ? b : c };\n!function(){var n=1;}();\n",
    "typescript": "import type { A } from './a';\nexport interface P<T extends A = A> extends Q { readonly a?: string; [k: string]: unknown; m(x: number): void }\nabstract class C<T> implements P<T> { constructor(private readonly x: number, public y?: string) { super() } abstract f(): T; }\nenum E { A = 1, B }\nconst g = <T,>(x: T): x is T => !!(x as any)!.y;\ntype U = keyof T | (A extends B ? C : D)[];\nfunction h(this: Window, ...r: number[]): asserts r {}\n",
    "go": 'package a\n\nimport (\n\t"fmt"\n\tx "y/z"\n)\n\ntype T[K comparable] struct {\n\tA int `json:"a"`\n\t*B\n}\n\nfunc (t *T[K]) F(a, b int, c ...string) (n int, err error) {\n\tfor i := range c {\n\t\tif v, ok := m[i]; ok && v > 1 {\n\t\t\tgo func() { ch <- 1 }()\n\t\t}\n\t}\n\tswitch x := v.(type) {\n\tcase int, string:\n\t\tdefer f()\n\tdefault:\n\t}\n\treturn []int{1, 2}[0], nil\n}\n',
    "rust": "use a::{b, c as d};\n#[derive(Debug)]\npub struct S<'a, T: Clone + 'a> { x: &'a T, y: Vec<Option<i32>> }\nimpl<'a, T> S<'a, T> where T: Clone { pub fn f(&mut self, n: usize) -> Result<(), Box<dyn Error>> { let v: Vec<_> = (0..n).map(|i| i as u8 + 1).collect::<Vec<u8>>(); if let Some(x) = self.y { return Ok(()); } match n { 0 | 1 => {} _ if n > 2 => println!(\"{}\", n), _ => (), } loop { break; } Ok(()) } }\n",
    "java": "package a.b;\nimport java.util.*;\n@A(x = 1) public final class C<T extends Comparable<T>> extends B implements I {\n  private static final Map<String, List<int[]>> M = new HashMap<>();\n  enum E { A, B { void f() {} } ; int x; }\n  record R(int a, String b) {}\n  C(int... x) throws E { this(1); }\n  <U> U f(final U u) { for (var e : M.entrySet()) { x += (int) e.y >> 2; } return switch (u) { case A -> 1; default -> { yield 2; } }; }\n  void g() { run(() -> { try (var r = o()) { } catch (A | B e) { } finally { } }, String::valueOf); }\n}\n",
    "ruby": "require 'x'\nmodule A\n  class B < C::D\n    attr_reader :x, :y\n    def f(a, b = 1, *c, k: 2, **o, &blk)\n      return a if b > 1 && !c.empty?\n      c.each_with_index do |x, i|\n        puts \"#{x} y\" unless i == 3\n      end\n      h = { a: 1, 'b' => 2 }\n      t = <<~EOS\n        text (\n      EOS\n      case a\n      when 1, 2 then b\n      else c\n      end\n      x = a ? b : c\n    rescue E => e\n      raise\n    ensure\n      z\n    end\n  end\nend\n",
    "csharp": 'using System;\nnamespace A.B {\n  [Obsolete("x")]\n  public sealed class C<T> : D, I<T> where T : class, new() {\n    private readonly int[] a = { 1, 2 };\n    public string P { get; set; } = "x";\n    public int Q => a.Length;\n    public async Task<int> F(ref int x, params string[] y) { foreach (var z in y) { x += z?.Length ?? 0; } var f = (int q) => q * 2; return await G<int>(x) switch { 1 => 2, _ => 3 }; }\n    public static C<T> operator +(C<T> l, C<T> r) => l;\n  }\n}\n',
    "php": "<?php\nnamespace A\\B;\nuse X\\Y;\n#[Attr]\nabstract class C extends D implements I {\n  use T;\n  const X = 1;\n  private ?int $a = null;\n  public function f(int|string $x, &...$y): static { foreach ($y as $k => $v) { $this->a['b'] .= \"x $v\"; } return match (true) { $x > 1 => fn($q) => $q ** 2, default => null }; }\n}\n?>\n<p><?= $x ?></p>\n",
    "c": "#include <a.h>\n#define X(a) \\\n  a\ntypedef struct s { int a : 3; struct s *next; } s_t;\nstatic const char *names[] = { [0] = \"a\", \"b\" \"c\" };\nstatic inline long f(const s_t *p, int (*cb)(void *, int), ...) {\n  for (int i = 0; i < 3; i++) { p->next[i].a += (long) sizeof(s_t) * i ? 1 : 2; }\n  switch (x) { case 1: break; default: goto end; }\n  do { } while (0);\nend:\n  return -1;\n}\n",
}
BROKEN = {
    "python": ["def f(x)\n    pass\n", "def f():\n    '''open\n    return 1\n", "if x:\n        a\n    b\n", "print 'x'\n", "x = “a”\n", "<<<<<<< HEAD\nx = 1\n", "f(1\n", "use a::b;\n", "x = 1x\n"],
    "module": ["function f() { return 1;\n", "let x = 1;\n=======\nlet x = 2;\n", "const x: number = 1;\n", "import math\nfrom a import b\n", "f(“x”);\n", "let a = b c;\n", "with (a) { b }\n", "/* open\n"],
    "script": ["import x from 'y';\n", "export const x = 1;\n"],
    "typescript": ["export interface A { a: string\n", "let x: = 1;\n", "a:\n  - b: 1\n  - c: 2\n"],
    "go": ["package a\nfunc f() {\n", "func f() {}\n", "package a\nx := 1\n", "package a\nfunc f( {\n}\n", "package a\nfunc f() { x = = 1 }\n"],
    "rust": ["fn f( {}\n", "fn f() { let x = 1 let y = 2; }\n", "pub fn f() -> i64 {\n", "import math\n"],
    "java": ["class A { void f() { return 1 } }\n", "class A { int x = ; }\n", "package a\nimport b;\n", "class A {\n", "$ git pull\n"],
    "ruby": ["def f\n  1\n", "end\n", "if a > ( 1\n  b\nend\n", "x = 'open\n", "f(1, 2\n"],
    "csharp": ["class A { void F() { x = 1 } }\n", "class A {\n", "class A { int x = \"open; }\n", "pub fn f() {}\n"],
    "php": ["<?php\nfunction f( { }\n", "<?php\n$a = 1\n$b = 2;\n", "<?php\nclass A {\n", "<?php\n/* open\n"],
    "c": ["int f( { }\n", "int f(void) { return 1 }\n", "import math\nx = 1\n", "class A { public: int x; };\n", "<html></html>\n", "# Heading\n\nSome text here.\n"],
}


@pytest.mark.parametrize("name", sorted(LEXERS))
def test_grammars(tables, name):
    lexer = LEXERS[name](tables[name])
    assert lexer.first_error(VALID[name]) == -1
    assert lexer.first_error(VALID[name].replace("\n", "\r\n")) == -1
    assert lexer.first_error("package a\n" if name == "go" else "") == -1
    assert [text for text in BROKEN[name] if lexer.first_error(text) == -1] == []


def test_php_without_its_tag_is_text(tables):
    assert LEXERS["php"](tables["php"]).first_error("def f(:\n") == -1


def test_python_grammar_against_the_compiler(tables):
    """Mutated sources: the grammar must agree with the compiler on nearly all, and never reject a valid one."""
    lexer = LEXERS["python"](tables["python"])
    source = VALID["python"].split("\n")
    r = random.Random(8)
    missed = 0
    for _ in range(400):
        lines = list(source)
        i = r.randrange(len(lines))
        what = r.randrange(4)
        if what == 0:
            del lines[i]
        elif what == 1 and lines[i]:
            j = r.randrange(len(lines[i]))
            lines[i] = lines[i][:j] + lines[i][j + 1 :]
        elif what == 2:
            lines[i] = lines[i][: len(lines[i]) // 2]
        else:
            lines.insert(i, r.choice([")", "x y", "    z", "else:", "=======", "'''"]))
        text = "\n".join(lines)
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                compile(text, "x", "exec", dont_inherit=True)
            valid = True
        except (SyntaxError, ValueError):
            valid = False
        accepted = lexer.first_error(text) == -1
        assert accepted or not valid, text
        missed += accepted and not valid
    assert missed <= 40


def test_ambiguous_grammar_follows_every_parse():
    parser = Recogniser(build(Grammar("s = e\ne = e '+' e | N | e '?' | e '?' e ':' e\n")))
    ids = parser.tables.terminals
    run = lambda *t: parser.first_error([*(ids[x] for x in t), 0])
    assert run("N", "'+", "N", "'+", "N") == -1 and run("N", "'?") == -1 and run("N", "'?", "N", "':", "N") == -1 and run("N", "'+") == 2


def test_invalid_files(spark):
    rows = [("p", "a.py", "x = (", 1, 1), ("p", "a.py", "x = 1\n", 2, 2), ("p", "b.py", "x = 1", 1, 1), ("p", "b.py", "x = (", 2, 2), ("p", "b.py", "x = (", 2, 2), ("p", "c.md", "(", 1, 1), ("p", "d.go", None, 1, 1), ("p", "e.py", None, 1, 1), (None, "f.py", "(", 1, 1), ("q", "g.js", "f();\n" * 60_000, 1, None)]
    frame = spark.createDataFrame(rows, FILE).withColumns({"language": F.lit("clash"), "version": F.lit(1), "error_token": F.lit("x")})
    assert sorted(r["file_path"] for r in invalid.invalid_files(frame).collect()) == ["b.py", "d.go"]
    runs = spark.createDataFrame([(1, "p", 5), (1, "p", 5), (2, "p", None), (3, None, 1)], "run_id long, project_id string, files_indexed long")
    rates = {(r["project_id"], r["language"]): (r["files"], r["invalid"], r["files_reported"], r["files_stored"]) for r in invalid.invalid_rates(frame, runs).collect()}
    assert rates[("p", "python")] == (3, 1, 5, 5) and rates[("q", "module")] == (1, 0, None, 1) or rates[("q", "module")][:2] == (1, 0)
    assert invalid.invalid_files(spark.createDataFrame([], FILE)).count() == 0


def body(n, seed):
    r = random.Random(seed)
    return "\n".join(f"def {r.choice('abc')}{r.randint(0, 9**6)}(x, y):\n    z = x * {r.randint(1, 999)} + y\n    if z > {r.randint(1, 999)}:\n        return z\n    return y - {r.randint(1, 99)}\n" for _ in range(n))


def test_provenance(spark):
    shared = body(20, 1)
    table = "T = [\n" + "".join(f"  0x{i % 256:02x}, 0x{i * 7 % 256:02x}, 0x{i * 3 % 256:02x}, 0x{i * 5 % 256:02x},\n" for i in range(80)) + "]\n"
    minified = "!function(){" + "var a=function(t,r){for(var o=0;o<t.length;o++)r[o]=o.b;return r};" * 20 + "}();"
    files = [
        ("p1", "vendor/lib/x.py", shared), ("p2", "src/own.py", "# Copyright someone\n\n" + shared), ("p3", "app/y.py", shared.replace("\n", "\r\n")), ("p1", "gen.py", "# Code generated by toolish. DO NOT EDIT.\nx = 1\n"), ("p1", "mid.py", "x = 1\n\n# @generated by thing from a.schema\n"),
        ("p1", "num.py", "".join(f"def get_field_v{i}(m):\n    return m[{i}]\n\n" for i in range(12))), ("p1", "data.py", table), ("p1", "min.js", minified), ("p1", "hand.py", body(15, 2)), ("p1", "talk.py", 'BANNER = "generated by us, DO NOT EDIT"\n# Values generated by the meter are in ticks.\n' + body(9, 3)),
        ("p1", "small.py", "T = [1, 2, 3, 4]\n" + body(9, 4)), ("p1", "long.py", "S = \"" + "x y " * 300 + "\"\n" + body(12, 5)), ("p1", "vendor_portal/z.py", body(9, 6)), ("p1", "empty.py", ""), ("p1", "null.py", None), ("p1", "doc.md", "# Code generated by x. DO NOT EDIT."),
    ]
    rows = [(p, f, c, 1, 2) for p, f, c in files] + [("p1", "hand.py", "# Code generated by toolish. DO NOT EDIT.\n", 1, 1), ("p1", "gen.py", files[3][2], 1, 2)]
    frame = spark.createDataFrame(rows, FILE).withColumns({"kind": F.lit("clash"), "prints": F.lit(1), "fp": F.lit(2), "total": F.lit(3)})
    got = {(r["project_id"], r["file_path"]): r["kind"] for r in provenance.foreign_files(provenance.profile_files(frame)).collect()}
    assert got == {("p1", "vendor/lib/x.py"): "vendored", ("p2", "src/own.py"): "vendored", ("p3", "app/y.py"): "vendored", ("p1", "gen.py"): "generated", ("p1", "mid.py"): "generated", ("p1", "num.py"): "generated", ("p1", "data.py"): "data", ("p1", "min.js"): "minified"}
    assert provenance.foreign_files(provenance.profile_files(spark.createDataFrame([], FILE))).count() == 0


def test_winnowing_finds_a_shared_passage():
    codes = provenance._Codes()
    one, two = body(12, 1), body(12, 2)
    shared = body(6, 3)
    a, b = set(provenance.fingerprints(one + shared, codes).tolist()), set(provenance.fingerprints(two + "# note\n" + shared, codes).tolist())
    assert a & b and not set(provenance.fingerprints(one, codes).tolist()) & set(provenance.fingerprints(two, codes).tolist())
    assert len(provenance.fingerprints("", codes)) == 0 and len(provenance.fingerprints("x = 1", codes)) == 1


def test_spans_by_doubling():
    import numpy as np

    values = np.array([random.Random(i).randint(0, 10**6) for i in range(40)], dtype=np.uint64)
    for width in range(1, 41):
        runs = [values[i : i + width] for i in range(41 - width)]
        assert provenance._spans(values, width, lambda a, b, n: np.minimum(a, b)).tolist() == [int(r.min()) for r in runs]
        joined = provenance._spans(values, width, lambda a, b, n: a * np.uint64(pow(31, n, 1 << 64)) + b).tolist()
        assert joined == [sum(int(v) * 31 ** (width - 1 - j) for j, v in enumerate(r)) % (1 << 64) for r in runs]


PY = 'import x\n\n# Above the first.\n@deco("#")\ndef one(\n    a,\n):\n    return a\n\ndef two(a):\n    """Doc of it.\n\n    More.\n    """\n    return a\n\n# TODO: document\ndef three():\n    pass\n\n# far away\n\ndef four():\n    pass\n\ndef five():\n    r\'\'\'five\'\'\'\n    s = "# no"\n'
JS = "/**\r\n * Adds up what is left.\r\n */\r\n// eslint-disable-next-line\r\nexport function add(a) {\r\n    return a; // tail\r\n}\r\n\r\n// let x = add(1);\r\n// if (x) {\r\nfunction old() {\r\n}\r\n/** Adds. */\r\nfunction adding() { return `// no\r\n/* no */`; }\r\n"
RS = "/// Keeps the\n/// rest warm.\n#[inline]\n#[must_use]\npub fn keep(a: i64) -> i64 {\n    a\n}\n"


def test_documentation_pairs(spark):
    contents = spark.createDataFrame([("p", "a.py", PY, 1, 1), ("p", "b.js", JS, 1, 1), ("p", "c.rs", RS, 1, 1), ("p", "d.py", None, 1, 1)], FILE).withColumns({"kind": F.lit("x"), "text": F.lit(1), "line": F.lit(2)})
    at = lambda text, what: text.replace("\r\n", "\n").split("\n").index(next(x for x in text.replace("\r\n", "\n").split("\n") if what in x)) + 1
    nodes = [(1, "a.py", "one", at(PY, "def one"), None), (2, "a.py", "two", at(PY, "def two"), 15), (3, "a.py", "three", at(PY, "def three"), 19), (4, "a.py", "four", at(PY, "def four"), 24), (5, "a.py", "five", at(PY, "def five"), None), (6, "b.js", "add", at(JS, "function add("), None), (7, "b.js", "old", at(JS, "function old"), 12), (8, "b.js", "adding", at(JS, "function adding"), 15), (9, "c.rs", "keep", at(RS, "pub fn"), 7), (10, "d.py", "x", 1, 1), (11, "none.py", "x", 1, 1), (12, "a.py", None, None, None)]
    rows = [(i, "p", "Function", n, f, s, e) for i, f, n, s, e in nodes] + [(1, "p", "Function", "one", "a.py", nodes[0][3], None), (20, "p", "Type", "one", "a.py", nodes[0][3], None), (None, "p", "Function", "x", "a.py", 1, 1)]
    frame = spark.createDataFrame(rows, NODE).withColumns({"rank": F.lit(1), "doc": F.lit(2), "family": F.lit(3)})
    got = {r["node_id"]: (r["name"], r["doc_line"], r["doc"], r["code"]) for r in docpairs.code_pairs(frame, contents).collect()}
    assert set(got) == {1, 2, 6, 9}
    assert got[1][:3] == ("one", 3, "Above the first.") and got[1][3] == "def one(\n    a,\n):\n    return a"
    assert got[2][1] == at(PY, '"""Doc') and got[2][2].startswith("Doc of it.")
    assert got[6][:3] == ("add", 1, "Adds up what is left.") and got[6][3].endswith("// tail\n}")
    assert got[9][1] == 1 and got[9][2] == "Keeps the\nrest warm."
    none = spark.createDataFrame([], NODE)
    assert docpairs.documented_functions(none, contents).count() == 0 and docpairs.documented_functions(frame, spark.createDataFrame([], FILE)).count() == 0


@pytest.mark.parametrize("text,name", [("// ----", "f"), ("/** */", "f"), ('"""TBD"""', "f"), ("// FIXME: write docs", "f"), ("/// <summary>\n/// Description\n/// </summary>", "f"), ("// This function will tally the old kiln.", "tallyOldKiln"), ("# Tallies kilns", "tally_kiln"), ("// x = f(1);\n// if (x > 2) {", "f"), ("# noqa: C901", "f"), ("//go:noinline", "f"), ("// NOSONAR", "f"), ("/** {@inheritDoc} */", "f"), (None, "f"), ("", "f"), ("/*! lib v1.2 */", "f")])
def test_worthless(text, name):
    assert docpairs.useful_doc(text, name) is None


@pytest.mark.parametrize("text,name", [("// Keeps the kiln warm until noon.", "tallyKiln"), ("# Älteres wird nachts verdichtet.", "f"), ("/** 値は失われません。 */", "f"), ('"""Return the todo list of a user, newest first, without drafts."""', "todo"), ("// Returns nothing if it is full.", "f"), ("// Tally the kiln before the oven.", "tallyKiln")])
def test_useful(text, name):
    assert docpairs.useful_doc(text, name)


def test_a_comment_above_many_attributes(spark):
    text = "/// Counts what is left over.\n#[inline]\n// eslint-ignore\n#[cfg(a)]\n#[must_use]\n#[allow(b)]\nfn left() {}\n\n# x\n"
    python = "# Reads the ledger from its shelf.\n@route(\n    'a',\n    methods=['b'],\n)\n@cached\ndef shelf():\n    return 1\n"
    contents = spark.createDataFrame([("p", "a.rs", text, 1, 1), ("p", "b.py", python, 1, 1)], FILE)
    nodes = spark.createDataFrame([(1, "p", "Function", "left", "a.rs", 7, None), (2, "p", "Function", "shelf", "b.py", 7, None)], NODE)
    got = {r["node_id"]: (r["doc_line"], r["doc"]) for r in docpairs.documented_functions(nodes, contents).collect()}
    assert got == {1: (1, "Counts what is left over."), 2: (1, "Reads the ledger from its shelf.")}


def first_error(name, text):
    return invalid.lexer_of(name, invalid.all_tables()).first_error(text)


def test_patterns_at_the_beginning_of_a_line():
    assert first_error("module", "f();\n  /ab+c/.test(x);\n") == -1 and first_error("module", "x = a\n   / b / c;\n") == -1 and first_error("module", "  /ab+c/.test(x;\n") >= 0


def test_fields_of_formatted_strings():
    for text in ("f'{a} {b!r:>{w}} {{c}} {d[\"x\"]:%Y} {e=} {x if y else z}'", 'f"""{\n a\n}"""', "f''", "f'{a, b} {*c, d}'"):
        assert first_error("python", text) == -1, text
    for text in ("f'{a b}'", "f'{a'", "f'a}'", "f'{}'", "f'{a:{b c}}'"):
        assert first_error("python", text) >= 0, text


def test_undecided_is_a_state_of_its_own(monkeypatch):
    from kelpgraph.llm.parsing import tables

    parser = Recogniser(build(Grammar("s = e\ne = e '+' e | N\n")))
    ids = parser.tables.terminals
    monkeypatch.setattr(tables, "UNDECIDED", 2)
    assert parser.first_error([*[ids["N"], ids["'+"]] * 30, ids["N"], 0]) == -2


def test_texts_with_many_stacks_are_decided(spark):
    nest = lambda left, right: left * 20 + "1" + right * 20
    texts = {"js": "x = " + nest("(a=", ")") + ";\n", "ts": "x = " + nest("(a=", ")") + ";\n", "java": "class A { int f = " + nest("(a)(", ")") + "; }\n", "cs": "class A { int f = " + nest("(a)(", ")") + "; }\n", "c": "int f = " + nest("(a)(", ")") + ";\n"}
    rows = [("p", f"{kind}.{name}", text + more, 1, 1) for name, text in texts.items() for kind, more in (("good", ""), ("bad", "= ; }\n"))]
    rows.append(("p", "long.cs", "class A { bool f = " + "a < " * 3_000 + "1; }\n", 1, 1))
    frame = spark.createDataFrame(rows, FILE)
    assert sorted(r["file_path"] for r in invalid.invalid_files(frame).collect()) == sorted(f"bad.{name}" for name in texts)
    runs = spark.createDataFrame([], "run_id long, project_id string, files_indexed long")
    assert sorted((r["language"], r["files"], r["invalid"], r["undecided"]) for r in invalid.invalid_rates(frame, runs).collect()) == [("c", 2, 1, 0), ("csharp", 3, 1, 0), ("java", 2, 1, 0), ("module", 2, 1, 0), ("typescript", 2, 1, 0)]


def test_a_text_with_many_stacks_leaves_nothing_behind():
    parser = invalid.lexer_of("module", invalid.all_tables()).parser
    assert first_error("module", "f(x);\n") == -1
    before = len(parser.nodes), len(parser.node_ids), len(parser.sets), len(parser.set_ids), len(parser.steps)
    assert first_error("module", "x = " + "(a=" * 20 + "1" + ")" * 20 + ";\n") == -1
    assert before == (len(parser.nodes), len(parser.node_ids), len(parser.sets), len(parser.set_ids), len(parser.steps))


@pytest.mark.parametrize("text", ["s = e\ne = e '+' e | N\n", "s = a s N | N\na = | '+'\n", "s = e*\ne = '+'? e '+'? | N?\n", "s = s s | a | \na = b\nb = a | N b? '+'\n"])
def test_shared_stacks_tell_what_all_stacks_tell(text):
    grammar = Grammar(text)
    parser = Recogniser(build(grammar))
    ids = parser.tables.terminals
    sentences, seen = {(grammar.start,)}, set()  # what the grammar makes of up to five tokens, by replacing the first name
    done = set()
    while sentences:
        form = sentences.pop()
        at = next((i for i, x in enumerate(form) if x in grammar.names), None)
        if at is None:
            done.add(form)
            continue
        made = {form[:at] + grammar.rules[r][1] + form[at + 1 :] for r in grammar.names[form[at]]}
        made = {m for m in made if len(m) <= 8 and sum(x not in grammar.names for x in m) <= 5}
        sentences |= made - seen
        seen |= made
    words = [()]
    for _ in range(4):
        words += [(*w, t) for w in words if len(w) == len(words[-1]) for t in ("N", "'+")]
    for word in words:
        assert (parser.shared_error([*(ids[t] for t in word), 0]) == -1) == (word in done), word


def test_a_nul_is_not_the_end():
    for name, text in (("python", "x = 1\n\0 y = (((\n"), ("php", "<?php f();\0 g(((")):
        assert first_error(name, text) >= 0, text
    for name, text in (("python", "x = 'a\0b'\n"), ("php", "<?php f('\0');"), ("python", "")):
        assert first_error(name, text) == -1, text
