"""Generated definitions in columns, bundles with short lines."""

import pytest

from kelpgraph.llm import provenance as P

SHORT = "".join(f"let word{chr(97 + i)} = start;\n" for i in range(12))


@pytest.mark.parametrize("form", ["#define TOK_{i}\t{v}", "#define KIND_{i}   0x{v:x}", "#define KIND_{i} 0x{v:x}"])
def test_aligned_definitions_are_generated(form):
    assert P.kind_of("\n".join(form.format(i=i, v=i + 257) for i in range(40)), "src/a.h") == "generated"


def test_a_big_bundle_with_short_lines_is_minified():
    long = "\n".join("function(a,b){return a.c(b)?d[e]:f(g,h);};" * 40 for _ in range(30))
    assert P.kind_of(SHORT + long, "src/a.js") == "minified"


def test_a_hand_written_file_with_a_long_line_is_source():
    assert P.kind_of(SHORT * 3 + "function(a,b){return a.c(b)?d[e]:f(g,h);};" * 30, "src/a.js") is None
