"""Residue in long texts."""

import re
from collections import Counter

from kelpgraph.llm import residue as R

PROSE = "The old kettle is kept for some days once the funnel has been encoded twice, because the dredge cannot grow."


def index_of(texts):
    known = frozenset(R.vocabulary())
    seen = Counter()
    for text in texts:
        seen.update(known.intersection(re.findall(r"[^\W\d_]+", text.lower())))
    return R.build_index(seen, len(texts))


def judged(text, others=(), source=None):
    return R.judge(text, source, None, index_of([*others, text]))


WORDS = [a + b for a in ("kil", "val", "fun", "dred", "riv", "led", "ov", "gird", "wharf", "lat") for b in ("nak", "vem", "gol", "tir", "pesk", "dun", "zab", "mool")]


def test_a_notice_amid_much_navigation():
    menu = "\n".join(" | ".join(WORDS[i : i + 4]) for i in range(0, 80, 4))
    text = f"{menu}\nPage not found\n{menu}"
    assert len(text) > 600 and judged(text, [PROSE] * 50) == "error"


def test_a_long_outline_of_headings_and_stubs():
    text = "\n".join(f"## {' '.join(WORDS[i : i + 4])}\n\n- [ ]\n" for i in range(0, 80, 4))
    assert len(text) > 600 and judged(text, [PROSE] * 50) == "outline"


def test_a_long_error_page_that_a_third_of_all_rows_hold():
    lines = [x for x in R.ERRORS.strip().splitlines() if "X" not in x and x.isascii()][:30]
    page = "\n".join(x.capitalize() + "." for x in lines)
    assert len(page) > 600 and judged(page, [PROSE] * 60 + [page] * 29) == "error"


def test_code_is_told_by_all_lines():
    code, prose = "x = f(1);\n" * 450, f"{PROSE}\n" * 450
    slot = f"{PROSE} Contact %(company)s for access.\n"
    assert judged(code + 3 * prose + slot) == "placeholder"
    assert judged(prose + 8 * code + slot) is None


def test_notices_in_other_words():
    for text in ("Oops! We can't find that page.", "Sorry, this page isn't available.", "<html>\n<body>\n<h1>503</h1>\n<p>Service unavailable</p>\n</body>\n</html>"):
        assert judged(text, [PROSE] * 50) == "error", text


def test_customary_filler_of_any_kind():
    assert judged("Vestibulum habitant morbi tristique senectus et netus et malesuada fames ac turpis egestas.", [PROSE] * 50) == "filler"


def test_an_exemplar_amid_a_long_line():
    notice = "the page you are looking for does not exist please check the address and retry or go back to the home page"
    line = " ".join([notice] * 5)
    assert judged(f"{' '.join(WORDS[:5])} {line}", [PROSE] * 50) == "error"
    assert judged(f"{' '.join(WORDS)} {notice}", [PROSE] * 50) is None


def test_filler_words_are_learnt(spark):
    """Made-up words that stand among filler words, and hardly elsewhere, are filler too; the words of other texts are not."""
    import random

    r = random.Random(4)
    made = [a + b for a in ("ter", "nau", "col", "vel", "mag") for b in ("rum", "tapo", "ibri", "quax")]
    filler = [" ".join(r.choice(["lorem", "ipsum", "dolor"]) if r.random() < 0.15 else r.choice(made) for _ in range(30)) for _ in range(40)]
    pure = " ".join(r.choice(made) for _ in range(30))
    plain = [f"{PROSE} {' '.join(r.sample(WORDS, 6))}" for _ in range(200)]
    rows = [(i, t, None, None) for i, t in enumerate([*filler, pure, *plain, "Use lorem ipsum text in the draft. " + PROSE])]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, file_path string")
    got = {x["doc_id"]: x["kind"] for x in R.find_residue(frame).collect()}
    assert got == {i: "filler" for i in range(41)}
