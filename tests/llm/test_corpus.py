"""Packing, mixing and residue of documents."""

import random

import pytest
from pyspark.sql import functions as F

from kelpgraph.llm import mixing, packing, residue
from kelpgraph.llm.tokens import VOCABULARY, count_tokens, encoding

DOC = "doc_id long, text string, source string, file_path string"
BINS = "bin_class string, capacity_tokens int"


def words(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice("river stone maple tower copper amber delta forest".split()) + r.choice(["", ",", "."]) for _ in range(n))


def test_token_counts_equal_the_tokenizer():
    encode = encoding(VOCABULARY).encode_ordinary
    for text in ["", "Hello, world's  end\n\n\t x_y 12345", "Ältere Werte ²½ 石の 🙂", words(300, 1), " \x1c a\u00a0b", "def f(x):\n    return x**2\n" * 20]:
        assert count_tokens(text) == len(encode(text))
    assert count_tokens(None) == 0


@pytest.fixture(scope="module")
def documents(spark):
    r = random.Random(2)
    rows = [(i, words(r.randint(1, 400), i), "a", None) for i in range(300)] + [(1000, words(4000, 7), "a", None), (1001, None, None, None), (1002, "", "b", None), (5, words(20, 5), "dup id", None), (1003, words(30, 5), "a", None), (1004, words(30, 5), "a", None)]
    return spark.createDataFrame(rows, DOC).withColumns({"tokens": F.lit("clash"), "shard": F.lit(1), "terms": F.lit(2), "at": F.lit(3)})


def test_packing_keeps_every_token_once(spark, documents):
    bins = spark.createDataFrame([("short", 128), ("long", 1024), ("short", 64), (None, 5), ("bad", None)], BINS)
    packed = packing.pack_documents(documents, bins, shard_tokens=15_000)
    sizes = sorted((r["doc_id"], r["tokens"]) for r in packing.described_documents(documents).collect())
    for name, capacity in (("short", 128), ("long", 1024)):
        rows = packed.where(F.col("bin_class") == name).collect()
        fill = {}
        for r in rows:
            fill[r["container"]] = fill.get(r["container"], 0) + r["end_token"] - r["start_token"]
        assert max(fill.values()) <= capacity
        per = {}
        for r in rows:
            per.setdefault(r["doc_id"], []).append((r["start_token"], r["end_token"]))
        assert set(per) == {d for d, _ in sizes}
        for doc, spans in per.items():
            lengths = sorted(t for d, t in sizes if d == doc)
            assert sum(b - a for a, b in spans) == sum(lengths)
            if len(lengths) == 1:
                spans.sort()
                assert spans[0][0] == 0 and all(x[1] == y[0] for x, y in zip(spans, spans[1:]))
                assert len(spans) == max(1, -(-lengths[0] // capacity))
        assert sum(fill.values()) / (capacity * len(fill)) > (0.9 if name == "long" else 0.75)
    assert set(r["bin_class"] for r in packed.select("bin_class").distinct().collect()) == {"short", "long"}


def test_packing_retrieves_neighbours():
    texts = ["apple pear plum quince"] * 3 + ["iron zinc copper lead"] * 3
    import numpy as np

    bucket = packing._Buckets()
    packed = [np.array([*(bucket[w] for w in t.split()), *([1] * 4)], dtype="<i4").tobytes() for t in texts]
    frequency = np.zeros(packing.TERMS, dtype="i8")
    for raw in packed:
        frequency[np.frombuffer(raw, dtype="<i4").reshape(2, -1)[0]] += 1
    index = packing.ShardIndex(packed, frequency, 100, 4.0)
    assert index.neighbours(0, np.ones(6, bool)).tolist() == [0, 1, 2]
    windows = packing.pack_shard(index, np.full(6, 4), 12)
    assert sorted(sorted(d for d, *_ in w) for w in windows) == [[0, 1, 2], [3, 4, 5]]


def test_neighbours_meet_in_a_shard(spark):
    """Of many shards, the documents about one thing share one, so that most windows are filled by neighbours of their seed."""
    r = random.Random(8)
    topics = [[a + b for b in ("lan", "mor", "tip", "zek", "vud", "hol")] for a in ("ba", "ce", "di", "fo", "gu", "ha", "ji", "ko", "lu", "ma")]
    rows = [(i, " ".join(r.choice(topics[i % 10]) if r.random() < 0.5 else r.choice("river stone maple tower".split()) for _ in range(30)), "a", None) for i in range(600)]
    packed = packing.pack_documents(spark.createDataFrame(rows, DOC), spark.createDataFrame([("w", 512)], BINS), shard_tokens=6_000).collect()
    shards = {}
    for x in packed:
        shards.setdefault(x["container"].split("-")[0], []).append(x["doc_id"] % 10)
    windows = {}
    for x in packed:
        windows.setdefault(x["container"], []).append(x["doc_id"] % 10)
    same = sum(max(map(w.count, set(w))) for w in windows.values())
    assert len(shards) >= 6 and same >= 0.75 * len(packed) and sum(x["how"] == "neighbour" for x in packed) >= 0.6 * len(packed)


def test_a_hot_word_is_spread(spark):
    rows = [(i, "alike " * 20 + f"w{i}", "a", None) for i in range(500)] + [(1000 + i, f"other{i % 7} thing", "a", None) for i in range(500)]
    packed = packing.pack_documents(spark.createDataFrame(rows, DOC), spark.createDataFrame([("w", 256)], BINS), shard_tokens=2_000).collect()
    per = {}
    for x in packed:
        shard = x["container"].split("-")[0]
        per[shard] = per.get(shard, 0) + x["end_token"] - x["start_token"]
    assert sorted(x["doc_id"] for x in packed) == [x[0] for x in rows] and len(per) >= 6 and max(per.values()) <= 3_000


def test_packing_empty(spark):
    bins = spark.createDataFrame([("short", 128)], BINS)
    assert packing.pack_documents(spark.createDataFrame([], DOC), bins).count() == 0
    only = spark.createDataFrame([(1, None, None, None)], DOC)
    assert [tuple(r)[2:6] for r in packing.pack_documents(only, bins).collect()] == [(1, 0, 0, 0)]


TARGET = "source string, target_share double, max_repeats int"


def test_mixing_follows_the_shares(spark):
    r = random.Random(3)
    sized = spark.createDataFrame([(i, s, r.randint(1, 60)) for i, s in enumerate(["big"] * 3000 + ["mid"] * 900 + ["tiny"] * 12 + [None] * 30 + ["other"] * 50)], "doc_id long, source string, tokens int")
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("tiny", 0.2, 3), ("none", 0.1, 1), (None, 0.4, 1), ("nan", float("nan"), 1), ("minus", -1.0, 1)], TARGET)
    mix = mixing.mix_sources(sized, targets, range_rows=500, budget=20_000).cache()
    rows = sorted(mix.collect(), key=lambda x: x["start"])
    assert all(a["start"] + a["tokens"] <= b["start"] + 60 for a, b in zip(rows, rows[1:])) and rows[-1]["start"] + rows[-1]["tokens"] <= 20_000
    assert [x["finish"] for x in rows] == sorted(x["finish"] for x in rows)
    seen = {}
    for x in rows:
        seen[(x["doc_id"], x["repeat"])] = seen.get((x["doc_id"], x["repeat"]), 0) + 1
    assert set(seen.values()) == {1} and max(x["repeat"] for x in rows if x["source"] == "tiny") == 3 and max(x["repeat"] for x in rows if x["source"] == "big") == 1
    shares = {x["source"]: x for x in mixing.reached_shares(mix, sized, targets).collect()}
    assert abs(shares["big"]["drawn_tokens"] / shares["mid"]["drawn_tokens"] - 5 / 3) < 0.05
    assert shares["tiny"]["drawn_tokens"] == 3 * shares["tiny"]["available_tokens"] and shares["none"]["drawn_tokens"] == 0


def test_mixing_prefix_sums_equal_brute_force(spark):
    r = random.Random(5)
    data = [(i, r.choice(["a", "b"]), r.randint(1, 9)) for i in range(400)]
    sized = spark.createDataFrame(data, "doc_id long, source string, tokens int")
    targets = spark.createDataFrame([("a", 0.7, 2), ("b", 0.3, 1)], TARGET)
    rows = mixing.mix_sources(sized, targets, range_rows=20, budget=10**9).collect()
    total = {s: sum(t for _, x, t in data if x == s) for s in "ab"}
    assert len(rows) == sum(2 if s == "a" else 1 for _, s, _ in data)
    for source, w in (("a", 0.7), ("b", 0.3)):
        used = 0
        for x in sorted((x for x in rows if x["source"] == source), key=lambda x: x["finish"]):
            used += x["tokens"]
            assert abs(x["finish"] - used / w) < 1e-6
        assert used == total[source] * (2 if source == "a" else 1)
    at = 0
    for x in sorted(rows, key=lambda x: x["start"]):
        assert x["start"] == at
        at += x["tokens"]


def test_a_large_source_of_small_weight_does_not_fill_one_range(spark):
    """Ranges of finish time hold equal numbers of tokens whatever the weights."""
    sized = spark.range(6000).selectExpr("id as doc_id", "case when id < 5000 then 'large' else 'small' end as source", "cast(10 as int) as tokens")
    targets = spark.createDataFrame([("large", 0.001, 1), ("small", 0.999, 1)], TARGET)
    mix = mixing.mix_sources(sized, targets, range_rows=200)
    rows = sorted(mix.collect(), key=lambda x: x["start"])
    assert [x["start"] for x in rows] == list(range(0, 60_000, 10)) and [x["finish"] for x in rows] == sorted(x["finish"] for x in rows)
    one = 5000 / 0.001 * 10
    served = [min(x["finish"] * 0.001, 50_000) + min(x["finish"] * 0.999, 10_000) for x in rows]
    slots = [min(29, int(x / 60_000 * 30)) for x in served]
    assert rows[-1]["finish"] > 0.5 * one and max(map(slots.count, set(slots))) <= 2 * 6000 / 30


def test_texts_are_counted_once(spark):
    rows = [(1, "same text", "Wiki-Page "), (2, "same text", "wiki_page"), (3, "same text", "readme"), (4, "other", None), (5, None, "readme"), (6, "", "readme"), (7, "x y", "README")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"n": F.lit("clash"), "times": F.lit(1), "tokens": F.lit("t")})
    assert sorted((r["doc_id"], r["source"]) for r in mixing.sized_documents(frame).collect()) == [(1, "wiki_page"), (4, None), (7, "readme")]


def test_mixing_empty(spark):
    sized = spark.createDataFrame([], "doc_id long, source string, tokens int")
    targets = spark.createDataFrame([("a", 1.0, 1)], TARGET)
    assert mixing.mix_sources(sized, targets).count() == 0
    assert mixing.mix_sources(spark.createDataFrame([(1, "a", 5)], "doc_id long, source string, tokens int"), spark.createDataFrame([], TARGET)).count() == 0


PROSE = "The old kettle is kept for 182 days once the funnel has been encoded twice. Callers should weigh the valve first, because the dredge cannot grow."
RESIDUE = {
    "placeholder": [f"# {{{{ project_name }}}}\n\n{PROSE}", f"{PROSE} Contact %(company)s for access.", f"Dear [Your Name Here],\n\n{PROSE}", f"Dear [Customer Name],\n\n{PROSE}", f"{PROSE}\n\n@@VERSION@@ {PROSE}", f"Welcome to <INSERT DESCRIPTION>! {PROSE}"],
    "filler": ["Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor.", "sample text " * 30, "Paragraph 1. Some placeholder words that will be replaced later.\n" * 4],
    "outline": ["# Project\n\n## Install\n\nTBD\n\n## Usage\n\nComing soon.", "# Title\n\n## Steps\n\n1.\n2.\n3.\n"],
    "error": ["Home | Docs | Sign in\n404\n\nThe page you asked for could not be found.\n(c) docs", '{"status": 503, "detail": "Service unavailable", "id": "d8c43ae1a7"} Ray d8c43ae1a7', "<h1>502</h1><p>Upstream sent no valid answer</p> Trace 767df44c07", "Access denied. You do not have permission to view this resource. Reference 99e332b13f", "Seite nicht gefunden\n\nDie angeforderte Seite existiert nicht mehr."],
    "scripts": ["Menu\nSearch\nAbout\nPlease enable JavaScript to view this page.", "JavaScript est désactivé. Veuillez l'activer pour afficher kiln."],
}
CONTENT = [
    PROSE, f"# Templates\n\nThe page writer replaces `{{{{ title }}}}` by the name.\n\n```html\n<h1>{{{{ title }}}}</h1>\n```\n\n{PROSE}", f"## Errors\n\nA 404 means that the oven was never indexed; a 503 that the girder is busy. {PROSE}", f'Reported: "Access denied" when the ledger is opened. {PROSE} Closed as fixed.', f"Use `${{HOME}}/.oven` as the folder. {PROSE}",
    f"Open points:\n- TODO: {PROSE}\n- done: {PROSE}", "GET /v1/kiln/{id}\n\n" + PROSE + "\n\nResponses\n  404  Not known.", f"To show a notice when scripts are off, wrap it in a noscript tag. {PROSE}", f"The value `undefined` is returned for a missing oven. {PROSE}", "", None, "   \n", "fix: brittle rivet", "def f(x):\n    return '{{ title }}'.format(x)\n\n\nclass A:\n    pass\n",
]


def test_residue(spark):
    rows = [(k, t) for k, texts in RESIDUE.items() for t in texts] + [(None, t) for t in CONTENT] + [("placeholder", RESIDUE["placeholder"][0])]
    background = [(None, PROSE + " " + words(40, i)) for i in range(60)] + [(None, words(60_000, 3))]
    everything = rows + background
    frame = spark.createDataFrame([(i, t, None, "a.py" if t and t.startswith("def") else None) for i, (_, t) in enumerate(everything)], DOC).withColumns({"kind": F.lit("clash"), "token": F.lit(1), "n": F.lit(2)})
    got = {r["doc_id"]: r["kind"] for r in residue.find_residue(frame).collect()}
    want = {i: k for i, (k, _) in enumerate(everything) if k}
    assert got == want
    assert residue.find_residue(spark.createDataFrame([], DOC)).count() == 0
