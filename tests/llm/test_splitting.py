import random

import pytest
from pyspark.sql import functions as F

from kelpgraph.llm import splitting as S

ITEM = "src string, item_id long, text string"


def prose(n, seed=1):
    r = random.Random(seed)
    out = []
    while sum(map(len, out)) < n:
        words = " ".join(r.choice(["river", "naïve", "石", "🙂", "stone", "x"]) for _ in range(r.randint(3, 30)))
        out.append(words + r.choice([". ", "! ", "\n", "\n\n", "。", "\r\n", ", "]))
    return "".join(out)


def rebuilt(pieces, overlap):
    rows = sorted(pieces, key=lambda r: r["piece_no"])
    return "".join(r["text"] if i == 0 else r["text"][min(overlap, rows[i - 1]["end_char"]) :] for i, r in enumerate(rows)), rows


@pytest.mark.parametrize("limit,overlap,range_bytes", [(1500, 150, 1 << 16), (200, 20, 1600), (200, 0, 1600), (100, 60, 900)])
def test_round_trip(spark, limit, overlap, range_bytes):
    text = prose(20_000, limit + overlap)
    raw = text.encode()
    pieces = S.split_items(spark.createDataFrame([("s", 1, text)], ITEM), limit=limit, overlap=overlap, range_bytes=range_bytes).collect()
    whole, rows = rebuilt(pieces, overlap)
    assert whole == text and [r["piece_no"] for r in rows] == list(range(len(rows)))
    for r in rows:
        assert len(r["text"]) <= limit and text[r["start_char"] : r["end_char"]] == r["text"] and raw[r["start_byte"] : r["end_byte"]].decode() == r["text"]
    for a, b in zip(rows, rows[1:]):
        assert b["start_char"] == max(0, a["end_char"] - overlap)


def test_text_without_a_boundary(spark):
    text = "é" * 7000
    pieces = S.split_items(spark.createDataFrame([("s", 1, text)], ITEM), limit=200, overlap=10, range_bytes=1600).collect()
    assert rebuilt(pieces, 10)[0] == text and max(len(r["text"]) for r in pieces) <= 200


def test_cuts_where_the_text_pauses():
    assert S.best_cut("aaaa\n\nbbbb cc. dd", 2, 12) == 6
    assert S.best_cut("aaaa bbbb\ncccc dd", 2, 14) == 10
    assert S.best_cut("One two. Three four", 2, 15) == 9
    assert S.best_cut("aaaaaaaaaa", 2, 8) == 8


def test_only_oversized_items(spark):
    rows = [("a", 1, "x" * 1500), ("a", 2, "y " * 751), ("a", 2, "y " * 751), ("a", 3, None), ("a", 4, ""), ("b", None, "z " * 900)]
    frame = spark.createDataFrame(rows, ITEM).withColumns({"range_no": F.lit("clash"), "raw": F.lit(1), "total": F.lit(2)})
    got = S.split_items(frame).groupBy("src", "item_id").count().collect()
    assert {(r["src"], r["item_id"]) for r in got} == {("a", "2"), ("b", "")}
    assert S.split_items(spark.createDataFrame([], ITEM)).count() == 0


def test_bad_parameters(spark):
    frame = spark.createDataFrame([], ITEM)
    with pytest.raises(ValueError):
        S.split_items(frame, limit=10, overlap=10)
    with pytest.raises(ValueError):
        S.split_items(frame, limit=1000, range_bytes=2000)


def test_giant_file_by_ranges(spark, tmp_path):
    text = prose(120_000, 4)
    path = tmp_path / "big.txt"
    path.write_bytes(text.encode())
    (tmp_path / "small.txt").write_text("tiny")
    pieces = S.split_files(spark, [str(path), str(tmp_path / "small.txt")], limit=400, overlap=30, range_bytes=5000).collect()
    assert {r["item_id"] for r in pieces} == {str(path)} and rebuilt(pieces, 30)[0] == text


@pytest.mark.parametrize("range_bytes", [3300, 5000, 8 << 20])
def test_bytes_that_are_no_utf8(spark, tmp_path, range_bytes):
    """Every byte comes back, in pieces whose byte places are exact, over many ranges."""
    r = random.Random(9)
    raw = bytearray(prose(60_000, 8).encode())
    for _ in range(3000):
        raw[r.randrange(len(raw))] = r.choice([0x80, 0xBF, 0xC3, 0xE2, 0xF0, 0xFF, 0xED])
    path = tmp_path / "bad.txt"
    path.write_bytes(raw)
    rows = sorted(S.split_files(spark, [str(path)], limit=400, overlap=30, range_bytes=range_bytes).collect(), key=lambda x: x["piece_no"])
    whole = bytes(raw).decode("utf-8", errors="surrogateescape")
    assert [x["piece_no"] for x in rows] == list(range(len(rows))) and rows[0]["start_byte"] == 0 and rows[-1]["end_byte"] == len(raw)
    for x in rows:
        text = whole[x["start_char"] : x["end_char"]]
        assert text.encode("utf-8", errors="surrogateescape") == raw[x["start_byte"] : x["end_byte"]]
        assert x["text"] == S._BAD.sub("\ufffd", text) and len(text) <= 400
    for a, b in zip(rows, rows[1:]):
        assert b["start_char"] == a["end_char"] - 30


def test_section_texts(spark):
    contents = spark.createDataFrame([("p", "a.md", "one\r\ntwo\r\nthree\r\n", 1, 1), ("p", "a.md", "old", 1, 0), ("p", "b.py", "x\ny", 1, 1), ("p", "c.md", None, 1, 1)], "project_id string, file_path string, content string, run_id long, indexed_at int")
    sections = spark.createDataFrame([(1, "p", "a.md", 2, None), (2, "p", "a.md", 1, 99), (3, "p", "a.md", 1, 2), (3, "p", "a.md", 1, 2), (4, "p", "none.md", 1, 2), (5, "p", "a.md", 9, 10), (6, "p", "a.md", None, 2), (None, "p", "a.md", 1, 2)], "section_id long, project_id string, file_path string, start_line int, end_line int")
    got = {r["item_id"]: r["text"] for r in S.section_items(sections, contents).collect()}
    assert got == {1: "two\nthree", 2: "one\ntwo\nthree", 3: "one\ntwo"}
