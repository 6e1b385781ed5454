"""Splitting oversized items at natural boundaries, by byte ranges with halos.

An item is a run of bytes (UTF-8), in a column or in a file. It is worked on in
ranges of ``range_bytes``; a worker sees one range and a halo around it, never
the whole item. Each range owns the bytes from its anchor to the next range's
anchor. The anchor is the best boundary within ``limit - overlap`` characters
after the range's first byte, a rule that the range before and the range itself
apply to the same bytes in their halos, so both find the same place. Inside,
cuts are made one after the other, each at the best boundary of the allowed
window: after a blank line, else after a line, else after a sentence, else
after white space, else anywhere between two characters. A piece starts exactly
``overlap`` characters before the cut it follows, or at the item's beginning.

There are two passes. The first gives a row a range: how many pieces and how
many fresh characters it makes. Prefix sums over these small tables stitch them;
in the second pass each range emits its pieces with their numbers and places.
Bytes that are no UTF-8 are a character each, so that no byte is lost and all
places stay exact; they come back as replacement characters.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LIMIT = 1500
OVERLAP = 150
RANGE_BYTES = 1 << 16
_SENTENCE = re.compile(r"[.!?][\"')\]]*\s+|[。！？]")
_SPACE = re.compile(r"\s+")
SUMS = "src string, item_id string, range_no int, made int, fresh long"
PIECE = "src string, item_id string, piece_no long, start_char long, end_char long, start_byte long, end_byte long, text string"
_BAD = re.compile("[\udc80-\udcff]")


def best_cut(text: str, low: int, high: int) -> int:
    """The best place to cut ``text`` in (low, high]; the text goes on after high or ends there."""
    at = text.rfind("\n\n", low, high)
    if at >= low:
        return at + 2
    at = text.rfind("\n", low, high)
    if at >= low:
        return at + 1
    for pattern in (_SENTENCE, _SPACE):
        last = -1
        for m in pattern.finditer(text, low, high):
            last = m.end()
        if last > low:
            return last
    return high


def _window_cut(text: str, at: int, step: int) -> int:
    """The cut that follows one at ``at``, with at most ``step`` characters between them."""
    return best_cut(text, at + max(1, step // 2), min(len(text), at + step))


def decoded(data: bytes, skip: int) -> tuple[str, np.ndarray]:
    """The text of a range with its halos, and the byte of ``data`` at which each character and the end stand.

    Up to three bytes that continue a character begun before ``data`` are left
    out; a byte that is no UTF-8 is one character of its own (a lone surrogate).
    """
    lead = 0
    while skip and lead < 3 and lead < len(data) and data[lead] & 0xC0 == 0x80:
        lead += 1
    text = data[lead:].decode("utf-8", errors="surrogateescape")
    codes = np.frombuffer(text.encode("utf-32-le", errors="surrogatepass"), dtype="<u4")
    sizes = 1 + (codes >= 0x80).astype("i8") + (codes >= 0x800) + (codes >= 0x10000)
    sizes[(codes >= 0xDC80) & (codes <= 0xDCFF)] = 1
    return text, np.concatenate([[lead], lead + np.cumsum(sizes)])


def range_pieces(data: bytes, skip: int, own: int, first: bool, last: bool, limit: int, overlap: int) -> tuple[int, list[tuple[int, int, int]], str, np.ndarray]:
    """Pieces of one range: (characters owned, [(lead chars, start, end)], decoded text, its bytes).

    ``data`` holds the range and its halos; ``skip`` bytes of it stand before
    the range, the range has ``own`` bytes. Starts and ends are offsets in the
    decoded text. A character that a border cuts belongs to the range before.
    """
    step = limit - overlap
    text, places = decoded(data, skip)
    begin, border = (int(np.searchsorted(places[:-1], at)) for at in (skip, skip + own))
    start = begin if first else _window_cut(text, begin, step)
    stop = len(text) if last else _window_cut(text, border, step)
    pieces = []
    at = start
    while at < stop:
        cut = stop if stop - at <= step else _window_cut(text, at, step)
        back = max(0, at - overlap) if (at > start or not first) else at
        pieces.append((at - back, back, cut))
        at = cut
    return stop - start, pieces, text, places


def _batch(rows: list[tuple], names: str) -> pa.RecordBatch:
    fields = [f.strip().split(" ") for f in names.split(",")]
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}
    columns = zip(*rows) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, type=kinds[t]) for c, (_, t) in zip(columns, fields)], names=[n for n, _ in fields])


def _stitched(ranges: DataFrame, read, limit: int, overlap: int) -> DataFrame:
    """The pieces of all ranges. ``read`` makes (src, item_id, range_no, data, skip, own, first, last, offset) of a row of ``ranges``, of its columns but the last two."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                src, item, number, data, skip, own, first, last, _ = read(*row)
                fresh, pieces, _, _ = range_pieces(data, skip, own, first, last, limit, overlap)
                out.append((src, item, number, len(pieces), fresh))
            yield _batch(out, SUMS)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for *row, made, fresh in zip(*(c.to_pylist() for c in batch.columns)):
                src, item, _, data, skip, own, first, last, offset = read(*row)
                _, pieces, text, places = range_pieces(data, skip, own, first, last, limit, overlap)
                base = offset - skip
                start_of = pieces[0][1] + pieces[0][0] if pieces else 0
                for n, (_, start, end) in enumerate(pieces):
                    at = fresh + start - start_of
                    out.append((src, item, made + n, at, at + end - start, base + int(places[start]), base + int(places[end]), _BAD.sub("\ufffd", text[start:end])))
                    if len(out) >= 2000:
                        yield _batch(out, PIECE)
                        out = []
            if out:
                yield _batch(out, PIECE)

    keys = ["src", "item_id", "range_no"]
    run = Window.partitionBy("src", "item_id").orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranges.mapInArrow(count, SUMS).select(*keys, F.coalesce(F.sum("made").over(run), F.lit(0)).alias("made_before"), F.coalesce(F.sum("fresh").over(run), F.lit(0)).alias("fresh_before"))
    return ranges.join(sums, keys).select(*ranges.columns, "made_before", "fresh_before").mapInArrow(emit, PIECE)


def _checked(limit: int, overlap: int, range_bytes: int) -> int:
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be at least 0 and below the limit")
    if range_bytes < 8 * limit:
        raise ValueError("a range must hold at least eight pieces")
    return 4 * (limit + overlap) + 8


def split_items(items: DataFrame, *, limit: int = LIMIT, overlap: int = OVERLAP, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(src, item_id, piece_no, start_char, end_char, start_byte, end_byte, text) of items longer than ``limit`` characters.

    ``items`` has src, item_id and text; further columns are ignored. Items of
    at most ``limit`` characters and null texts need no split and give no rows.
    Each piece has at most ``limit`` characters; taking ``overlap`` characters
    off every piece but the first and joining gives the text again. Repeated
    (src, item_id, text) rows count once. item_id comes back as a string; a null src
    or item_id comes back as ''.
    """
    halo = _checked(limit, overlap, range_bytes)
    big = items.where(F.length("text") > limit).select(F.coalesce("src", F.lit("")).alias("src"), F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.encode(F.col("text"), "UTF-8").alias("raw")).distinct()
    # the item is cut into slices, and only these leave it: no range carries the whole
    spot = lambda i: i * range_bytes - F.least(i * range_bytes, F.lit(halo))
    slices = F.transform(F.sequence(F.lit(0), F.floor((F.octet_length("raw") - 1) / range_bytes).cast("int")), lambda i: F.struct(i.alias("range_no"), F.substring(F.col("raw"), spot(i) + 1, i * range_bytes - spot(i) + range_bytes + halo).alias("data")))
    ranges = big.select("src", "item_id", F.octet_length("raw").cast("long").alias("total"), F.explode(slices).alias("s")).select("src", "item_id", "s.range_no", "total", "s.data")

    def read(src: str, item: str, number: int, total: int, data: bytes) -> tuple:
        offset = number * range_bytes
        return src, item, number, data, min(offset, halo), min(range_bytes, total - offset), number == 0, offset + range_bytes >= total, offset

    return _stitched(ranges, read, limit, overlap)


def split_files(spark: SparkSession, paths: list[str], *, limit: int = LIMIT, overlap: int = OVERLAP, range_bytes: int = 8 << 20) -> DataFrame:
    """Pieces of text files on storage that all executors mount; each worker reads only its range and halo.

    src is ``file`` and item_id the path. Files of at most ``limit`` bytes give
    no rows. Bytes that are no UTF-8 come back as replacement characters, one each;
    sizes and bytes are read by the executors, the driver holds the paths only.
    """
    import os

    halo = _checked(limit, overlap, range_bytes)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _batch([("file", p, os.path.getsize(p)) for p in batch.column(0).to_pylist()], "src string, item_id string, total long")

    files = spark.createDataFrame([(p,) for p in paths], "path string").distinct().mapInArrow(measure, "src string, item_id string, total long").where(F.col("total") > limit)
    numbers = F.explode(F.sequence(F.lit(0), F.floor((F.col("total") - 1) / range_bytes).cast("int")))
    ranges = files.select("src", "item_id", numbers.alias("range_no"), "total").repartition("item_id", "range_no")

    def read(src: str, path: str, number: int, total: int) -> tuple:
        offset = number * range_bytes
        skip = min(offset, halo)
        own = min(range_bytes, total - offset)
        with open(path, "rb") as file:
            file.seek(offset - skip)
            data = file.read(skip + own + halo)
        return src, path, number, data, skip, own, number == 0, offset + range_bytes >= total, offset

    return _stitched(ranges, read, limit, overlap)


def file_lines(content: Column) -> Column:
    """The lines of a text: ended by ``\\n`` or ``\\r\\n``, without their ends; no line after the last end."""
    lines = F.split(content, "\n", -1)
    ends = F.when(F.endswith(content, F.lit("\n")) | (content == ""), F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)
    return F.transform(ends, lambda line: F.regexp_replace(line, "\r$", ""))


def section_items(sections: DataFrame, contents: DataFrame) -> DataFrame:
    """(src, item_id, text) of the sections, from the current content of their markdown files.

    An ``end_line`` that is null or past the end means the last line. Sections
    of an unknown file, with a null id, a start below 1 or past the end have no
    text. Repeated rows count once.
    """
    from kelpgraph.llm.sources import current_files

    files = current_files(contents.where(F.col("file_path").rlike(r"\.(md|markdown)$")))
    wanted = sections.select("section_id", "project_id", "file_path", "start_line", "end_line").where("section_id is not null and start_line >= 1").distinct()
    lined = files.select("project_id", "file_path", file_lines(F.col("content")).alias("lines"))
    joined = wanted.join(lined, ["project_id", "file_path"])
    last = F.least(F.coalesce("end_line", F.size("lines")), F.size("lines"))
    text = F.array_join(F.expr("slice(lines, start_line, greatest(0, last - start_line + 1))"), "\n")
    return joined.withColumn("last", last).where("last >= start_line").select(F.lit("section").alias("src"), F.col("section_id").alias("item_id"), text.alias("text"))


def chunk_items(embeddings: DataFrame) -> DataFrame:
    """(src, item_id, text) of all rows of node_embeddings."""
    return embeddings.where("id is not null").select(F.lit("chunk").alias("src"), F.col("id").alias("item_id"), F.col("chunk_text").alias("text"))
