"""Bounded reads of file contents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpgraph.functions.text import text_lines

# Limits of one answer.
DEFAULT_LINES, MOST_LINES, MOST_BYTES = 300, 4000, 300_000


def line_window(contents: DataFrame, *keys: str, start: int | None = None, end: int | None = None, full: bool = False) -> DataFrame:
    """(keys, first_line, last_line, total, text, truncated): a bounded window of each file's lines.

    Both bounds, or ``full``, give what is asked for up to MOST_LINES lines and
    MOST_BYTES bytes; one bound gives DEFAULT_LINES lines from or up to it; none
    the first DEFAULT_LINES. A first line above the byte limit is cut to it. A
    range that ends before it starts is empty.
    """
    keys = keys or ("file_path",)
    lined = contents.select(*keys, text_lines(F.col("content")).alias("lines")).withColumn("total", F.size("lines"))
    total = F.col("total")
    if start is not None and end is not None:
        low, high = F.least(F.lit(max(start - 1, 0)), total), F.least(F.lit(end), total)
    elif full:
        low, high = F.lit(0), total
    elif start is not None:
        low = F.least(F.lit(max(start - 1, 0)), total)
        high = F.least(low + DEFAULT_LINES, total)
    elif end is not None:
        high = F.least(F.lit(end), total)
        low = F.greatest(high - DEFAULT_LINES, F.lit(0))
    else:
        low, high = F.lit(0), F.least(F.lit(DEFAULT_LINES), total)
    asked = lined.withColumns({"low": low, "high": high})
    part = asked.withColumn("part", F.slice("lines", F.col("low") + 1, F.greatest(F.least(F.col("high") - F.col("low"), F.lit(MOST_LINES)), F.lit(0))))
    sizes = F.transform("part", lambda x: F.octet_length(x).cast("long") + 1)
    # the longest beginning whose lines and joints stay within the byte limit
    start_state = F.struct(F.lit(0).cast("long").alias("bytes"), F.lit(0).alias("kept"), F.lit(True).alias("open"))
    kept = F.aggregate(sizes, start_state, lambda s, x: F.struct((s["bytes"] + x).alias("bytes"), (s["kept"] + F.when(s["open"] & (s["bytes"] + x - 1 <= MOST_BYTES), 1).otherwise(0)).alias("kept"), (s["open"] & (s["bytes"] + x - 1 <= MOST_BYTES)).alias("open")))
    done = part.withColumn("kept", kept["kept"])
    wide = F.octet_length(F.element_at("part", 1)) > MOST_BYTES
    cut = F.expr(f"make_valid_utf8(cast(substring(cast(element_at(part, 1) as binary), 1, {MOST_BYTES}) as string))")
    text = F.when((F.size("part") > 0) & wide, F.rtrim(cut, F.lit("�"))).otherwise(F.array_join(F.slice("part", 1, F.col("kept")), "\n"))
    last = F.col("low") + F.when((F.size("part") > 0) & wide, 1).otherwise(F.col("kept"))
    limit = F.when(F.lit(start is None and end is None and not full), total).otherwise(F.col("high"))
    return done.select(*keys, (F.col("low") + 1).cast("int").alias("first_line"), last.cast("int").alias("last_line"), "total", text.alias("text"), ((last < limit) | ((F.size("part") > 0) & wide)).alias("truncated"))
