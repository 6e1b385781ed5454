"""Mixing sources to target weights, by weighted fair queueing.

Each distinct text is one document of one source. The documents of a source
are put into a random order, once for every repeat that is allowed. A
document's virtual finish time is the number of tokens its source has used up
with it, divided by the source's target share; all documents are then served
in the order of their finish times until the budget is spent. A source that
runs out of repeats leaves its share to the others in proportion to theirs.

Scale: cumulative sums over a source of any size are taken in two steps. Rows
fall into ranges of their random key, the ranges' sums (bounded by
``rows / range_rows``) get a running total, and only inside a range rows are
ordered one by one. The same is done over ranges of finish time to find where
the budget ends; their bounds are the quantiles of what all sources together
have served by a time, which the sources' totals give in advance, so that a
range holds the same number of tokens whatever the weights.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpgraph.llm.tokens import VOCABULARY, token_count

def plain_source(source: Column) -> Column:
    """A source name spelled the plain way: trimmed, lower case, words joined by ``_``; empty becomes null."""
    plain = F.regexp_replace(F.lower(F.trim(source)), r"[\s\-_]+", "_")
    return F.when(plain != "", plain)


def sized_documents(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, tokens): one row for each distinct text, with the smallest id of those in its source.

    Null and empty texts are no documents. A text that several sources hold
    belongs to the source that holds it most often, then the first by name; a
    null source only where there is no other. Texts are compared by two hashes
    of 64 and 32 bits and their length, and counted where they are read, so no
    text is shuffled; copies are added up before the shuffle.
    """
    rows = documents.select("doc_id", "text", plain_source(F.col("source")).alias("source")).where("text is not null and text <> ''")
    keyed = rows.select(F.xxhash64("text").alias("h1"), F.hash("text").alias("h2"), F.length("text").alias("n"), "source", "doc_id", token_count(F.col("text"), vocabulary).alias("tokens"))
    each = keyed.groupBy("h1", "h2", "n", "source").agg(F.count("*").alias("times"), F.min("doc_id").alias("doc_id"), F.max("tokens").alias("tokens"))
    best = F.min(F.struct(F.col("source").isNull().alias("none"), (-F.col("times")).alias("rank"), "source", "doc_id", "tokens")).alias("best")
    return each.groupBy("h1", "h2", "n").agg(best).select("best.doc_id", "best.source", "best.tokens")


def clean_targets(targets: DataFrame) -> DataFrame:
    """(source, share, max_repeats): shares scaled to sum 1.

    Rows with a null source or a share that is null, NaN or not above 0 are
    left out; a repeat cap that is null or below 1 counts as 1; of repeated
    sources the largest share counts.
    """
    good = targets.select(plain_source(F.col("source")).alias("source"), F.col("target_share").alias("share"), F.coalesce(F.greatest(F.col("max_repeats"), F.lit(1)), F.lit(1)).alias("max_repeats"))
    good = good.where(F.col("source").isNotNull() & (F.col("share") > 0) & ~F.isnan("share"))
    one = good.groupBy("source").agg(F.max_by(F.struct("share", "max_repeats"), "share").alias("t")).select("source", "t.share", "t.max_repeats")
    return one.withColumn("share", F.col("share") / F.sum("share").over(Window.partitionBy()))  # one row a source


def mix_sources(sized: DataFrame, targets: DataFrame, *, budget: int | None = None, seed: int = 13, range_rows: int = 50_000) -> DataFrame:
    """(doc_id, source, repeat, tokens, finish, start): the drawn documents in serving order.

    ``start`` is the number of tokens served before; a document is drawn if it
    starts and ends within the budget. ``budget`` defaults to the tokens of all
    documents whose source has a target. No text is drawn more often than
    ``max_repeats`` of its source. Documents without tokens, and sources
    without a target or targets without documents, draw nothing. Empty inputs
    give an empty result. Ties of finish times go by source, repeat, id.
    """
    spark = sized.sparkSession
    goals = F.broadcast(clean_targets(targets))  # a row a source, given by hand
    pool = sized.where("tokens > 0").join(goals, "source")
    totals = pool.groupBy("source").agg(F.sum("tokens").alias("available"), F.count("*").alias("n"), F.first("share").alias("share"), F.first("max_repeats").alias("max_repeats")).collect()  # a row a target
    everything = sum(t.available for t in totals)
    budget = everything if budget is None else budget
    rows = []
    for t in totals:
        # more rounds than the whole budget holds are never served
        rounds = min(t.max_repeats, max(1, -(-budget // t.available)))
        rows.append((t.source, t.available, float(t.share), rounds, max(1, -(-t.n // range_rows))))
    made = F.broadcast(spark.createDataFrame(rows, "source string, available long, w double, rounds int, ranges long"))
    each = pool.select("doc_id", "source", "tokens").join(made, "source").withColumn("repeat", F.explode(F.sequence(F.lit(1), F.col("rounds"))))
    key = F.xxhash64(F.lit(seed), F.col("repeat"), F.col("doc_id"))
    each = each.withColumn("key", key).withColumn("slot", F.floor((F.col("key").cast("double") / 2.0**64 + 0.5) * F.col("ranges")).cast("long"))
    span = Window.partitionBy("source", "repeat").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    before = each.groupBy("source", "repeat", "slot").agg(F.sum("tokens").alias("part")).withColumn("before", F.coalesce(F.sum("part").over(span), F.lit(0))).drop("part")
    inside = Window.partitionBy("source", "repeat", "slot").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    used = each.join(before, ["source", "repeat", "slot"]).withColumn("used", (F.col("repeat") - 1) * F.col("available") + F.col("before") + F.sum("tokens").over(inside))
    timed = used.select("doc_id", "source", "repeat", "tokens", (F.col("used") / F.col("w")).alias("finish"))
    slots = max(1, sum(t.n * r[3] for t, r in zip(totals, rows)) // range_rows)
    # tokens that all sources have served by a time: a monotone sum, one term a target; its equal parts are the ranges
    served = sum((F.least(F.col("finish") * F.lit(r[2]), F.lit(float(r[1] * r[3]))) for r in rows), F.lit(0.0))
    whole = float(sum(r[1] * r[3] for r in rows)) or 1.0
    timed = timed.withColumn("slot", F.least(F.lit(slots - 1), F.floor(served / F.lit(whole) * slots)).cast("int"))
    sums = timed.groupBy("slot").agg(F.sum("tokens").alias("part")).withColumn("before", F.coalesce(F.sum("part").over(Window.partitionBy().orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row for range_rows rows
    open_slots = sums.where(F.col("before") < budget).select("slot", "before")  # ranges past the budget end here, before any row is ordered
    order = Window.partitionBy("slot").orderBy("finish", "source", "repeat", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    placed = timed.join(open_slots, "slot").withColumn("start", F.col("before") + F.sum("tokens").over(order) - F.col("tokens"))
    return placed.where(F.col("start") + F.col("tokens") <= budget).select("doc_id", "source", "repeat", "tokens", "finish", "start")


def reached_shares(mix: DataFrame, sized: DataFrame, targets: DataFrame) -> DataFrame:
    """A row for each target: its share, what its source has, what was drawn, and the share reached."""
    goals = clean_targets(targets).withColumnRenamed("share", "target_share")
    have = sized.groupBy("source").agg(F.sum("tokens").alias("available_tokens"), F.count("*").alias("texts"))
    drawn = mix.groupBy("source").agg(F.sum("tokens").alias("drawn_tokens"), F.count("*").alias("drawn_documents"), F.max("repeat").alias("most_repeats"))
    out = goals.join(have, "source", "left").join(drawn, "source", "left").na.fill(0, ["available_tokens", "texts", "drawn_tokens", "drawn_documents", "most_repeats"])
    total = F.sum("drawn_tokens").over(Window.partitionBy())  # a row a target
    share = F.when(total > 0, F.col("drawn_tokens") / total).otherwise(0.0)
    return out.withColumn("reached_share", F.round(share, 6)).withColumn("target_share", F.round("target_share", 6))
