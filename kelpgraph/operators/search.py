"""Search by name, by phrase and by meaning."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpgraph.functions.text import fold, folded_phrase, folded_tokens, like_ascii
from kelpgraph.functions.vector import cosine, usable

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
SNIPPET_TOKENS = 20


def search_by_name(nodes: DataFrame, pattern: str, *, limit: int | None = 20) -> DataFrame:
    """Nodes whose name holds the pattern, by name and id."""
    found = nodes.where(like_ascii(F.col("name"), pattern))
    return found.orderBy("name", "id").limit(limit) if limit is not None else found


def phrase_counts(texts: DataFrame, query: str, text: str = "content") -> DataFrame:
    """``texts`` with ``hits`` (places of the phrase) and ``tokens`` (length in tokens)."""
    phrase = folded_phrase(query)
    flat = folded_tokens(F.col(text))
    # neighbouring hits share a blank, so blanks are doubled before counting
    wide = F.replace(flat, F.lit(" "), F.lit("  "))
    needle = " " + phrase.replace(" ", "  ") + " "
    hits = (F.length(wide) - F.length(F.replace(wide, F.lit(needle), F.lit("")))) / len(needle) if phrase else F.lit(0)
    tokens = F.when(F.trim(flat) == "", 0).otherwise(F.length(F.trim(flat)) - F.length(F.replace(F.trim(flat), F.lit(" "), F.lit(""))) + 1)
    return texts.withColumns({"hits": hits.cast("long"), "tokens": tokens.cast("long")})


def search_phrase(texts: DataFrame, query: str, *keys: str, text: str = "content", limit: int | None = 20) -> DataFrame:
    """(keys, rank): texts that hold the phrase, best BM25 rank first (the rank is negative), ties by key.

    Whole tokens match, in any case and without accents. A query without a
    token finds nothing. Corpus size, mean length and document frequency cover
    all texts.
    """
    counted = phrase_counts(texts.where(F.col(text).isNotNull()), query, text).select(*keys, "hits", "tokens")
    corpus = counted.agg(F.count("*").alias("n"), F.avg("tokens").alias("mean"), F.sum((F.col("hits") > 0).cast("long")).alias("df"))
    idf = F.greatest(F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(LEAST_IDF))
    weight = F.col("hits") * (K1 + 1) / (F.col("hits") + K1 * (1 - B + B * F.col("tokens") / F.col("mean")))
    scored = counted.where("hits > 0").crossJoin(F.broadcast(corpus))  # corpus is one row
    ranked = scored.select(*keys, (-idf * weight).alias("rank"))
    return ranked.orderBy("rank", *keys).limit(limit) if limit is not None else ranked


def snippet(text: Column, query: str, tokens: int = SNIPPET_TOKENS) -> Column:
    """An excerpt of at most ``tokens`` tokens around the first hit, marked with ``>>>`` and ``<<<``; null without a hit."""
    phrase = folded_phrase(query).split()

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        token = re.compile(r"[^\W_]+")
        wanted = re.compile(r"(?<![^\W_])" + r"[\W_]+".join(map(re.escape, phrase)) + r"(?![^\W_])") if phrase else None

        def cut(value: str | None) -> str | None:
            if not value or wanted is None:
                return None
            folded = fold(value)
            if len(folded) != len(value):  # lower case may be longer; then each character is folded by itself
                folded = "".join(fold(c)[:1] or c for c in value)
            hit = wanted.search(folded)
            if hit is None:
                return None
            before = [m.span() for m in token.finditer(value, 0, hit.start())]
            after = [m.span() for m in token.finditer(value, hit.end())]
            room = max(0, tokens - len(phrase))
            left = min(len(before), room // 2)
            right = min(len(after), room - left)
            left = min(len(before), room - right)
            begin = before[-left][0] if left else hit.start()
            end = after[right - 1][1] if right else hit.end()
            return (" ... " if left < len(before) else "") + value[begin : hit.start()] + ">>>" + value[hit.start() : hit.end()] + "<<<" + value[hit.end() : end] + (" ... " if right < len(after) else "")

        return pd.Series([cut(t) for t in texts], dtype=object)

    return run(text)


def current_embeddings(embeddings: DataFrame) -> DataFrame:
    """The row with the latest ``embedded_at`` (then id) of each (node_id, model): one vector for each."""
    others = [c for c in embeddings.columns if c not in ("node_id", "model")]
    last = F.max_by(F.struct(*others), F.struct("embedded_at", "id")).alias("last")
    return embeddings.groupBy("node_id", "model").agg(last).select("node_id", "model", "last.*")


def semantic_search(embeddings: DataFrame, model: str, vector: list[float], *, limit: int = 10) -> DataFrame:
    """(node_id, score): the usable vectors of the model most similar to a query vector, ties by node."""
    rows = embeddings.where((F.col("model") == model) & usable(F.col("embedding"), F.col("dim")))
    query = F.array(*[F.lit(float(x)) for x in vector])
    return rows.select("node_id", cosine(F.col("embedding"), query).alias("score")).orderBy(F.desc("score"), "node_id").limit(limit)


def similar_within(rows: DataFrame, group: str, key: str, vector: str, *, k: int = 3) -> DataFrame:
    """For each group its first row by key against the group's others: the k most similar, (group, key, score, place).

    The anchors are one row a group; their join with the group is on the group.
    """
    anchors = rows.groupBy(group).agg(F.min_by(F.struct(F.col(key).alias("k"), F.col(vector).alias("v")), key).alias("anchor"))
    scored = rows.join(anchors, group).where(F.col(key) != F.col("anchor.k")).select(group, key, F.round(cosine(F.col(vector), F.col("anchor.v")), 6).alias("score"))
    order = Window.partitionBy(group).orderBy(F.desc("score"), key)
    return scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def split_reusable(pending: DataFrame, snapshot: DataFrame) -> DataFrame:
    """``pending`` (qualified_name, model, chunk_text, ...) with ``reuse``: its text equals the snapshot's under the same name and model."""
    old = snapshot.groupBy("qualified_name", "model").agg(F.max_by("chunk_text", F.struct("embedded_at", "id")).alias("old_text"))
    return pending.join(old, ["qualified_name", "model"], "left").withColumn("reuse", F.coalesce(F.col("old_text") == F.col("chunk_text"), F.lit(False))).drop("old_text")


def enrich_hits(hits: DataFrame, nodes: DataFrame) -> DataFrame:
    """Hits with their node's columns; hits of unknown nodes leave."""
    return hits.join(nodes.select(F.col("id").alias("node_id"), "kind", "name", "qualified_name"), "node_id")
