"""The queries of the training-data operators, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kelpgraph.llm import credentials, docpairs, invalid, mixing, packing, provenance, residue, splitting, vectors
from kelpgraph.session import cut_lineage, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.similar_pairs(table(spark, sf_dir, "node_embeddings"), k=5, min_score=0.90)


def p1_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 most similar of all nodes for every node whose id is divisible by 50."""
    return vectors.search_vectors(table(spark, sf_dir, "node_embeddings"), F.col("node_id") % 50 == 0, k=10)


def p1_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of both searches by codes against the exact scan, for the nodes whose id is divisible by 50."""
    rows, asked = table(spark, sf_dir, "node_embeddings"), F.col("node_id") % 50 == 0
    one = vectors.search_recall(rows, asked).withColumn("search", F.lit("scan"))
    return one.unionByName(vectors.pair_recall(rows, asked).withColumn("search", F.lit("cells")))


def _foreign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provenance.foreign_files(cut_lineage(provenance.profile_files(table(spark, sf_dir, "file_contents"))))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _foreign(spark, sf_dir).select("project_id", "file_path").distinct()


def p2_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that no one wrote by hand, counted by project and kind."""
    return _foreign(spark, sf_dir).groupBy("project_id", "kind").agg(F.count("*").alias("files"))


def _credentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.find_credentials(credentials.credential_items(table(spark, sf_dir, "node_embeddings"), table(spark, sf_dir, "search_hits")))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _credentials(spark, sf_dir)
    return found.select("src", "row_id", F.explode(F.col("lines").cast("array<long>")).alias("line_no")).distinct()


def p3_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts that hold credentials, with these made unreadable."""
    return _credentials(spark, sf_dir).select("src", "row_id", "redacted").distinct()


def _oversized(spark: SparkSession, sf_dir: str) -> DataFrame:
    sections = splitting.section_items(table(spark, sf_dir, "sections"), table(spark, sf_dir, "file_contents"))
    return sections.unionByName(splitting.chunk_items(table(spark, sf_dir, "node_embeddings")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = splitting.split_items(_oversized(spark, sf_dir))
    return pieces.where("piece_no = 0").select("src", F.col("item_id").cast("long").alias("item_id")).distinct()


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece with its place in the item, in characters and bytes."""
    return splitting.split_items(_oversized(spark, sf_dir))


def p4_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each split item put together again from its pieces, their overlaps taken off: characters and hash, and whether all pieces keep the limit."""
    pieces = splitting.split_items(_oversized(spark, sf_dir))
    before = F.lag("end_char").over(Window.partitionBy("src", "item_id").orderBy("piece_no"))
    cut = pieces.withColumn("before", F.coalesce(before, F.lit(0))).select("src", "item_id", "piece_no", "end_char", F.expr("substring(text, cast(before - start_char as int) + 1)").alias("part"), F.length("text").alias("size"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece_no", "part"))), lambda x: x["part"]), "")
    whole = cut.groupBy("src", "item_id").agg(F.max("end_char").alias("characters"), joined.alias("text"), (F.max("size") <= splitting.LIMIT).alias("kept"))
    return whole.select("src", F.col("item_id").cast("long").alias("item_id"), "characters", F.md5("text").alias("text_md5"), "kept")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = docpairs.documented_functions(table(spark, sf_dir, "nodes"), table(spark, sf_dir, "file_contents"))
    return found.select("node_id", F.col("doc_line").cast("long").alias("doc_line")).distinct()


def p5_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code and description of every documented function."""
    return docpairs.code_pairs(table(spark, sf_dir, "nodes"), table(spark, sf_dir, "file_contents"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return invalid.invalid_files(table(spark, sf_dir, "file_contents")).select("project_id", "file_path").distinct()


def p6_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of invalid files by project and language."""
    return invalid.invalid_rates(table(spark, sf_dir, "file_contents"), table(spark, sf_dir, "index_runs"))


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    described = cut_lineage(packing.described_documents(documents))
    return packing.pack_documents(documents, table(spark, sf_dir, "pack_bins"), described=described)


def p7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir)


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers of each class are."""
    return packing.container_fill(_packed(spark, sf_dir), table(spark, sf_dir, "pack_bins"))


def p7_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By class and document: whether its pieces are its tokens without a gap, in as few pieces as its length allows, and no container is too full."""
    documents = table(spark, sf_dir, "documents")
    described = cut_lineage(packing.described_documents(documents))
    bins = table(spark, sf_dir, "pack_bins")
    packed = cut_lineage(packing.pack_documents(documents, bins, described=described))
    sizes = F.broadcast(bins.groupBy("bin_class").agg(F.max("capacity_tokens").alias("capacity")))  # given by hand
    fill = packed.groupBy("bin_class", "container").agg(F.sum(F.col("end_token") - F.col("start_token")).alias("used")).join(sizes, "bin_class")
    over = fill.groupBy("bin_class").agg(F.max((F.col("used") > F.col("capacity")).cast("int")).alias("over"))
    each = packed.groupBy("bin_class", "doc_id").agg(F.sum(F.col("end_token") - F.col("start_token")).alias("tokens"), F.min("start_token").alias("first"), F.max("end_token").alias("last"), F.count("*").alias("pieces"))
    both = each.join(described.select("doc_id", F.col("tokens").alias("size")), "doc_id").join(sizes, "bin_class").join(F.broadcast(over), "bin_class")
    fewest = F.greatest(F.lit(1), F.ceil(F.col("size") / F.col("capacity")))
    return both.groupBy("bin_class").agg(F.count("*").alias("documents"), F.min((F.col("tokens") == F.col("size")) & (F.col("first") == 0) & (F.col("last") == F.col("size"))).alias("whole"), F.min(F.col("pieces") == fewest).alias("fewest"), (F.max("over") == 0).alias("within"))


def p8_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By target: whether no text was drawn more often than allowed or twice in a repeat, and the mix goes on without a gap up to the budget."""
    sized = cut_lineage(mixing.sized_documents(table(spark, sf_dir, "documents")))
    targets = table(spark, sf_dir, "mix_targets")
    mix = cut_lineage(mixing.mix_sources(sized, targets))
    limits = mixing.clean_targets(targets).select("source", "max_repeats")
    drawn = mix.groupBy("source", "doc_id").agg(F.max("repeat").alias("most"), F.count("*").alias("times"), F.count_distinct("repeat").alias("different"))
    kept = drawn.join(F.broadcast(limits), "source").groupBy("source").agg(F.min((F.col("most") <= F.col("max_repeats")) & (F.col("times") == F.col("different"))).alias("kept"))
    gaps = mix.agg((F.max(F.col("start") + F.col("tokens")) - F.sum("tokens")).alias("gap"), F.max("tokens").alias("longest")).select((F.col("gap") <= F.col("longest")).alias("gapless"))
    return limits.join(kept, "source", "left").crossJoin(F.broadcast(gaps)).select("source", F.coalesce("kept", F.lit(True)).alias("kept"), "gapless")  # gaps is one row


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = mixing.sized_documents(table(spark, sf_dir, "documents"))
    return mixing.mix_sources(cut_lineage(sized), table(spark, sf_dir, "mix_targets"))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached share of each source."""
    sized = cut_lineage(mixing.sized_documents(table(spark, sf_dir, "documents")))
    targets = table(spark, sf_dir, "mix_targets")
    return mixing.reached_shares(mixing.mix_sources(sized, targets), sized, targets)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.find_residue(table(spark, sf_dir, "documents")).select("doc_id").distinct()


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_search": p1_search,
    "p1_recall": p1_recall,
    "p2_found": p2_found,
    "p2_kinds": p2_kinds,
    "p3_found": p3_found,
    "p3_redacted": p3_redacted,
    "p4_found": p4_found,
    "p4_pieces": p4_pieces,
    "p4_whole": p4_whole,
    "p5_found": p5_found,
    "p5_pairs": p5_pairs,
    "p6_found": p6_found,
    "p6_rates": p6_rates,
    "p7_pack": p7_pack,
    "p7_fill": p7_fill,
    "p7_whole": p7_whole,
    "p8_mix": p8_mix,
    "p8_shares": p8_shares,
    "p8_whole": p8_whole,
    "p9_found": p9_found,
}

_P4 = """
WITH current AS (
  SELECT project_id, file_path, arg_max(content, (indexed_at, run_id, content)) AS content
  FROM file_contents GROUP BY 1, 2),
lined AS (
  SELECT project_id, file_path, string_split(CASE WHEN right(content, 1) = chr(10) THEN content[:-2] ELSE content END, chr(10)) AS lines
  FROM current),
wanted AS (
  SELECT DISTINCT section_id, s.start_line, least(coalesce(s.end_line, len(lines)), len(lines)) AS last, lines
  FROM sections s JOIN lined USING (project_id, file_path)),
texts AS (
  SELECT section_id, array_to_string([regexp_replace(x, chr(13) || '$', '') for x in lines[start_line:last]], chr(10)) AS text FROM wanted)
SELECT DISTINCT 'section' AS src, section_id AS item_id FROM texts WHERE length(text) > 1500
UNION ALL
SELECT DISTINCT 'chunk', id FROM node_embeddings WHERE length(chunk_text) > 1500
"""

_P4_TEXTS = _P4[: _P4.rindex("SELECT DISTINCT 'section'")] + ", every AS (SELECT DISTINCT 'section' AS src, section_id AS item_id, text FROM texts UNION ALL SELECT DISTINCT 'chunk', id, chunk_text FROM node_embeddings) SELECT src, item_id, length(text) AS characters, md5(text) AS text_md5, true AS kept FROM every WHERE length(text) > 1500"

ORACLES: dict[str, str] = {
    "p4_found": _P4,
    "p4_whole": _P4_TEXTS,
    "p7_whole": "SELECT bin_class, (SELECT count(DISTINCT doc_id) FROM documents) AS documents, true AS whole, true AS fewest, true AS within FROM pack_bins",
    "p8_whole": "SELECT DISTINCT source, true AS kept, true AS gapless FROM mix_targets WHERE source IS NOT NULL AND target_share > 0",
}
