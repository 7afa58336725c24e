"""Queries of the numbered problems: name -> (spark, folder) -> DataFrame, and their SQL where there is any."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.llm import credentials, handwritten, mixing, neighbours, packing, splitting, stuffing, tables, validity
from codelode.session import shared_dir, spread, table, written


def _long_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks over the limit of their model and kind, once each, with limit and overlap. A text within
    the limit isn't carried through the shuffle that removes the repeated rows."""
    limits = table(spark, folder, "chunk_limits").select("model", F.col("kind").alias("k"), "max_chars", "overlap_chars")
    chunks = table(spark, folder, "chunks").select("chunk_no", "model", tables.chunk_kind().alias("k"), "text", "indexed_at")
    sized = chunks.join(limits, ["model", "k"]).withColumn("over", F.char_length("text") > F.col("max_chars"))
    slim = sized.withColumn("text", F.when(F.col("over"), F.col("text")))
    return tables.latest(slim, "chunk_no", "indexed_at", ["over", "text", "max_chars", "overlap_chars"]).where("over")


def p1_kinds(spark: SparkSession, folder: str) -> DataFrame:
    files = spread(table(spark, folder, "source_files").select("file_id", "repo_id", "path", "content"))
    return handwritten.file_kinds(files, table(spark, folder, "repos"), "file_id", "repo_id", "path", "content")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return p1_kinds(spark, folder).where("kind IS NOT NULL").select("file_id")


def _chunk_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Text and path of each chunk, once; kept as a table because several passes read it."""
    chunks = table(spark, folder, "chunks").select("chunk_no", "path", "text", "indexed_at")
    return written(tables.latest(chunks, "chunk_no", "indexed_at", ["path", "text"]), "chunk-texts")


def p2_scores(spark: SparkSession, folder: str) -> DataFrame:
    return credentials.score_candidates(_chunk_texts(spark, folder), "chunk_no", "text", "path")


def p2_redacted(spark: SparkSession, folder: str) -> DataFrame:
    texts = _chunk_texts(spark, folder)
    return credentials.redact(texts, "chunk_no", "text", credentials.score_candidates(texts, "chunk_no", "text", "path"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return p2_scores(spark, folder).where("score >= 0.5").select("chunk_no", "line_no").distinct()


def p3_flags(spark: SparkSession, folder: str) -> DataFrame:
    """Parsed files, once each, with a computed flag in place of the recorded one (null: not checked)."""
    files = spread(table(spark, folder, "source_files").select("file_id", "path", "content"))
    flags = validity.syntax_flags(files, "file_id", "path", "content").drop("language")
    parsed = table(spark, folder, "parsed_files").select("file_id", "repo_id", F.regexp_replace("path", r"^(\./)+", "").alias("path"), "language", "loaded_at")
    once = tables.latest(parsed, "file_id", "loaded_at", ["repo_id", "path", "language"])
    return once.withColumn("language", F.coalesce(tables.path_language("path"), F.lower("language"))).join(flags, "file_id", "left")


def p3_rates(spark: SparkSession, folder: str) -> DataFrame:
    return validity.error_rates(p3_flags(spark, folder).where("has_errors IS NOT NULL"), "repo_id", "language")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    files = spread(table(spark, folder, "source_files").select("file_id", "path", "content"))
    return validity.syntax_flags(files, "file_id", "path", "content").where("has_errors").select("file_id")


def p4_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    chunks = table(spark, folder, "chunks").select("chunk_no", "model", "embedding", "indexed_at")
    return neighbours.most_similar(chunks, "chunk_no", "model", "embedding", order="indexed_at")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = neighbours.linked_pairs(p4_neighbours(spark, folder), "chunk_no")
    return pairs.select(F.col("a").alias("chunk_a"), F.col("b").alias("chunk_b"))


RANGE = 8192  # bytes; the longest chunks have several such ranges


def p5_pieces(spark: SparkSession, folder: str) -> DataFrame:
    pieces = splitting.split_texts(_long_chunks(spark, folder), "chunk_no", "text", "max_chars", "overlap_chars", range_bytes=RANGE)
    return pieces.select(F.col("key").alias("chunk_no"), "piece_no", "start_char", "end_char", "forced", "piece")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """A text with a forced cut has a run without white space longer than its limit."""
    pieces = splitting.split_texts(_long_chunks(spark, folder), "chunk_no", "text", "max_chars", "overlap_chars", range_bytes=RANGE, with_text=False)
    by = pieces.groupBy("key").agg(F.max("forced").alias("forced"))
    return by.select(F.col("key").alias("chunk_no"), F.when(F.col("forced"), "forced").otherwise("natural").alias("cut"))


def p5_file_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """All documents' texts as a few large files in the shared folder, cut by byte ranges."""
    docs = table(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", "text")
    where = f"{shared_dir(spark)}/codelode-texts-{uuid.uuid4().hex}"
    docs.repartition(8, "doc_id").sortWithinPartitions("doc_id").select("text").write.text(where)
    files = spark.read.format("binaryFile").load(where).select("path", "length")
    no = F.regexp_extract("path", r"part-(\d+)", 1).cast("long")
    files = files.select(no.alias("file_no"), "path", "length", F.lit(2000).alias("max_chars"), F.lit(200).alias("overlap"))
    pieces = splitting.split_files(files, "file_no", "path", "length", "max_chars", "overlap", range_bytes=1 << 20, with_text=False)
    return pieces.select(F.col("key").alias("file_no"), "piece_no", "start_char", "end_char", "forced")


def p6_containers(spark: SparkSession, folder: str) -> DataFrame:
    """Sizes are tokens of a byte-level tokenizer: one per UTF-8 byte."""
    docs = table(spark, folder, "documents").select("doc_id", F.octet_length("text").cast("long").alias("tokens"))
    return packing.pack(docs, "doc_id", "tokens")


def p6_fill(spark: SparkSession, folder: str) -> DataFrame:
    return packing.fill_report(p6_containers(spark, folder))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents whose pieces lie in several containers."""
    by = p6_containers(spark, folder).groupBy("doc_id").agg(F.min("container").alias("first"), F.max("container").alias("last"))
    return by.where("first < last").select("doc_id")


def _mix(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    docs = spread(table(spark, folder, "documents").select("doc_id", "text", "source"))
    return mixing.mix(docs, "doc_id", tables.trimmed_source(), "text", table(spark, folder, "mix_targets"))


def p7_selection(spark: SparkSession, folder: str) -> DataFrame:
    return _mix(spark, folder)[0]


def p7_report(spark: SparkSession, folder: str) -> DataFrame:
    return _mix(spark, folder)[1]


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return _mix(spark, folder)[1].where("NOT can_reach").select("source")


def p8_scores(spark: SparkSession, folder: str) -> DataFrame:
    return stuffing.score_pages(spread(table(spark, folder, "documents").select("doc_id", "text")), "doc_id", "text")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return p8_scores(spark, folder).where("flagged").select("doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: f for n, f in globals().items() if n[0] == "p" and n[1:2].isdigit() and callable(f)}


def oracle_sql() -> dict[str, str]:
    from codelode.llm.sql import SQL

    return SQL
