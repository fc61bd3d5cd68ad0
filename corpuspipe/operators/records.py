"""From numbered staged sources and split chunks to the records that are published."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corpuspipe.functions import names
from corpuspipe.operators.chunking import Settings, split_texts
from corpuspipe.operators.validation import violations

STAGED_KEY = ["world_id", "staging_entry_id"]


def source_id(world_id: Column, source_hash: Column) -> Column:
    """A hash occurs once per world, so the pair names a source; a retried task makes the same id."""
    return F.sha2(F.concat_ws("|", world_id, source_hash), 256)


def chunk_id(source: Column, chunk_number: Column) -> Column:
    return F.sha2(F.concat_ws("|", source, chunk_number.cast("string")), 256)


def prepare_sources(staged: DataFrame) -> DataFrame:
    """Adds the id, original file name and stored path a staged source will have."""
    identity = source_id(F.col("world_id"), F.col("source_hash"))
    filename = names.base_name(F.col("source_path"))
    return staged.withColumns(
        {
            "source_id": identity,
            "original_filename": filename,
            "stored_path": names.stored_path(identity, filename),
        }
    )


def source_records(prepared: DataFrame, numbers: DataFrame, committed_at: Column) -> DataFrame:
    """Prepared sources joined with their book numbers, as rows of ``sources``."""
    return (
        prepared.join(numbers.select(*STAGED_KEY, "book_number"), STAGED_KEY)
        .select(
            "world_id",
            "source_id",
            "original_filename",
            "stored_path",
            "source_file_type",
            "source_hash",
            "book_number",
            committed_at.alias("committed_at"),
        )
    )


def chunk_records(texts: DataFrame, numbered: DataFrame, settings: Settings) -> DataFrame:
    """Texts (``parsed_text``) cut into rows of ``chunks``, with the id and number of their source.

    Texts meet their numbers before they are cut, so chunks and their overlaps are never moved.
    """
    owners = numbered.select(*STAGED_KEY, "source_id", "book_number")
    return split_texts(texts.select(*STAGED_KEY, "parsed_text").join(owners, STAGED_KEY), settings).select(
        "world_id",
        chunk_id(F.col("source_id"), F.col("chunk_number")).alias("chunk_id"),
        "source_id",
        "book_number",
        "chunk_number",
        "chunk_text",
        "overlap_text",
        "character_start_offset",
        "character_end_offset",
    )


def orphan_chunks(split_chunks: DataFrame, prepared: DataFrame) -> DataFrame:
    """Chunks of a source the batch does not have."""
    return split_chunks.select(*STAGED_KEY, "chunk_number").join(
        prepared.select(*STAGED_KEY), STAGED_KEY, "left_anti"
    )


def sources_without_chunks(prepared: DataFrame, split_chunks: DataFrame) -> DataFrame:
    owners = split_chunks.select(*STAGED_KEY).distinct()
    return prepared.select(*STAGED_KEY).join(owners, STAGED_KEY, "left_anti")


def commit_gate(prepared: DataFrame, split_chunks: DataFrame) -> DataFrame:
    """Per world: chunk and source counts, both kinds of missing partner, and the verdict.

    Chunks are counted per source first, so the full join sees one row per source and a hot world only
    adds counts.
    """
    counted = split_chunks.groupBy(*STAGED_KEY).agg(F.count(F.lit(1)).alias("_chunks"))
    known = prepared.select(*STAGED_KEY, F.lit(1).alias("_known"))
    joined = known.join(counted, STAGED_KEY, "full")
    gate = joined.groupBy("world_id").agg(
        F.count("_known").alias("source_count"),
        F.coalesce(F.sum("_chunks"), F.lit(0)).alias("chunk_count"),
        F.coalesce(F.sum(F.when(F.col("_known").isNull(), F.col("_chunks"))), F.lit(0)).alias("orphan_count"),
        F.count_if(F.col("_chunks").isNull()).alias("chunkless_count"),
    )
    return gate.withColumn(
        "may_commit",
        (F.col("source_count") > 0)
        & (F.col("chunk_count") > 0)
        & (F.col("orphan_count") == 0)
        & (F.col("chunkless_count") == 0),
    )


def gate_violations(gate: DataFrame) -> DataFrame:
    return violations(
        gate,
        "batch",
        F.col("world_id"),
        [
            ("no_source", "a batch needs at least one source", F.col("source_count") < 1),
            ("no_chunk", "a batch needs at least one chunk", F.col("chunk_count") < 1),
            ("orphan_chunks", "chunks refer to an unknown source", F.col("orphan_count") > 0),
            ("sources_without_chunks", "every source needs a chunk", F.col("chunkless_count") > 0),
        ],
        F.col("world_id"),
    )


def split_summary(sources: DataFrame, split_chunks: DataFrame) -> DataFrame:
    """Chunk count per staged source; a source without chunks shows zero."""
    counted = split_chunks.groupBy(*STAGED_KEY).agg(F.count(F.lit(1)).alias("chunk_count"))
    return (
        sources.select(*STAGED_KEY, "source_order")
        .join(counted, STAGED_KEY, "left")
        .withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0)).cast("long"))
    )


def batch_totals(summary: DataFrame) -> DataFrame:
    return summary.groupBy("world_id").agg(
        F.count(F.lit(1)).alias("source_count"), F.sum("chunk_count").cast("long").alias("chunk_count")
    )
