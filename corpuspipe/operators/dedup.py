"""Exact duplicates and key conflicts, all as equi-joins on narrow frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corpuspipe.operators.scale import join_counted


def duplicates_in_batch(staged: DataFrame) -> DataFrame:
    """Staged sources whose hash came earlier in the same world; they point to the first one."""
    rows = staged.select("world_id", "staging_entry_id", "source_order", "source_hash")
    first = (
        rows.groupBy("world_id", "source_hash")
        .agg(
            F.min(F.struct("source_order", "staging_entry_id")).alias("_first"),
            F.count(F.lit(1)).alias("_rows"),
        )
        .where(F.col("_rows") > 1)
        .select(
            "world_id",
            "source_hash",
            F.col("_first.staging_entry_id").alias("first_staging_entry_id"),
            F.col("_first.source_order").alias("_first_order"),
            "_rows",
        )
    )
    return (
        join_counted(rows, first, ["world_id", "source_hash"], "_rows")
        .where(
            (F.col("source_order") > F.col("_first_order"))
            | (F.col("staging_entry_id") != F.col("first_staging_entry_id"))
        )
        .drop("_first_order", "_rows")
    )


def duplicates_of_committed(staged: DataFrame, sources: DataFrame) -> DataFrame:
    """Staged sources whose hash the same world already holds, with the first published source."""
    rows = staged.select("world_id", "staging_entry_id", "source_order", "source_hash")
    counts = rows.groupBy("world_id", "source_hash").agg(F.count(F.lit(1)).alias("_rows"))
    known = sources.groupBy("world_id", "source_hash").agg(
        F.min(F.struct("book_number", "source_id")).alias("_first")
    )
    matches = counts.join(known, ["world_id", "source_hash"]).select(
        "world_id",
        "source_hash",
        F.col("_first.book_number").alias("committed_book_number"),
        F.col("_first.source_id").alias("committed_source_id"),
        "_rows",
    )
    return join_counted(rows, matches, ["world_id", "source_hash"], "_rows").drop("_rows")


def without_duplicates(staged: DataFrame, sources: DataFrame) -> DataFrame:
    """The staged sources a skipping publish keeps: first in the batch and not yet published.

    The first copy is taken as a whole row by the aggregate, so a group of copies of any size is reduced
    before the shuffle and nothing is joined back.
    """
    order = ["source_order", "staging_entry_id"]
    rest = [name for name in staged.columns if name not in (*order, "world_id", "source_hash")]
    first = staged.groupBy("world_id", "source_hash").agg(F.min(F.struct(*order, *rest)).alias("_first"))
    known = sources.select("world_id", "source_hash").distinct()
    return (
        first.join(known, ["world_id", "source_hash"], "left_anti")
        .select("world_id", "source_hash", "_first.*")
        .select(*staged.columns)
    )


def _conflicts(
    rows: DataFrame, table: DataFrame, identity: list[str], position: list[str]
) -> DataFrame:
    """Rows whose identity or position the table holds; identity is reported first.

    Two equi-joins with key lists instead of one OR condition, which would be a nested loop.
    """
    ids = table.groupBy(*identity).agg(F.lit(True).alias("_same_id"))
    places = table.groupBy(*position).agg(F.lit(True).alias("_same_place"))
    return (
        rows.join(ids, identity, "left")
        .join(places, position, "left")
        .where(F.col("_same_id") | F.col("_same_place"))
        .withColumn("conflict", F.when(F.col("_same_id"), "id").otherwise("position"))
        .drop("_same_id", "_same_place")
    )


def chunk_conflicts(new_chunks: DataFrame, chunks: DataFrame) -> DataFrame:
    return _conflicts(
        new_chunks.select("world_id", "chunk_id", "book_number", "chunk_number"),
        chunks,
        ["world_id", "chunk_id"],
        ["world_id", "book_number", "chunk_number"],
    )


def source_conflicts(new_sources: DataFrame, sources: DataFrame) -> DataFrame:
    return _conflicts(
        new_sources.select("world_id", "source_id", "book_number"),
        sources,
        ["world_id", "source_id"],
        ["world_id", "book_number"],
    )


def asset_duplicates(uploads: DataFrame, assets: DataFrame) -> DataFrame:
    """Uploads whose file hash an asset already has, with the first such asset id."""
    counts = uploads.groupBy("file_hash").agg(F.count(F.lit(1)).alias("_rows"))
    known = (
        assets.where(F.col("file_hash").isNotNull())
        .groupBy("file_hash")
        .agg(F.min("asset_id").alias("duplicate_asset_id"))
    )
    return join_counted(
        uploads.select("upload_id", "file_hash"), counts.join(known, "file_hash"), ["file_hash"], "_rows"
    ).drop("_rows")
