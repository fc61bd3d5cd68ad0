"""The whole job: picked files to published sources and chunks."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpuspipe.functions import names
from corpuspipe.plans.publish import publish_append, publish_new_worlds
from corpuspipe.sources import readers, staging


# Types with a reader in this module; registered parsers are asked for all others.
BUILT_IN = ("txt", "epub")


def parse_content(rows: DataFrame) -> DataFrame:
    """Adds ``parsed_text`` to rows with ``source_file_type`` and ``content``; null where a file is unreadable.

    Text and EPUB files are read in one pass: a reader gets null for files of another type. Other types
    have no reader here; those with a registered parser are read by it, each in a pass of its own.
    """
    kind = F.col("source_file_type")
    others = {name: parser for name, parser in staging.registered_parsers().items() if name not in BUILT_IN}
    own = _parse_built_in(rows.where(kind.isNull() | ~kind.isin(*others)) if others else rows)
    for name, parser in others.items():
        own = own.unionByName(parser(rows.where(kind == name)).select(*own.columns))
    return own


def _parse_built_in(rows: DataFrame) -> DataFrame:
    kind = F.col("source_file_type")
    plain = readers.decode_text(
        rows.withColumns(
            {"_content": F.col("content"), "content": F.when(kind == "txt", F.col("content"))}
        )
    ).withColumnRenamed("parsed_text", "_plain")
    book = readers.epub_text(F.when(kind == "epub", F.col("_content")))
    return (
        plain.withColumn("parsed_text", F.coalesce("_plain", book))
        .withColumn("content", F.col("_content"))
        .drop("_content", "_plain", "encoding", "is_decodable")
    )


def read_picked(spark: SparkSession, picks: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """Parsed sources of the picked files, and a violation per file that is not there.

    ``picks`` holds ``world_id, staging_entry_id, source_order, source_path`` with paths as the file
    listing writes them.
    """
    staged = staging.stage_sources(picks)
    files = readers.read_files(spark, folder)
    missing = staging.unavailable_sources(staged, files.select("path")).select(
        "world_id",
        F.lit("source").alias("entity"),
        F.col("staging_entry_id").alias("entity_key"),
        F.col("reason").alias("rule"),
        F.lit("the picked file cannot be read").alias("message"),
    )
    content = files.select(F.col("path").alias("source_path"), "content")
    parsed = parse_content(staged.join(content, "source_path")).select(
        "world_id",
        "staging_entry_id",
        "source_order",
        "source_path",
        "source_file_type",
        names.source_hash(F.col("content")).alias("source_hash"),
        "parsed_text",
    )
    return parsed, missing


def ingest_files(
    spark: SparkSession,
    root: str,
    batch_id: str,
    picks: DataFrame,
    folder: str,
    committed_at: datetime.datetime,
    settings: DataFrame | None = None,
    on_duplicate: str = "block",
) -> DataFrame:
    """Publish the picked files of a folder: new worlds with ``settings``, existing worlds without."""
    parsed, missing = read_picked(spark, picks, folder)
    if settings is None:
        return publish_append(spark, root, batch_id, parsed, committed_at, on_duplicate, missing)
    return publish_new_worlds(spark, root, batch_id, parsed, settings, committed_at, on_duplicate, missing)
