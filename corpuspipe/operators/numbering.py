"""Append-only book numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corpuspipe.operators.scale import number_in_order, sized


def next_book_numbers(sources: DataFrame) -> DataFrame:
    """Per world the number after the highest one; gaps are never filled."""
    return sources.groupBy("world_id").agg((F.max("book_number").cast("long") + 1).alias("next_book_number"))


def assign_book_numbers(staged: DataFrame, sources: DataFrame) -> DataFrame:
    """Number the staged sources in staged order after the published ones; a new world starts at 1."""
    numbered = number_in_order(
        staged, ["world_id"], "source_order", "_place", tie="staging_entry_id"
    )
    return (
        numbered.join(sized(next_book_numbers(sources)), "world_id", "left")
        .withColumn(
            "book_number",
            F.coalesce("next_book_number", F.lit(1)) + F.col("_place") - 1,
        )
        .drop("_place", "next_book_number")
    )


def number_conflicts(assigned: DataFrame, sources: DataFrame) -> DataFrame:
    """Published numbers inside the range a batch is about to use, per world."""
    ranges = assigned.groupBy("world_id").agg(
        F.min("book_number").alias("first_number"), F.max("book_number").alias("last_number")
    )
    return sources.select("world_id", "source_id", "book_number").join(ranges, "world_id").where(
        F.col("book_number").between(F.col("first_number"), F.col("last_number"))
    )
