"""Staging lists: which files were picked, in which order, and whether they can be used."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from corpuspipe.functions import names, text
from corpuspipe.operators.scale import number_in_order, sized
from corpuspipe.operators.validation import violations

UNSUPPORTED_MESSAGE = "Unsupported source type."


def stage_sources(paths: DataFrame) -> DataFrame:
    """One row per picked path (``world_id, staging_entry_id, source_order, source_path``).

    Unsupported files stay in the list as invalid rows.
    """
    kind = names.source_type(F.col("source_path"))
    valid = kind.isin(*names.SUPPORTED_TYPES)
    return paths.withColumns(
        {
            "source_file_type": kind,
            "is_valid": valid,
            "error_message": F.when(~valid, F.lit(UNSUPPORTED_MESSAGE)),
        }
    )


def unavailable_sources(staged: DataFrame, listing: DataFrame) -> DataFrame:
    """Staged rows whose path the file listing (``path``) does not have; all of them, not the first."""
    found = listing.select(F.col("path").alias("source_path")).distinct()
    return staged.join(found, "source_path", "left_anti").withColumn("reason", F.lit("unavailable"))


Parser = Callable[[DataFrame], DataFrame]
_PARSERS: dict[str, Parser] = {}


def register_parser(source_type: str, parser: Parser) -> None:
    """Make ``parser`` (staged rows in, the same rows plus ``parsed_text`` out) read one source type."""
    _PARSERS[source_type.strip().lower()] = parser


def registered_parsers() -> dict[str, Parser]:
    return dict(_PARSERS)


def route_sources(staged: DataFrame) -> DataFrame:
    """Adds ``parser`` (the normalised type) and whether the world's whole batch can be routed.

    The verdict is counted per world first, so a hot world is joined by its single row.
    """
    kind = text.normalize_type(F.col("source_file_type"))
    routed = staged.withColumn("parser", F.when(kind.isin(*names.SUPPORTED_TYPES), kind))
    verdict = routed.groupBy("world_id").agg(
        F.bool_and(F.col("parser").isNotNull()).alias("batch_routable")
    )
    return routed.join(sized(verdict), "world_id")


def parse_routed(routed: DataFrame) -> DataFrame:
    """Run the registered parser of every type over the rows of routable batches."""
    ready = routed.where("batch_routable").drop("batch_routable")
    parts = [
        parser(ready.where(F.col("parser") == kind)).drop("parser") for kind, parser in _PARSERS.items()
    ]
    if not parts:
        raise ValueError("No parser is registered.")
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def prepare_parsed(parsed: DataFrame, attempt_id: Column) -> tuple[DataFrame, DataFrame]:
    """Usable parsed sources and a violation per unusable one; staged order is kept as a column."""
    usable = text.is_usable(F.col("parsed_text"))
    good = parsed.where(usable).select(
        "world_id",
        attempt_id.alias("attempt_id"),
        "staging_entry_id",
        "source_order",
        "source_file_type",
        "parsed_text",
    )
    bad = violations(
        parsed,
        "source",
        F.col("staging_entry_id"),
        [("text_unusable", "parsed text must hold a visible character", ~usable)],
        F.col("world_id"),
    )
    return good, bad


def stage_append(entries: DataFrame, added: DataFrame) -> DataFrame:
    """Put new entries after the existing ones of their world; orders stay 0-based."""
    last = entries.groupBy("world_id").agg((F.max("source_order").cast("long") + 1).alias("_base"))
    placed = (
        number_in_order(added, ["world_id"], "source_order", "_place", tie="staging_entry_id")
        .join(sized(last), "world_id", "left")
        .withColumn("source_order", F.coalesce("_base", F.lit(0)) + F.col("_place") - 1)
        .drop("_place", "_base")
    )
    return entries.unionByName(placed)


def stage_remove(entries: DataFrame, requests: DataFrame) -> DataFrame:
    """Drop the requested staged entries; committed items and unknown ids are left alone."""
    wanted = (
        requests.where(F.col("source_kind") == "staged")
        .select("world_id", F.col("source_id").alias("staging_entry_id"))
        .distinct()
    )
    return entries.join(wanted, ["world_id", "staging_entry_id"], "left_anti")


def stage_replace(entries: DataFrame, worlds: DataFrame, added: DataFrame | None = None) -> DataFrame:
    """Discard all entries of the given worlds and, if given, put new ones in their place."""
    kept = entries.join(worlds.select("world_id").distinct(), "world_id", "left_anti")
    return kept if added is None else kept.unionByName(added)


def reorder_violations(sources: DataFrame, entries: DataFrame, items: DataFrame) -> DataFrame:
    """Check an order request (``world_id, position`` from 0, ``source_kind, source_id``).

    Committed sources must be an unchanged prefix, and every committed and staged source must occur
    exactly once. Without committed sources this is the plain permutation check.
    """
    world = F.col("world_id")
    known_kind = F.col("source_kind").isin("committed", "staged")
    ranked = number_in_order(
        sources.select("world_id", "source_id", "book_number"), ["world_id"], "book_number", "_place"
    ).select("world_id", "source_id", (F.col("_place") - 1).alias("position"))
    requested = items.select(
        "world_id", "position", F.col("source_kind").alias("_kind"), F.col("source_id").alias("_id")
    )
    moved = violations(
        ranked.join(requested, ["world_id", "position"], "left"),
        "order",
        F.col("source_id"),
        [
            (
                "committed_prefix_changed",
                "committed sources must stay first and in order",
                (F.col("_kind") != "committed") | (F.col("_id") != F.col("source_id")),
            )
        ],
        world,
    )
    present = ranked.select("world_id", "source_id", F.lit("committed").alias("source_kind")).unionByName(
        entries.select(
            "world_id",
            F.col("staging_entry_id").alias("source_id"),
            F.lit("staged").alias("source_kind"),
        )
    ).withColumn("_known", F.lit(True))
    asked = items.groupBy("world_id", "source_kind", "source_id").agg(F.count(F.lit(1)).alias("_asked"))
    compared = asked.join(present, ["world_id", "source_kind", "source_id"], "full")
    return moved.unionByName(
        violations(
            compared,
            "order",
            F.col("source_id"),
            [
                ("kind_invalid", "kind must be committed or staged", ~known_kind),
                (
                    "source_unknown",
                    "the request names an unknown source",
                    known_kind & F.col("_known").isNull(),
                ),
                ("source_missing", "the request misses a source", F.col("_asked").isNull()),
                (
                    "source_repeated",
                    "the request names a source twice",
                    F.coalesce(F.col("_asked") > 1, F.lit(False)),
                ),
            ],
            world,
        )
    )


def reordered(entries: DataFrame, items: DataFrame) -> DataFrame:
    """Staged entries with the 0-based order an accepted request gives them."""
    wanted = items.where(F.col("source_kind") == "staged").select(
        "world_id", F.col("source_id").alias("staging_entry_id"), "position"
    )
    placed = number_in_order(wanted, ["world_id"], "position", "_place", tie="staging_entry_id")
    return (
        entries.drop("source_order")
        .join(placed.drop("position"), ["world_id", "staging_entry_id"])
        .withColumn("source_order", F.col("_place") - 1)
        .drop("_place")
    )
