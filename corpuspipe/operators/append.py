"""Appending rows to a published table: all gates first, then whole worlds are accepted or refused.

Every rule about keys is read off one ledger: the ids, positions, numbers and paths of the new rows, those the tables
hold, and the links between chunks and sources are rows of one narrow union, added up key by key. What repeats in the
batch, is taken, or has no partner shows in the sums, so there is one shuffle of keys instead of a join for each rule.
A key that a third of all rows repeats is a sum that shrinks before that shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from corpuspipe import schemas
from corpuspipe.operators import validation
from corpuspipe.operators.scale import pinned, sized

# How a row counts in the ledger: as new, as held by a table, or as a link to the key.
_SIDES = ("new_rows", "held_rows", "links")

# Kinds of keys, and whose they are.
_ENTITIES = {
    "source_id": "source",
    "book_number": "source",
    "stored_path": "destination",
    "chunk_id": "chunk",
    "chunk_place": "chunk",
    "owner": "batch",
}


@dataclass
class Appended:
    """``rows``: what the table holds afterwards. ``accepted``: the new ones among them. ``violations``: why the others are not."""

    rows: DataFrame
    accepted: DataFrame
    violations: DataFrame


def _place() -> Column:
    return F.concat_ws("/", F.col("book_number").cast("string"), F.col("chunk_number").cast("string"))


def _entries(rows: DataFrame, side: str, keys: dict[str, Column]) -> DataFrame:
    """A ledger row for each key of each row; keys that are null are the business of the row rules."""
    listed = F.array(*(F.struct(F.lit(kind).alias("kind"), key.cast("string").alias("key")) for kind, key in keys.items()))
    counts = [F.lit(int(name == side)).cast("long").alias(name) for name in _SIDES]
    return rows.select("world_id", F.inline(listed)).where(F.col("key").isNotNull()).select("world_id", "kind", "key", *counts)


def source_entries(sources: DataFrame, side: str) -> DataFrame:
    return _entries(sources, side, {name: F.col(name) for name in ("source_id", "book_number", "stored_path")})


def chunk_entries(chunks: DataFrame, side: str) -> DataFrame:
    return _entries(chunks, side, {"chunk_id": F.col("chunk_id"), "chunk_place": _place()})


def owner_entries(sources: DataFrame, chunks: DataFrame) -> DataFrame:
    """The sources of a batch, and a link to its source for each chunk."""
    owner = {"owner": F.col("source_id")}
    return _entries(sources, "new_rows", owner).unionByName(_entries(chunks, "links", owner))


def ledger(*entries: DataFrame) -> DataFrame:
    """``world_id, kind, key`` with the sums of all sides."""
    union = entries[0]
    for more in entries[1:]:
        union = union.unionByName(more)
    return union.groupBy("world_id", "kind", "key").agg(*(F.sum(side).alias(side) for side in _SIDES))


def key_violations(book: DataFrame) -> DataFrame:
    """The broken rules of a ledger; paths are told by their hash only."""
    new, held, links = (F.col(side) for side in _SIDES)
    kind = F.col("kind")
    linked = kind == "owner"
    entity = F.create_map(*(F.lit(part) for pair in _ENTITIES.items() for part in pair))[kind]
    key = F.when(kind == "stored_path", F.sha2("key", 256)).otherwise(F.col("key"))

    def broken(bad: Column, rule: Column, message: str) -> Column:
        return F.when(bad, F.struct(rule.alias("rule"), F.lit(message).alias("message")))

    found = F.array_compact(
        F.array(
            broken(~linked & (new > 1), F.concat(kind, F.lit("_repeated")), "the key must be unique in the batch"),
            broken(~linked & (new > 0) & (held > 0), F.concat(kind, F.lit("_taken")), "the table holds the key already"),
            broken(linked & (new > 0) & (links == 0), F.lit("source_without_chunks"), "every source needs a chunk"),
            broken(linked & (new == 0) & (links > 0), F.lit("orphan_chunks"), "chunks refer to an unknown source"),
        )
    )
    return book.select("world_id", entity.alias("entity"), key.alias("entity_key"), F.inline(found))


def _accepted(new: DataFrame, found: DataFrame) -> DataFrame:
    blocked = sized(found.where(F.col("world_id").isNotNull()).select("world_id").distinct())
    return new.where(F.col("world_id").isNotNull()).join(blocked, "world_id", "left_anti")


def _world_missing(rows: DataFrame, entity: str, key: str) -> DataFrame:
    missing = [("world_id_missing", "world_id must be set", F.lit(True))]
    return validation.violations(rows.where(F.col("world_id").isNull()), entity, F.col(key), missing, F.col("world_id"))


def source_rules(new: DataFrame) -> DataFrame:
    return validation.source_violations(new).unionByName(_world_missing(new, "source", "source_id"))


def chunk_rules(new: DataFrame) -> DataFrame:
    return validation.chunk_violations(new).unionByName(_world_missing(new, "chunk", "chunk_id"))


def append_sources(new: DataFrame, table: DataFrame) -> Appended:
    """``table`` and the rows of ``new`` whose world breaks no rule.

    Both are rows of ``sources``. An empty batch changes nothing. Rows without a world are refused one by one.
    """
    columns = [field.name for field in schemas.SOURCES]
    new, table = new.select(*columns), table.select(*columns)
    keys = key_violations(ledger(source_entries(new, "new_rows"), source_entries(_of_worlds(table, new), "held_rows")))
    found = pinned(source_rules(new).unionByName(keys))
    accepted = _accepted(new, found)
    return Appended(table.unionByName(accepted), accepted, found)


def append_chunks(new: DataFrame, table: DataFrame) -> Appended:
    """``table`` and the rows of ``new`` whose world breaks no rule. Both are rows of ``chunks``; texts are not shuffled."""
    columns = [field.name for field in schemas.CHUNKS]
    new, table = new.select(*columns), table.select(*columns)
    keys = key_violations(ledger(chunk_entries(new, "new_rows"), chunk_entries(_of_worlds(table, new), "held_rows")))
    found = pinned(chunk_rules(new).unionByName(keys))
    accepted = _accepted(new, found)
    return Appended(table.unionByName(accepted), accepted, found)


def append_batch(new_sources: DataFrame, new_chunks: DataFrame, sources: DataFrame, chunks: DataFrame) -> tuple[Appended, Appended]:
    """Sources and their chunks together: a world that breaks any rule of either, or of their links, adds neither.

    All keys of the batch and of both tables are one ledger.
    """
    of_source, of_chunk = ([field.name for field in schema] for schema in (schemas.SOURCES, schemas.CHUNKS))
    new_sources, new_chunks = new_sources.select(*of_source), new_chunks.select(*of_chunk)
    sources, chunks = sources.select(*of_source), chunks.select(*of_chunk)
    book = ledger(
        source_entries(new_sources, "new_rows"),
        source_entries(_of_worlds(sources, new_sources), "held_rows"),
        chunk_entries(new_chunks, "new_rows"),
        chunk_entries(_of_worlds(chunks, new_chunks), "held_rows"),
        owner_entries(new_sources, new_chunks),
    )
    found = pinned(source_rules(new_sources).unionByName(chunk_rules(new_chunks)).unionByName(key_violations(book)))
    blocked = _accepted(new_sources, found), _accepted(new_chunks, found)
    return (
        Appended(sources.unionByName(blocked[0]), blocked[0], found),
        Appended(chunks.unionByName(blocked[1]), blocked[1], found),
    )


def _of_worlds(table: DataFrame, new: DataFrame) -> DataFrame:
    """Published rows of the worlds that get new ones; the list has one short row for each."""
    return table.join(sized(new.select("world_id").distinct()), "world_id", "left_semi")


def gate_violations(sources: DataFrame, chunks: DataFrame) -> DataFrame:
    """Of a batch that is written: sources without chunks, and chunks whose source is not in the batch. Reads two columns of each."""
    return key_violations(ledger(owner_entries(sources, chunks)))
