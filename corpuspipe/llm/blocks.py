"""Blocks of documents that ask the owners of hash ranges what other blocks know.

A block holds about 4 MB of text. It asks about each distinct hash once, in order, so a hash that every document has
is one entry for each block, and entries take two to four bytes. An owner sorts the entries of its range and tells each
block which of its hashes other blocks have as well.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from corpuspipe.llm import grams
from corpuspipe.llm.common import shuffle_partitions, store
from corpuspipe.llm.packing import pack, pack_rows, pack_sorted, unpack, unpack_sorted
from corpuspipe.sources.pieces import released, released_group

# Bytes of text for each owner of hashes: what one task sorts at a time.
OWNED_BYTES = 8 << 20

SEVERAL = np.uint64(0)

ASKED = "owner int, block string, hashes binary, flags binary"
HITS = "block string, hits binary"
COUNTED_HITS = "block string, hits binary, counts binary"

_KINDS = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64()}


def owners_of(spark: SparkSession, text_bytes: int) -> int:
    return max(shuffle_partitions(spark), -(-int(text_bytes) // OWNED_BYTES))


def messages(rows: list[tuple], schema: str) -> pa.RecordBatch:
    """Rows of a flat schema as a batch."""
    fields = [field.split() for field in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays(
        [pa.array(column, _KINDS[kind]) for column, (_, kind) in zip(columns, fields)], names=[name for name, _ in fields]
    )


def shares(values: np.ndarray, bits: int, owners: int) -> list[tuple[int, int, int]]:
    """(owner, begin, end) of the stretches of ordered hashes of ``bits`` bits that each owner gets."""
    # Owners' ranges are equal shares of the leading 32 bits. Only the borders that hashes lie between are looked at.
    if not len(values):
        return []
    lead = values >> np.uint64(max(bits - 32, 0))
    owner = (lead * np.uint64(owners)) >> np.uint64(min(bits, 32))
    cuts = np.append(np.flatnonzero(np.append(True, owner[1:] != owner[:-1])), len(values))
    return [(int(owner[a]), int(a), int(b)) for a, b in zip(cuts[:-1], cuts[1:])]


def pack_blocks(docs: DataFrame, label: str) -> DataFrame:
    """Stored blocks of ``doc_id, text`` rows: ``block`` (name) and ``rows`` (packed)."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group in grams.groups(batch, 1):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([uuid.uuid4().hex]), pa.array([pack_rows(group)], pa.binary())], names=["block", "rows"]
                )

    return store(docs.mapInArrow(run, "block string, rows binary"), label)


def _bits(data: bytes, count: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, dtype=np.uint8), count=count).astype(np.uint64)


def _answered(read_marks, wanted, schema: str):
    """The function an owner runs: which hashes of two blocks or more are ``wanted``, told to each of them.

    Where the schema has ``counts``, they say how many blocks asked about each hash.
    """

    @released_group
    def answer(table: pa.Table) -> pa.Table:
        blocks_of = table.column("block").to_pylist()
        lists = [unpack_sorted(value.as_py()) for value in table.column("hashes")]
        marks = np.concatenate([read_marks(value.as_py(), len(own)) for value, own in zip(table.column("flags"), lists)])
        values = np.concatenate(lists)
        owner_of = np.repeat(np.arange(len(lists), dtype=np.int32), [len(own) for own in lists])
        order = np.argsort(values, kind="stable")
        values, owner_of, marks = values[order], owner_of[order], marks[order]
        first = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
        sizes = np.diff(np.append(first, len(values)))
        hit = np.repeat((sizes > 1) & wanted(values, marks, first), sizes)
        values, owner_of, counts = values[hit], owner_of[hit], np.repeat(sizes, sizes)[hit]
        by_block = np.argsort(owner_of, kind="stable")
        cuts = np.searchsorted(owner_of[by_block], np.arange(len(lists) + 1))
        shares_of = [(blocks_of[k], by_block[a:b]) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if b > a]
        if schema == COUNTED_HITS:
            rows = [(name, pack_sorted(values[at]), pack(counts[at])) for name, at in shares_of]
        else:
            rows = [(name, pack_sorted(values[at])) for name, at in shares_of]
        return pa.Table.from_batches([messages(rows, schema)])

    return answer


def known_elsewhere(asked: DataFrame) -> DataFrame:
    """``block, hits``: the hashes of each block that another block asked about too, flagged in one of them.

    ``flags`` holds a bit for each hash.
    """

    def flagged(values: np.ndarray, marks: np.ndarray, first: np.ndarray) -> np.ndarray:
        return np.logical_or.reduceat(marks > 0, first)

    return asked.groupBy("owner").applyInArrow(_answered(_bits, flagged, HITS), HITS)


def known_with_another_mark(asked: DataFrame) -> DataFrame:
    """``block, hits, counts``: the hashes of each block that another block asked about too, with another mark.

    ``flags`` holds a packed number for each hash, its mark; SEVERAL differs from any mark, itself included.
    """

    def differing(values: np.ndarray, marks: np.ndarray, first: np.ndarray) -> np.ndarray:
        low, high = np.minimum.reduceat(marks, first), np.maximum.reduceat(marks, first)
        return (low != high) | (low == SEVERAL)

    return asked.groupBy("owner").applyInArrow(
        _answered(lambda data, count: unpack(data), differing, COUNTED_HITS), COUNTED_HITS
    )
