"""Arrow columns worked on a few megabytes at a time, so that a worker holds little beside the batch at hand."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc

# Bytes and rows of a batch whose values are Python objects at one time (one longer value is a piece of its own).
PIECE_BYTES = 1 << 20
PIECE_ROWS = 1_000


def release_memory() -> None:
    """Give back what earlier steps of this worker have freed, where the C library can."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def released(work: Callable) -> Callable:
    """``work`` over the batches of a task, in a worker that keeps nothing freed before it starts nor after it ends.

    Workers stay for later tasks, and those that wait count in an executor's memory like the ones that run.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        yield from work(batches)
        release_memory()

    return run


def released_group(work: Callable) -> Callable:
    """``work`` over the table of a group; what it has freed is given back."""

    def run(table: pa.Table) -> pa.Table:
        done = work(table)
        release_memory()
        return done

    return run


def pieces(columns: tuple[pa.Array, ...]) -> Iterator[tuple[list, ...]]:
    """The values of consecutive rows; the last column, of texts or bytes, says where a piece is full."""
    sizes = pc.fill_null(pc.binary_length(columns[-1]), 0).to_pylist()
    at = 0
    while at < len(sizes):
        end, held = at, 0
        while end < len(sizes) and end - at < PIECE_ROWS and (end == at or held + sizes[end] <= PIECE_BYTES):
            held += sizes[end]
            end += 1
        yield tuple(column.slice(at, end - at).to_pylist() for column in columns)
        at = end


def mapped(batches: Iterator[tuple[pa.Array, ...]], work: Callable, kind: pa.DataType) -> Iterator[pa.Array]:
    """``work`` of the values of every row, a batch of results for each batch."""
    for columns in batches:
        done = [pa.array(map(work, *values), kind) for values in pieces(columns)]
        yield pa.concat_arrays(done) if done else pa.array([], kind)
        del columns, done
        release_memory()
