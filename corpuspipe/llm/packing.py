"""Arrays of whole numbers as short byte strings, for columns that carry many of them in one row."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa

_HEAD = struct.Struct("<QB")
_CODEC = pa.Codec("zstd", compression_level=1)


def pack(numbers: np.ndarray) -> bytes:
    """Byte by byte position, so that high zero bytes vanish when compressed."""
    numbers = np.ascontiguousarray(numbers, dtype=np.uint64)
    top = int(numbers.max()) if len(numbers) else 0
    width = max(1, (top.bit_length() + 7) // 8)
    planes = np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, 8)[:, :width].T)
    return _HEAD.pack(len(numbers), width) + _CODEC.compress(planes.tobytes(), asbytes=True)


def unpack(data: bytes) -> np.ndarray:
    n, width = _HEAD.unpack_from(data)
    if not n:
        return np.empty(0, dtype=np.uint64)
    planes = _CODEC.decompress(memoryview(data)[_HEAD.size :], n * width, asbytes=True)
    out = np.zeros((n, 8), dtype=np.uint8)
    out[:, :width] = np.frombuffer(planes, dtype=np.uint8).reshape(width, n).T
    return out.view(np.uint64).ravel()


def pack_sorted(numbers: np.ndarray) -> bytes:
    """Ascending numbers, as their differences."""
    return pack(np.diff(numbers, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)


def pack_rows(batch: pa.RecordBatch) -> bytes:
    """Whole rows, compressed."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=_CODEC)) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack_rows(data: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(data).read_next_batch()
