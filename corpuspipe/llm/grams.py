"""Words and word n-grams of whole text columns as 64-bit hashes, in numpy.

Works on the UTF-8 bytes of an Arrow column, in stretches of about a megabyte that end between words, so
memory beyond the hashes themselves (eight bytes a word) is bounded however long one text is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

STRETCH = 1 << 20

# Texts are handled in groups of about this many bytes (one longer text is a group of its own).
GROUP_BYTES = 4 << 20

_random = np.random.default_rng(20_240_229)
_BYTE_VALUES = _random.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_WEIGHTS = _random.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHORT = _random.integers(1, 1 << 63, 64, dtype=np.uint64)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POWERS = _powers(_BASE, STRETCH)
_INVERSES = _powers(_BASE_INVERSE, STRETCH)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the entropy of a 64-bit value over all bits (a bijection)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass(frozen=True)
class Alphabet:
    """``kinds[b]``: 0 for bytes between words; words are maximal runs of one other kind. ``fold`` maps bytes."""

    kinds: np.ndarray
    fold: np.ndarray

    @property
    def values(self) -> np.ndarray:
        return _BYTE_VALUES[self.fold]


def alphabet(between: bytes, punctuation: bytes = b"", lower: bool = True) -> Alphabet:
    kinds = np.ones(256, dtype=np.uint8)
    kinds[list(punctuation)] = 2
    kinds[list(between)] = 0
    fold = np.arange(256, dtype=np.uint8)
    if lower:
        fold[65:91] += 32
    return Alphabet(kinds, fold)


#: The white space that ends a word, U+0020 and U+0009 to U+000D.
BLANKS = bytes([0x20, *range(0x09, 0x0E)])
LOWER_WORDS = alphabet(BLANKS)
PLAIN_WORDS = alphabet(BLANKS, lower=False)


@dataclass
class Words:
    """Hashes of all words of a group of texts, ``bounds[i]:bounds[i + 1]`` being those of text ``i``.

    ``starts`` and ``ends`` are byte offsets in ``data`` where they were asked for.
    """

    hashes: np.ndarray
    bounds: np.ndarray
    data: np.ndarray
    starts: np.ndarray | None = None
    ends: np.ndarray | None = None

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def text_of(self) -> np.ndarray:
        """The text each word belongs to."""
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all values and where each value starts; nulls are empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, dtype=np.uint8) if buffer else np.empty(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _cuts(data: np.ndarray, edges: np.ndarray, kinds: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches that end between words or texts."""
    at, n = 0, len(data)
    while at < n:
        end = min(at + STRETCH, n)
        if end < n:
            blanks = np.flatnonzero(kinds[data[at:end]] == 0)
            edge = edges[np.searchsorted(edges, end, side="right") - 1]
            best = max(at + int(blanks[-1]) + 1 if len(blanks) else at, int(edge))
            while best <= at:  # a word longer than a stretch
                following = np.flatnonzero(kinds[data[end : end + STRETCH]] == 0)
                edge = int(edges[np.searchsorted(edges, end, side="left")])
                best = end + int(following[0]) if len(following) else min(end + STRETCH, n)
                if edge <= best or len(following) or best == n:
                    best = min(best, edge)
                else:
                    end, best = best, at
            end = best
        yield at, end
        at = end


def words(column: pa.Array, letters: Alphabet, places: bool = False) -> Words:
    """All words of a column of texts."""
    data, edges = text_bytes(column)
    values = letters.values
    hashes, starts, ends = [], [], []
    for low, high in _cuts(data, edges, letters.kinds):
        part = data[low:high]
        kinds = letters.kinds[part]
        new = np.empty(len(part), dtype=bool)
        new[0] = True
        np.not_equal(kinds[1:], kinds[:-1], out=new[1:])
        inner = edges[np.searchsorted(edges, low, side="right") : np.searchsorted(edges, high, side="left")] - low
        new[inner] = True
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(part))
        word = kinds[first] != 0
        first, last = first[word], last[word]
        if len(part) <= STRETCH:
            powers, inverses = _POWERS[: len(part)], _INVERSES
        else:
            powers, inverses = _powers(_BASE, len(part)), _powers(_BASE_INVERSE, len(part))
        sums = np.empty(len(part) + 1, dtype=np.uint64)
        sums[0] = 0
        np.cumsum(values[part] * powers, dtype=np.uint64, out=sums[1:])
        hashes.append(mixed((sums[last] - sums[first]) * inverses[first] + (last - first).astype(np.uint64)))
        starts.append(first + low)
        if places:
            ends.append(last + low)
    joined = np.concatenate(hashes) if hashes else np.empty(0, dtype=np.uint64)
    at = np.concatenate(starts) if starts else np.empty(0, dtype=np.int64)
    bounds = np.searchsorted(at, edges, side="left")
    if not places:
        return Words(joined, bounds, data)
    return Words(joined, bounds, data, at, np.concatenate(ends) if ends else np.empty(0, dtype=np.int64))


def grams(hashes: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """Hash of the ``n`` words that start at each word, also across texts; ``n - 1`` fewer than words."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.full(count, np.uint64((n + 64 * salt) * int(_WEIGHTS[-1 - salt]) % (1 << 64)), dtype=np.uint64)
    for j in range(n):
        out += hashes[j : j + count] * (_WEIGHTS[j] ^ (_SHORT[salt] << np.uint64(1)))
    return mixed(out)


def gram_starts(bounds: np.ndarray, n: int) -> np.ndarray:
    """For each possible start of ``n`` words whether they lie in one text."""
    total = int(bounds[-1])
    inside = np.ones(max(0, total - n + 1), dtype=bool)
    ends = bounds[1:]
    for back in range(1, n):
        at = ends - back
        at = at[(at >= bounds[:-1]) & (at < len(inside))]
        inside[at] = False
    return inside


def groups(batch: pa.RecordBatch, column: int, size: int = GROUP_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive rows whose texts together have about ``size`` bytes."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(sizes, dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        before = total[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(total, before + size, side="right")))
        yield batch.slice(at, end - at)
        at = end
