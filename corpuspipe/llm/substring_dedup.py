"""Substring de-duplication by fixed-block anchors.

Words that stand in a window of ``window`` consecutive words which also starts in a document with a smaller id
are removed. Each document is cut into non-overlapping anchors of ``(window + 1) // 2`` words, the longest that
every window holds one of whole, wherever the document is cut. They are the index; every rolling stretch of as many
words of every document probes it. Where an anchor is met in another document, the hit is extended: all windows
that hold it are compared whole across documents, and runs of equal windows are the maximal repeats.

Documents lie in packed blocks of about 8 MB of text. A block asks the owner of each hash range once for each
distinct hash, however often it repeats, and gets back what it needs to know: first which anchors other blocks
know, then for the windows around these the smallest id. So a passage that stands in a third of all documents is
one hash per block. Anchors are compared by as many hash bits as the corpus needs to make chance hits rare (they
only propose), windows by 96 bits.

Defined results: a null or empty text has no words; a text shorter than the window keeps all. Rows with the same
id do not remove from each other, so repeated rows all keep their words. A null id is larger than any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpuspipe.llm import grams
from corpuspipe.llm.blocks import ASKED, known_elsewhere, messages, owners_of, pack_blocks, shares
from corpuspipe.llm.common import keep_columns, store
from corpuspipe.llm.packing import pack, pack_sorted, unpack, unpack_rows, unpack_sorted

WINDOW = 13

# Hash bits of an anchor beyond those that tell all words of the corpus apart: one chance hit in 256 probes at most.
SPARE_BITS = 8

EARLIER = "block string, first binary, second binary, least binary"

NO_ID = np.uint64((1 << 64) - 1)
_SIGN = np.uint64(1 << 63)


def _ids(column: pa.Array) -> np.ndarray:
    """Ids as unsigned numbers of the same order; null is the largest."""
    ids = column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) ^ _SIGN
    ids[~column.is_valid().to_numpy(zero_copy_only=False)] = NO_ID
    return ids


class Block:
    """Hashes of a block of documents; the same whenever they are made from the same rows."""

    def __init__(self, rows: pa.RecordBatch, window: int, bits: int):
        self.window, self.span = window, (window + 1) // 2
        found = grams.words(rows.column(1), grams.PLAIN_WORDS)
        self.hashes, self.bounds, self.text_of = found.hashes, found.bounds, found.text_of()
        self.anchors = grams.grams(self.hashes, self.span) >> np.uint64(64 - bits)
        self.inside = grams.gram_starts(self.bounds, self.span)
        self.ids = _ids(rows.column(0))

    def probes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct anchors in order, whether one of them starts an anchor of the index, and whether two
        documents of this block have it, one of them in the index."""
        at = np.flatnonzero(self.inside)
        place = at - self.bounds[self.text_of[at]]
        indexed = place % self.span == 0
        order = np.argsort(self.anchors[at], kind="stable")  # documents stay in order
        values, texts, indexed = self.anchors[at][order], self.text_of[at][order], indexed[order]
        first = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.empty(0, dtype=np.int64)
        last = np.append(first[1:], len(values))[: len(first)] - 1
        in_index = np.logical_or.reduceat(indexed, first) if len(first) else np.empty(0, dtype=bool)
        return values[first], in_index, in_index & (texts[first] != texts[last])

    def candidates(self, hits: np.ndarray) -> np.ndarray:
        """Starts of windows that hold one of the anchors ``hits`` (in order)."""
        hit = np.zeros(len(self.hashes) + 1, dtype=np.int64)
        if len(hits) and len(self.anchors):
            at = np.searchsorted(hits, self.anchors)
            at[at == len(hits)] = 0
            hit[1 : len(self.anchors) + 1] = (hits[at] == self.anchors) & self.inside
        so_far = np.cumsum(hit)
        whole = grams.gram_starts(self.bounds, self.window)
        start = np.arange(len(whole))
        return np.flatnonzero(whole & (so_far[start + self.window - self.span + 1] > so_far[start]))

    def windows(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of each window: 64 and 32 bits."""
        first = grams.grams(self.hashes, self.window)[starts]
        return first, grams.grams(self.hashes, self.window, salt=1)[starts] >> np.uint64(32)


def _smallest(first: np.ndarray, second: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct windows in order with their smallest id, and for each input its place there."""
    order = np.lexsort((second, first))
    a, b = first[order], second[order]
    new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])) if len(a) else np.empty(0, dtype=bool)
    at = np.flatnonzero(new)
    place = np.empty(len(a), dtype=np.int64)
    place[order] = np.cumsum(new) - 1
    least = np.minimum.reduceat(ids[order], at) if len(at) else np.empty(0, dtype=np.uint64)
    return a[at], b[at], least, place


def known_anchors(blocks: DataFrame, window: int, bits: int, owners: int) -> DataFrame:
    """``block, hits``: the anchors of each block that another block has too, one of the two in the index."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, rows in zip(*batch.columns):
                values, indexed, _ = Block(unpack_rows(rows.as_py()), window, bits).probes()
                asked = [
                    (owner, name.as_py(), pack_sorted(values[a:b]), np.packbits(indexed[a:b]).tobytes())
                    for owner, a, b in shares(values, bits, owners)
                ]
                yield messages(asked, ASKED)

    return store(known_elsewhere(blocks.mapInArrow(ask, ASKED)), "substring-hits")


def _hits(block: Block, lists) -> np.ndarray:
    """Anchors known elsewhere or to two documents of the block, in order."""
    values, _, local = block.probes()
    return np.unique(np.concatenate([values[local], *(unpack_sorted(data) for data in lists or ())]))


def earlier_windows(blocks: DataFrame, hits: DataFrame, window: int, bits: int, owners: int) -> DataFrame:
    """``block, first, second, least``: windows of each block that start in a document of another block with a
    smaller id, and the smallest id."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, rows, lists in zip(*batch.columns):
                block = Block(unpack_rows(rows.as_py()), window, bits)
                starts = block.candidates(_hits(block, lists.as_py()))
                first, second = block.windows(starts)
                a, b, least, _ = _smallest(first, second, block.ids[block.text_of[starts]])
                asked = [
                    (owner, name.as_py(), pack_sorted(a[x:y]), pack(b[x:y]), pack(least[x:y])) for owner, x, y in shares(a, 64, owners)
                ]
                yield messages(asked, f"owner int, {EARLIER}")

    def answer(table: pa.Table) -> pa.Table:
        blocks_of = table.column("block").to_pylist()
        lists = [unpack_sorted(value.as_py()) for value in table.column("first")]
        first = np.concatenate(lists)
        second = np.concatenate([unpack(value.as_py()) for value in table.column("second")])
        own = np.concatenate([unpack(value.as_py()) for value in table.column("least")])
        _, _, least, place = _smallest(first, second, own)
        rows, at = [], 0
        for name, values in zip(blocks_of, lists):
            part = slice(at, at + len(values))
            at += len(values)
            smaller = least[place[part]] < own[part]
            if smaller.any():
                rows.append((name, pack_sorted(first[part][smaller]), pack(second[part][smaller]), pack(least[place[part]][smaller])))
        return pa.Table.from_batches([messages(rows, EARLIER)])

    joined = blocks.join(hits.groupBy("block").agg(F.collect_list("hits").alias("hits")), "block", "left")
    answered = joined.mapInArrow(ask, f"owner int, {EARLIER}").groupBy("owner").applyInArrow(answer, EARLIER)
    return store(answered, "substring-windows")


def _without(text: str, keep: np.ndarray) -> str:
    """The kept words of a text, joined by one space."""
    words = text.encode().split()
    if not keep.all():
        words = [words[k] for k in np.flatnonzero(keep)]
    return b" ".join(words).decode()


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Of every row: ``doc_id, n_words, n_removed, kept`` (the words that stay, joined by one space)."""
    spark = docs.sparkSession
    read = keep_columns(docs, doc_id="long", text="string")
    size = read.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    owners = owners_of(spark, size)
    bits = min(64, max(32, int(size // 2).bit_length() + SPARE_BITS))
    blocks = pack_blocks(read, "substring-blocks")
    hits = known_anchors(blocks, window, bits, owners)
    earlier = earlier_windows(blocks, hits, window, bits, owners)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, packed, lists, known in zip(*batch.columns):
                rows = unpack_rows(packed.as_py())
                block = Block(rows, window, bits)
                starts = block.candidates(_hits(block, lists.as_py()))
                first, second = block.windows(starts)
                ids = block.ids[block.text_of[starts]]
                a, b, least, place = _smallest(first, second, ids)
                for reply in known.as_py() or ():
                    x, y, z = unpack_sorted(reply["first"]), unpack(reply["second"]), unpack(reply["least"])
                    at = _find(a, b, x, y)
                    least[at] = np.minimum(least[at], z)
                gone = starts[least[place] < ids]
                cover = np.zeros(len(block.hashes) + 1, dtype=np.int64)
                np.add.at(cover, gone, 1)
                np.add.at(cover, np.minimum(gone + window, len(block.hashes)), -1)
                keep = np.cumsum(cover)[:-1] == 0
                counts = np.diff(block.bounds)
                kept = np.add.reduceat(np.append(keep, False), np.minimum(block.bounds[:-1], len(keep))) * (counts > 0)
                texts = [
                    _without(text.as_py() or "", keep[p:q]) for text, p, q in zip(rows.column(1), block.bounds[:-1], block.bounds[1:])
                ]
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array(counts.astype(np.int64)), pa.array((counts - kept).astype(np.int64)), pa.array(texts, pa.string())],
                    names=["doc_id", "n_words", "n_removed", "kept"],
                )

    joined = blocks.join(hits.groupBy("block").agg(F.collect_list("hits").alias("hits")), "block", "left").join(
        earlier.groupBy("block").agg(F.collect_list(F.struct("first", "second", "least")).alias("earlier")), "block", "left"
    )
    return joined.select("block", "rows", "hits", "earlier").mapInArrow(
        finish, "doc_id long, n_words long, n_removed long, kept string"
    )


def _find(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Places of the windows (x, y) among the ordered windows (a, b), which hold them all."""
    low = np.searchsorted(a, x, side="left")
    wrong = b[low] != y
    while wrong.any():  # windows with the same first hash: as good as never
        low[wrong] += 1
        wrong = b[low] != y
    return low
