"""Benchmark decontamination: n-gram seeds and Smith-Waterman alignment.

An alignment at the level ``least_score`` may have only so many edits, and so many edits leave a least number of the
item's n-grams whole (see ``plan_item``). All n-grams of an item are seeds but for its commonest half of that number, by
document counts over the whole corpus; a document that has the rest of that number close to one diagonal is aligned with
the item there, word by word, by Smith-Waterman. So no copy at the level is passed over, and phrases that are common
anyway propose few pairs. The score is the share of the best score possible, so copies with edits or gaps score high.

The test items are the stated query set. They are taken in passes of at most ``words_per_pass`` words, which
bounds what tasks are given; a larger set takes more passes over the texts, not more memory. Texts never move. An item of
any length is aligned in memory of the square root of its length, times the stretch of text.

Defined results: null and empty texts hold nothing. An item with fewer than ``n`` words is found nowhere. Repeated
rows, of documents or items, are reported each. Of several places of an item in a document the best is reported, the
first among equals. ``seeds`` is the number of seeds found there. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpuspipe.llm import grams
from corpuspipe.llm.common import TEXT_ROWS, batches_of, boxed, keep_columns, store, unboxed
from corpuspipe.sources.pieces import released

N = 3
LEAST_SCORE = 0.6
WORDS_PER_PASS = 2_000_000

MATCH, MISMATCH, GAP = 2, -1, -1

# Words of documents that are aligned at once; longer stretches are taken in overlapping windows.
WINDOW_WORDS = 8_192

# Seed hits of documents, times the items they lead to, that are handled at once (one document may have more).
HITS = 1 << 18

LETTERS = grams.alphabet(bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))

FOUND = (
    "doc_id long, text_hash long, item_id long, seeds long, score double, matches long, "
    "first_word long, last_word long, item_first long, item_last long"
)


class Lookup:
    """Places of hashes in a sorted table; most hashes are turned away by one bit."""

    def __init__(self, values: np.ndarray):
        self.values = values
        self.some = np.zeros(1 << 20, dtype=bool)
        self.some[values >> np.uint64(44)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the hashes that are in the table, and their numbers there."""
        maybe = np.flatnonzero(self.some[hashes >> np.uint64(44)])
        at = np.searchsorted(self.values, hashes[maybe])
        at[at == len(self.values)] = 0
        same = self.values[at] == hashes[maybe] if len(self.values) else np.zeros(len(maybe), dtype=bool)
        return maybe[same], at[same]


@dataclass(frozen=True)
class Plan:
    """What every alignment of an item at the level has at least (``score``, ``hits``) and at most (``edits``)."""

    score: int
    length: int  # words of its seed n-grams
    hits: int
    edits: int


def plan_item(words: int, least_score: float) -> Plan:
    """Seed length and counts for an item, from the scores alone.

    M matches and E edits score at most 2 M - E, so E <= 2 M - score <= 2 words - score. The edits cut the matches into
    at most E + 1 runs, which hold M - E - 1 >= score - M - 1 >= score - words - 1 pairs of neighbours. Where that
    promises no pair (short items, low levels), single words are the seeds: M >= score / 2.
    """
    score = max(1, int(least_score * MATCH * words) - 1)
    while score / (MATCH * words) < least_score:
        score += 1
    edits, pairs = max(MATCH * words - score, 0), score - words - 1
    return Plan(score, 2, pairs, edits) if pairs > 0 else Plan(score, 1, -(-score // MATCH), edits)


@dataclass
class Items:
    """Items of one pass: ids, word hashes, plans, and the distinct n-grams with their owners."""

    ids: list[int]
    words: list[np.ndarray]
    plans: list[Plan]
    values: np.ndarray  # distinct n-grams, sorted
    owners: np.ndarray  # (number of the n-gram, item, first word), by item and first word

    @property
    def lengths(self) -> list[int]:
        return sorted({plan.length for plan in self.plans})


@dataclass
class Seeds:
    """Seed n-grams, sorted, and the (item, first word) each leads to: ``bounds[i]:bounds[i + 1]`` those of seed ``i``."""

    values: np.ndarray
    bounds: np.ndarray
    items: np.ndarray
    places: np.ndarray
    needed: np.ndarray  # for each item the least number of its seeds in an alignment


def read_items(ids: list[int], texts: list[str | None], n: int, least_score: float) -> Items:
    found = grams.words(pa.array(texts, pa.string()), LETTERS)
    each = [(k, found.hashes[a:b]) for k, a, b in zip(ids, found.bounds[:-1], found.bounds[1:]) if b - a >= max(n, 1)]
    words = [item for _, item in each]
    plans = [plan_item(len(item), least_score) for item in words]
    own = [grams.grams(item, plan.length) for item, plan in zip(words, plans)]
    hashes = np.concatenate(own) if own else np.empty(0, dtype=np.uint64)
    values, numbers = np.unique(hashes, return_inverse=True)
    sizes = [len(item) for item in own]
    item_of = np.repeat(np.arange(len(own)), sizes)
    places = np.concatenate([np.arange(size) for size in sizes]) if own else np.empty(0, dtype=np.int64)
    return Items([k for k, _ in each], words, plans, values, np.stack([numbers, item_of, places], axis=1).astype(np.int64))


def document_counts(docs: DataFrame, values: np.ndarray, lengths: list[int]) -> np.ndarray:
    """In how many documents each n-gram stands."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, counts = Lookup(values), np.zeros(len(values), dtype=np.int64)
        for batch in batches:
            for group in grams.groups(batch, 0):
                found = grams.words(group.column(0), LETTERS)
                for length in lengths:
                    at, number = lookup.find(grams.grams(found.hashes, length))
                    inside = grams.gram_starts(found.bounds, length)[at]
                    text = np.searchsorted(found.bounds, at[inside], side="right") - 1
                    once = np.unique(text * np.int64(len(values)) + number[inside])
                    counts += np.bincount(once % len(values), minlength=len(values))
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[seen])], names=["number", "docs"])

    total = np.zeros(len(values), dtype=np.int64)
    if len(values):
        counted = docs.select("text").mapInArrow(run, "number long, docs long").groupBy("number").agg(F.sum("docs").alias("docs"))
        with batches_of(docs.sparkSession, TEXT_ROWS):
            for row in counted.toLocalIterator():
                total[row["number"]] = row["docs"]
    return total


def choose_seeds(items: Items, docs_with: np.ndarray) -> Seeds:
    """Each item's n-grams without its commonest half of ``hits``; the other half of them is in every alignment."""
    number, item, place = items.owners.T
    order = np.lexsort((place, -docs_with[number], item))
    hits = np.array([plan.hits for plan in items.plans], dtype=np.int64)
    left_out = hits // 2
    rank = np.arange(len(order)) - np.searchsorted(item[order], item[order])
    kept = order[rank >= left_out[item[order]]]
    kept = kept[np.lexsort((place[kept], item[kept], number[kept]))]
    numbers, first = np.unique(number[kept], return_index=True)
    return Seeds(items.values[numbers], np.append(first, len(kept)), item[kept], place[kept], hits - left_out)


def _next_row(row: np.ndarray, word: np.uint64, text: np.ndarray, slope: np.ndarray) -> np.ndarray:
    """The row of one more word of the item; a gap along the row is a running maximum."""
    below = np.zeros_like(row)
    np.maximum(row[1:] + GAP, row[:-1] + np.where(text == word, MATCH, MISMATCH).astype(row.dtype), out=below[1:])
    np.maximum(below, 0, out=below)
    return np.maximum.accumulate(below - slope) + slope


def smith_waterman(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int, int, int, int]:
    """Best local alignment of two word sequences: score, matches, and the first and last word of text and item.

    Only every k-th row is kept, k the root of the item's length; the way back makes the rows between two of them again. So an
    item of m words takes about 2 * sqrt(m) rows at once instead of m.
    """
    m, n = len(item), len(text)
    slope = np.arange(n + 1, dtype=np.int32) * np.int32(GAP)
    every = math.isqrt(m) + 1
    row = np.zeros(n + 1, dtype=np.int32)
    kept = [row]
    score = i = j = 0
    for number in range(1, m + 1):
        row = _next_row(row, item[number - 1], text, slope)
        if number % every == 0:
            kept.append(row)
        top = int(row.argmax())
        if row[top] > score:
            score, i, j = int(row[top]), number, top
    last_item, last_text, matches = i - 1, j - 1, 0
    value = score
    while value > 0:
        base = (i - 1) // every * every
        rows = [kept[base // every]]
        for number in range(base, i):
            rows.append(_next_row(rows[-1], item[number], text, slope))
        while value > 0 and i > base:
            above, same = rows[i - base - 1], item[i - 1] == text[j - 1]
            if value == above[j - 1] + (MATCH if same else MISMATCH):
                matches += bool(same)
                i, j = i - 1, j - 1
            elif value == above[j] + GAP:
                i -= 1
            else:
                j -= 1
            value = int(rows[i - base][j])
    return score, matches, j, last_text, i, last_item


def _stretches(places: list[int], words: int, slack: int, length: int) -> Iterator[tuple[int, int]]:
    """Parts of a text around the places where an item would start, each at most WINDOW_WORDS long."""
    low = high = None
    window = max(WINDOW_WORDS, 2 * (words + 2 * slack))
    for place in [*sorted(places), None]:
        if high is not None and (place is None or place - slack > high):
            step = window - words - 2 * slack
            for at in range(low, high, step):
                yield max(at, 0), min(at + window, high, length)
                if at + window >= high:
                    break
            low = high = None
        if place is not None:
            low = max(place - slack, 0) if low is None else low
            high = min(place + words + slack, length)


def proposed(found: grams.Words, seeds: Seeds, lookup: Lookup, lengths: list[int], edits: np.ndarray) -> Iterator[tuple[int, int, list[int]]]:
    """Texts and items with enough seeds close to one diagonal, and where the item would start in the text."""
    hits = []
    for length in lengths:
        at, number = lookup.find(grams.grams(found.hashes, length))
        inside = grams.gram_starts(found.bounds, length)[at]
        hits.append(np.stack([at[inside], number[inside]]))
    at, number = np.concatenate(hits, axis=1)
    order = np.argsort(at, kind="stable")
    at, number = at[order], number[order]
    text = np.searchsorted(found.bounds, at, side="right") - 1
    leads = seeds.bounds[number + 1] - seeds.bounds[number]
    total = np.cumsum(leads)
    low = 0
    while low < len(at):
        before = total[low - 1] if low else 0
        high = int(np.searchsorted(total, before + HITS, side="right"))
        if high < len(at):  # whole texts
            start = int(np.searchsorted(text, text[high]))
            high = start if start > low else int(np.searchsorted(text, text[low], side="right"))
        own = leads[low:high]
        lead = np.arange(own.sum()) + np.repeat(seeds.bounds[number[low:high]] - (np.cumsum(own) - own), own)
        item = seeds.items[lead]
        text_of = np.repeat(text[low:high], own)
        start = np.repeat(at[low:high], own) - found.bounds[text_of] - seeds.places[lead]
        order = np.lexsort((start, item, text_of))
        item, text_of, start = item[order], text_of[order], start[order]
        first = np.arange(len(start))
        last = first + seeds.needed[item] - 1
        end = np.minimum(last, len(start) - 1)
        enough = (last == end) & (text_of[end] == text_of) & (item[end] == item) & (start[end] - start <= edits[item])
        steps = np.zeros(len(start) + 1, dtype=np.int64)
        np.add.at(steps, first[enough], 1)
        np.add.at(steps, last[enough] + 1, -1)
        kept = np.flatnonzero(np.cumsum(steps[:-1]) > 0)
        if len(kept):
            item, text_of, start = item[kept], text_of[kept], start[kept]
            cuts = np.flatnonzero((np.diff(item) != 0) | (np.diff(text_of) != 0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(kept)]):
                yield int(text_of[a]), int(item[a]), start[a:b].tolist()
        low = high


def aligned(docs: DataFrame, items: Items, seeds: Seeds, least_score: float) -> DataFrame:
    """Documents and items that align with at least ``least_score``."""
    ids, words, plans, lengths = items.ids, items.words, items.plans, items.lengths
    edits = np.array([plan.edits for plan in plans], dtype=np.int64)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(seeds.values)
        names = [field.split()[0] for field in FOUND.split(", ")]
        kinds = [pa.float64() if name == "score" else pa.int64() for name in names]
        for batch in batches:
            for group in grams.groups(batch, 2):
                found = grams.words(group.column(2), LETTERS)
                rows = []
                for text, item, places in proposed(found, seeds, lookup, lengths, edits):
                    own = found.hashes[found.bounds[text] : found.bounds[text + 1]]
                    plan, best = plans[item], None
                    for low, high in _stretches(places, len(words[item]), plan.edits, len(own)):
                        if MATCH * np.isin(words[item], own[low:high]).sum() < plan.score:
                            continue  # too few of the item's words are there
                        score, matches, first, last, item_first, item_last = smith_waterman(words[item], own[low:high])
                        if best is None or score > best[0]:
                            best = score, matches, low + first, low + last, item_first, item_last
                    share = best[0] / (MATCH * len(words[item])) if best else 0
                    if best and share >= least_score:
                        rows.append(
                            (group.column(0)[text].as_py(), group.column(1)[text].as_py(), ids[item], len(places), share, *best[1:])
                        )
                columns = list(zip(*rows)) if rows else [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return docs.select("doc_id", "text_hash", "text").mapInArrow(run, FOUND)


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    n: int = N,
    least_score: float = LEAST_SCORE,
    words_per_pass: int = WORDS_PER_PASS,
) -> DataFrame:
    """One row per document and item that align: scores, and the words of both that do."""
    spark = docs.sparkSession
    read = keep_columns(docs, doc_id="long", text="string").withColumn("text_hash", F.xxhash64("text"))
    tests = keep_columns(benchmark, item_id="long", text="string").where(F.col("text").isNotNull())
    # A word has two bytes at least, with the blank before the next.
    size = tests.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = max(1, -(-int(size) // (2 * words_per_pass)))
    out = spark.createDataFrame([], FOUND)
    for k in range(passes):
        chosen = tests.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k) if passes > 1 else tests
        rows = chosen.orderBy("item_id", "text").collect()  # at most about words_per_pass words
        items = read_items([row["item_id"] for row in rows], [row["text"] for row in rows], n, least_score)
        if items.ids:
            seeds = choose_seeds(items, document_counts(read, items.values, items.lengths))
            out = out.unionByName(aligned(read, items, seeds, least_score))
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` that hold no test item, with all their columns."""
    found = find_leaks(docs, benchmark, **settings).select("doc_id", "text_hash").distinct()
    with batches_of(docs.sparkSession, TEXT_ROWS):
        leaks = store(found, "leaks")
    rows = boxed(docs, id=F.col("doc_id").cast("long"), hash=F.xxhash64(F.col("text").cast("string")))
    same = F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("text_hash"))
    return unboxed(rows.join(leaks, same, "left_anti"))
