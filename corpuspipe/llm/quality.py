"""Quality classifier by importance resampling.

Two generative models of hashed features (single words, word pairs, and one feature for a word that follows
itself) are counted: one of target text (rows labelled good), one of all raw text. The log ratio of their
probabilities, summed over a document's features, is the document's log importance weight. Gumbel noise makes
taking the k largest a sample without replacement; ``k`` is the number of documents whose weight reaches the
level that ``target_recall`` of the held-out target rows reach, so clean documents stay.

All rows labelled good are target rows. They are dealt into two halves by hash. The weights of the documents come from the
counts of both; the level from the weights that the target rows of each half have by the counts of the other half alone, so
that no row sets the level by a model that has seen it. The models are ``buckets`` numbers each.

Defined results: a null or empty text has weight 0. Without any target row every document is kept. Repeated
labels count once; a null label is no label. Noise is a function of the ``doc_id``, so repeated rows get equal
keys; equal keys are ordered by ``doc_id``. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from corpuspipe.llm import grams
from corpuspipe.llm.common import TEXT_ROWS, batches_of, boxed, keep_columns, store, unboxed
from corpuspipe.operators.scale import BROADCAST_ROWS, with_position
from corpuspipe.sources.pieces import released

BUCKETS = 1 << 12
TARGET_RECALL = 0.9999
TEMPERATURE = 0.1

# Runs of letters, digits and other characters are words; runs of ASCII punctuation are words of their own.
PUNCTUATION = bytes([*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)])
TOKENS = grams.alphabet(bytes([*range(0x00, 0x21), 0x7F]), PUNCTUATION, lower=False)

COUNTS = "feature int, raw long, target_0 long, target_1 long"


def features(column: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all texts and the text each belongs to."""
    found = grams.words(column, TOKENS)
    text_of = found.text_of()
    single = found.hashes
    pair = grams.grams(single, 2)
    pair[single[1:] == single[:-1]] = 1
    inside = grams.gram_starts(found.bounds, 2)
    both = np.concatenate([single, pair[inside]]) % np.uint64(buckets)
    return both.astype(np.int64), np.concatenate([text_of, text_of[: len(inside)][inside]])


def half_of(doc_id: Column) -> Column:
    """The half, 0 or 1, that a target row is dealt into."""
    return F.pmod(F.xxhash64(doc_id, F.lit("fit")), F.lit(2)).cast("int")


def target_ids(labels: DataFrame) -> DataFrame:
    """The ids of all documents labelled good and not toxic, each once."""
    return (
        labels.where((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0))
        .select(F.col("doc_id").cast("long").alias("target_id"))
        .where(F.col("target_id").isNotNull())
        .distinct()
    )


def feature_counts(docs: DataFrame, buckets: int) -> DataFrame:
    """Occurrences of each feature in all texts and in those whose ``target_half`` is 0 and 1."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((3, buckets), dtype=np.int64)
        for batch in batches:
            for group in grams.groups(batch, 0):
                number, text_of = features(group.column(0), buckets)
                half = group.column(1).fill_null(-1).to_numpy(zero_copy_only=False)[text_of]
                counts[0] += np.bincount(number, minlength=buckets)
                for which in (0, 1):
                    counts[1 + which] += np.bincount(number[half == which], minlength=buckets)
        seen = np.flatnonzero(counts[0])
        columns = [pa.array(seen.astype(np.int32)), *(pa.array(row[seen]) for row in counts)]
        yield pa.RecordBatch.from_arrays(columns, names=["feature", "raw", "target_0", "target_1"])

    counted = docs.select("text", "target_half").mapInArrow(run, COUNTS)
    return counted.groupBy("feature").agg(*(F.sum(name).alias(name) for name in ("raw", "target_0", "target_1")))


def log_ratios(counts: DataFrame, buckets: int) -> np.ndarray:
    """Log of target over raw probability of each feature, add-one smoothed: ``buckets`` numbers for the target rows of
    half 0, half 1 and both."""
    raw, halves = np.ones(buckets), np.zeros((2, buckets))
    for row in counts.toLocalIterator():
        raw[row["feature"]] += row["raw"]
        halves[:, row["feature"]] += row["target_0"], row["target_1"]
    target = np.stack([halves[0], halves[1], halves.sum(axis=0)]) + 1
    return np.log(target / target.sum(axis=1, keepdims=True)) - np.log(raw / raw.sum())


def log_weights(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """``doc_id``, ``text_hash``, ``n_features``, ``log_weight`` by both halves and ``unseen_weight`` by the half that is
    not the document's, of every row."""
    buckets = ratios.shape[1]

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group in grams.groups(batch, 0):
                number, text_of = features(group.column(0), buckets)
                n = np.bincount(text_of, minlength=group.num_rows)
                other = 1 - group.column(3).to_numpy(zero_copy_only=False)
                weight = np.bincount(text_of, weights=ratios[2][number], minlength=group.num_rows)
                unseen = np.bincount(text_of, weights=ratios[other[text_of], number], minlength=group.num_rows)
                yield pa.RecordBatch.from_arrays(
                    [group.column(1), group.column(2), pa.array(n.astype(np.int64)), pa.array(weight.astype(np.float64)), pa.array(unseen.astype(np.float64))],
                    names=["doc_id", "text_hash", "n_features", "log_weight", "unseen_weight"],
                )

    return docs.select("text", "doc_id", F.xxhash64("text").alias("text_hash"), half_of(F.col("doc_id")).alias("half")).mapInArrow(
        run, "doc_id long, text_hash long, n_features long, log_weight double, unseen_weight double"
    )


def quantile(rows: DataFrame, column: str, share: float) -> float | None:
    """The exact quantile, between two neighbours in proportion, as ``percentile`` has it; from sorted ranges of any size."""
    placed = with_position(rows.select(column), F.col(column), into="place")
    place = (placed.count() - 1) * share
    if place < 0:
        return None
    low = int(place)
    found = {row["place"]: row[column] for row in placed.where(F.col("place").isin(low + 1, low + 2)).collect()}
    return found[low + 1] + (place - low) * (found.get(low + 2, found[low + 1]) - found[low + 1])


def gumbel(doc_id, seed: int):
    """Gumbel noise as a function of the id, so that a repeated task draws the same."""
    uniform = (F.shiftrightunsigned(F.xxhash64(doc_id, F.lit(seed)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return -F.log(-F.log(uniform))


def resample(
    docs: DataFrame,
    labels: DataFrame,
    buckets: int = BUCKETS,
    target_recall: float = TARGET_RECALL,
    temperature: float = TEMPERATURE,
    seed: int = 1,
) -> DataFrame:
    """One row per document: ``doc_id, text_hash, n_features, log_weight, sample_key, sample_rank, kept``."""
    target = store(target_ids(labels), "quality-target")
    known = F.broadcast(target) if target.count() <= BROADCAST_ROWS else target
    read = keep_columns(docs, doc_id="long", text="string")
    marked = read.join(known, F.col("doc_id") == F.col("target_id"), "left").select(
        "text", F.when(F.col("target_id").isNotNull(), half_of(F.col("doc_id"))).alias("target_half")
    )
    with batches_of(docs.sparkSession, TEXT_ROWS):
        ratios = log_ratios(feature_counts(marked, buckets), buckets)
        weighed = store(log_weights(read, ratios), "quality-weights")
    level = quantile(weighed.join(known, F.col("doc_id") == F.col("target_id")), "unseen_weight", 1 - target_recall)
    size = weighed.where(F.col("log_weight") >= level).count() if level is not None else weighed.count()
    keyed = weighed.drop("unseen_weight").withColumn(
        "sample_key", F.col("log_weight") + F.lit(temperature) * gumbel(F.col("doc_id"), seed)
    )
    ranked = with_position(keyed, F.desc("sample_key"), F.col("doc_id"), into="sample_rank")
    return ranked.withColumn("kept", F.col("sample_rank") <= F.lit(size))


def without_rejected(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` that are sampled, with all their columns.

    The rejected rows are the smaller side, so their ids and text hashes are what the texts are joined with.
    """
    rejected = store(resample(docs, labels, **settings).where(~F.col("kept")).select("doc_id", "text_hash").distinct(), "quality-rejected")
    rows = boxed(docs, id=F.col("doc_id").cast("long"), hash=F.xxhash64(F.col("text").cast("string")))
    same = F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("text_hash"))
    return unboxed(rows.join(rejected, same, "left_anti"))
