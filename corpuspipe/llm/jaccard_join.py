"""N-gram Jaccard join by parity sketches.

The set of a text is its distinct word n-grams. Two texts link when ``den * |A & B| >= num * |A | B|``. That bounds
the symmetric difference: ``|A ^ B| <= (|A| + |B|) * (den - num) / (den + num)``.

Texts are taken by bands of their set's size, so that partners meet in one band. In a band every n-gram flips one
bit of a sketch, by its hash. Two sketches differ in at most as many bits as the sets differ in n-grams: the Hamming
distance bounds the symmetric difference from below. With ``d`` differences allowed in the band, a sketch has ``d + 1 + e``
parts (pigeonhole), so partners agree in ``e + 1`` parts at least; parts are the keys of the join. Every set leaves out its
``e`` weakest parts, those with the fewest bits set (ties: the smallest key). That is safe, because strength belongs to the
part's value: of the parts that two partners agree in, the strongest has ``e`` weaker ones in either set. So unrelated texts
do not meet in empty parts, nor in parts of one common n-gram. Sparse parts are never written out: a part's key is the xor
of a hash of each bit that is set.

Any order of the parts' values will do for that, and one part of them all may be left out by one order and another by the next:
of the ``e``, a share is left out by how many blocks have the key (and more by a set whose partners differ in less than the
band allows). So a set that shares no more keys than those goes at once, and texts that only meet by chance, or in passages
that many have, seldom become rows.

Equal sets are one class from the start. Blocks of documents find out which keys other sets have (see ``blocks``;
a key goes with a mark of its set, so that copies do not count), and only these become rows. Candidates of a key are
checked by a short second sketch and then on the sets themselves:

1. each class with the smallest row of its key; the links make components;
2. where a key still joins several components without that row, all pairs across components that pass the sketch.

A pair inside a component adds nothing, nor does a pair that the first round compared, so no link between components is
missed, and a large group of near copies gives a star of pairs instead of all of them. Keys of the same sets give the same
pairs, so one key stands for all of them. One order of rows gives the keys of a family few centres between them; a centre
drawn for each key would give nearly all pairs of a family.

Defined results: null and empty texts have an empty set, link with nothing and are their own component. A text with
fewer words than ``n`` has its whole sequence as its one n-gram. A null id never names a component unless all
members have none. Repeated rows are equal texts. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpuspipe.llm import grams
from corpuspipe.llm.blocks import ASKED, SEVERAL, known_with_another_mark, messages, owners_of, pack_blocks, shares
from corpuspipe.llm.common import batches_of, boxed, discard, join_hot, keep_columns, store, unboxed
from corpuspipe.llm.components import components
from corpuspipe.llm.packing import pack, pack_sorted, unpack, unpack_rows, unpack_sorted
from corpuspipe.sources.pieces import released

# Width of the bands: each reaches to this multiple of its start, or as far as partners do.
BAND_RATIO = 1.5

# Parts a sketch has beyond the differences allowed and one, as a share of those (numerator, denominator).
SPARE = (2, 3)

# Spare parts of a band, as a share of the same, that are not left out as weak: they are left out because many blocks have them.
FREQUENT = (1, 3)

# Pairs of a centre that one slice of them holds.
SLICE = 1_000

# Bits of a part of a band's sketch, and words of the short sketch that candidates are checked with.
PART_BITS = 1 << 12
CHECK_WORDS = 16

# Words of the long sketch for each so many n-grams; a set no larger than the short sketch is good for has none.
LONG_WORDS = 32

# Rows of a batch in which values are compared: a value may have some hundred kilobytes.
COMPARED_ROWS = 256

# Blocks of a batch: a packed block may have some megabytes.
BLOCK_ROWS = 4

SETS = "doc_id long, n_shingles long, f1 long, f2 long, keys array<long>, sketch array<long>, long_sketch binary, block string, place int"


class Bands:
    """Bands of set sizes for a threshold ``num / den``."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.starts = [1]
        while self.starts[-1] < 1 << 40:
            start = self.starts[-1]
            self.starts.append(max(start * den // num + 1, int(start * BAND_RATIO)))
        starts = np.array(self.starts, dtype=np.int64)
        largest = np.append(starts[1:] - 1, starts[-1])
        # A pair of the band: the larger set in it, the smaller in it or in the band before.
        self.used = 2 * largest * (den - num) // (den + num) + 1
        self.spare = self.used * SPARE[0] // SPARE[1]
        self.weak = np.maximum(self.spare - self.used * FREQUENT[0] // FREQUENT[1], 0)
        self.parts = self.used + self.spare
        self.starts, self.largest = starts, largest
        self.least = -(-starts * num // den)  # smallest set that can be a partner in the band

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, sizes, side="right") - 1

    def frequent(self, sizes: np.ndarray, band: np.ndarray) -> np.ndarray:
        """How many of the keys that sets of these sizes share in a band may be left out, beside the weak parts.

        Partners of the band agree in all parts but as many as they may differ in, which is less for small sets than for the band.
        """
        partner = np.minimum(self.largest[band], sizes * self.den // self.num)
        differ = (sizes + partner) * (self.den - self.num) // (self.den + self.num)
        return self.parts[band] - self.weak[band] - differ - 1


class Sets:
    """Distinct n-grams of the texts of a block, in order text by text."""

    def __init__(self, column: pa.Array, n: int):
        found = grams.words(column, grams.LOWER_WORDS)
        text_of, counts = found.text_of(), found.counts
        whole = grams.grams(found.hashes, n)
        at = np.flatnonzero(grams.gram_starts(found.bounds, n))
        hashes, texts = [whole[at]], [text_of[at]]
        for short in range(1, n):
            only = np.flatnonzero(counts == short)
            if len(only):
                hashes.append(grams.grams(found.hashes, short)[found.bounds[only]])
                texts.append(only)
        hash_, text = np.concatenate(hashes), np.concatenate(texts)
        order = np.lexsort((hash_, text))
        hash_, text = hash_[order], text[order]
        new = np.append(True, (hash_[1:] != hash_[:-1]) | (text[1:] != text[:-1])) if len(hash_) else np.empty(0, dtype=bool)
        self.hashes, self.text = hash_[new], text[new]
        self.sizes = np.bincount(self.text, minlength=len(column)).astype(np.int64)
        self.bounds = np.append(0, np.cumsum(self.sizes))

    def summed(self, values: np.ndarray) -> np.ndarray:
        """Sum of the values of each set, modulo 2 ** 64."""
        so_far = np.append(np.uint64(0), np.cumsum(values, dtype=np.uint64))
        return so_far[self.bounds[1:]] - so_far[self.bounds[:-1]]

    def fingerprints(self) -> tuple[np.ndarray, np.ndarray]:
        return self.summed(grams.mixed(self.hashes)), self.summed(grams.mixed(self.hashes ^ np.uint64(0x5851F42D4C957F2D)))

    def keys(self, bands: Bands) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys of the parts of all sketches but the weakest, the text each belongs to, and the band of its sketch."""
        keys, texts, bands_of = [], [], []
        band = bands.of(self.sizes)
        for shift in (0, 1):
            of = np.minimum(band + shift, len(bands.starts) - 1)
            # Sets that allow no difference are equal or no partners; classes see to those.
            used = (self.sizes > 0) & (bands.used[of] > 1) & ((shift == 0) | (self.sizes >= bands.least[of]))
            parts = np.where(used, bands.parts[of], 0)
            base = np.cumsum(parts) - parts
            total = int(parts.sum())
            chosen = used[self.text]
            text = self.text[chosen]
            bit = grams.mixed(self.hashes[chosen] + of[text].astype(np.uint64)) % (parts[text].astype(np.uint64) * np.uint64(PART_BITS))
            at = np.sort(base[text].astype(np.uint64) * np.uint64(PART_BITS) + bit)
            value, strength = np.zeros(total, dtype=np.uint64), np.zeros(total, dtype=np.int64)
            owner = np.repeat(np.arange(len(self.sizes)), parts)
            if len(at):
                first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
                at = at[first[np.diff(np.append(first, len(at))) & 1 == 1]]  # bits that an even number of n-grams flipped are 0
            if len(at):
                slot = (at // np.uint64(PART_BITS)).astype(np.int64)
                flips = grams.mixed(at - base[owner[slot]].astype(np.uint64) * np.uint64(PART_BITS) + np.uint64(0x9E3779B97F4A7C15))
                first = np.flatnonzero(np.append(True, slot[1:] != slot[:-1]))
                value[slot[first]] = np.bitwise_xor.reduceat(flips, first)
                strength[slot[first]] = np.diff(np.append(first, len(slot)))
            part = np.arange(total) - base[owner]
            place = (of[owner] * np.int64(1 << 40) + part).astype(np.uint64)
            key = grams.mixed(value ^ grams.mixed(place))
            order = np.lexsort((key, strength, owner))
            strong = order[part >= bands.weak[of[owner]]]  # the parts of a text stay together, weakest first
            keys.append(key[strong])
            texts.append(owner[strong])
            bands_of.append(of[owner[strong]])
        return np.concatenate(keys), np.concatenate(texts), np.concatenate(bands_of)

    def check_sketch(self, text: int, words: int = CHECK_WORDS) -> np.ndarray:
        """A parity sketch of so many words, a power of two. Its halves' xor is the sketch of half the length."""
        own = self.hashes[self.bounds[text] : self.bounds[text + 1]]
        bits = np.bincount((grams.mixed(own ^ np.uint64(0xD1B54A32D192ED03)) % np.uint64(64 * words)).astype(np.int64), minlength=64 * words)
        return np.packbits((bits & 1).astype(np.uint8)).view(np.uint64)

    def long_sketch(self, text: int) -> bytes:
        """A sketch that grows with the set; empty where the short one will do."""
        words = 1 << max(0, int(self.sizes[text]) // LONG_WORDS - 1).bit_length()
        return self.check_sketch(text, words).tobytes() if words > CHECK_WORDS else b""


def _signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def _distinct_keys(sets: Sets, keys: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys of a block in order, the mark of the set that has each (or SEVERAL), and where it is SEVERAL."""
    mark = (sets.fingerprints()[0][texts] >> np.uint64(32)) | np.uint64(1)
    order = np.lexsort((mark, keys))
    keys, mark = keys[order], mark[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, dtype=np.int64)
    last = np.append(first[1:], len(keys))[: len(first)] - 1
    several = mark[first] != mark[last]
    return keys[first], np.where(several, SEVERAL, mark[first]), several


def _without_frequent(
    keys: np.ndarray, texts: np.ndarray, band: np.ndarray, known: np.ndarray, counts: np.ndarray, frequent: np.ndarray
) -> np.ndarray:
    """Where the keys are that a sketch keeps: its known ones but as many as ``frequent`` says, with the largest counts (ties: largest key)."""
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    shared = np.flatnonzero(known[at] == keys)
    order = shared[np.lexsort((keys[shared], counts[at[shared]], band[shared], texts[shared]))]
    new = np.append(True, (texts[order][1:] != texts[order][:-1]) | (band[order][1:] != band[order][:-1]))[: len(order)]
    first = np.flatnonzero(new)
    sizes = np.diff(np.append(first, len(order)))
    left = np.repeat(first + sizes, sizes) - np.arange(len(order))  # this one and those after it in its sketch
    return order[left > frequent[order]]


def documents_with_keys(blocks: DataFrame, n: int, bands: Bands, owners: int) -> DataFrame:
    """Stored rows of ``SETS`` and ``row``: keys and sketches only of documents that share a key, and where each text is."""

    @released
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, rows in zip(*batch.columns):
                sets = Sets(unpack_rows(rows.as_py()).column(1), n)
                values, marks, _ = _distinct_keys(sets, *sets.keys(bands)[:2])
                yield messages(
                    [(owner, name.as_py(), pack_sorted(values[a:b]), pack(marks[a:b])) for owner, a, b in shares(values, 64, owners)],
                    ASKED,
                )

    @released
    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, packed, lists in zip(*batch.columns):
                rows = unpack_rows(packed.as_py())
                sets = Sets(rows.column(1), n)
                keys, texts, band = sets.keys(bands)
                f1, f2 = sets.fingerprints()
                values, _, several = _distinct_keys(sets, keys, texts)
                told = [(unpack_sorted(one["hits"]), unpack(one["counts"])) for one in lists.as_py() or ()]
                known = np.concatenate([values[several], *(hits for hits, _ in told)])
                counts = np.concatenate([np.ones(int(several.sum()), dtype=np.uint64), *(counts for _, counts in told)])
                order = np.lexsort((counts, known))
                known, counts = known[order], counts[order]
                last = np.append(known[1:] != known[:-1], True)[: len(known)]  # a key of several own sets may be told as well
                shared: dict[int, list[int]] = {}
                if len(known):
                    frequent = bands.frequent(sets.sizes[texts], band)
                    for index in _without_frequent(keys, texts, band, known[last], counts[last], frequent).tolist():
                        shared.setdefault(int(texts[index]), []).append(index)
                signed = _signed(keys)
                size = rows.num_rows
                own = [signed[shared[t]].tolist() if t in shared else None for t in range(size)]
                sketches = [sets.check_sketch(t).view(np.int64) if t in shared else None for t in range(size)]
                longer = [sets.long_sketch(t) if t in shared else None for t in range(size)]
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column(0), pa.array(sets.sizes), pa.array(_signed(f1)), pa.array(_signed(f2)),
                        pa.array(own, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64())),
                        pa.array(longer, pa.binary()), pa.array([name.as_py()] * size), pa.array(np.arange(size, dtype=np.int32)),
                    ],
                    names=["doc_id", "n_shingles", "f1", "f2", "keys", "sketch", "long_sketch", "block", "place"],
                )

    with batches_of(blocks.sparkSession, BLOCK_ROWS):
        hits = store(known_with_another_mark(blocks.mapInArrow(ask, ASKED)), "jaccard-hits")
    joined = blocks.join(hits.groupBy("block").agg(F.collect_list(F.struct("hits", "counts")).alias("hits")), "block", "left").select("block", "rows", "hits")
    told = joined.mapInArrow(tell, SETS).withColumn("row", F.monotonically_increasing_id())
    with batches_of(blocks.sparkSession, BLOCK_ROWS):
        told = store(told, "jaccard-sets")
    discard(hits)
    return told


def sets_of(blocks: DataFrame, sets: DataFrame, rows: DataFrame, n: int) -> DataFrame:
    """``row, n_shingles, shingles`` of the stored ``rows``, made from their texts again; a stored table.

    The list of rows has one short row for each block, so blocks are not moved while the planner can broadcast it.
    """

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed, wanted in zip(*batch.columns):
                wanted = wanted.as_py()
                texts = unpack_rows(packed.as_py()).column(1).take(pa.array([one["place"] for one in wanted], pa.int32()))
                made = Sets(texts, n)
                values = [made.hashes[low:high].tobytes() for low, high in zip(made.bounds[:-1].tolist(), made.bounds[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([one["row"] for one in wanted], pa.int64()), pa.array(made.sizes), pa.array(values, pa.binary())],
                    names=["row", "n_shingles", "shingles"],
                )

    places = sets.select("row", "block", "place").join(rows, "row", "left_semi")
    listed = store(places.groupBy("block").agg(F.collect_list(F.struct("place", "row")).alias("wanted")), "jaccard-places")
    with batches_of(blocks.sparkSession, BLOCK_ROWS):
        made = store(blocks.join(listed, "block").select("rows", "wanted").mapInArrow(run, "row long, n_shingles long, shingles binary"), "jaccard-needed")
    discard(listed)
    return made


def _difference_bound(a, b, bands: Bands):
    """The largest symmetric difference that linked sets of these sizes have."""
    return F.floor((a + b) * F.lit(bands.den - bands.num) / F.lit(bands.den + bands.num))


def _near(bands: Bands):
    """Whether ``a`` and ``b`` can be linked, by their check sketches and sizes."""
    distance = reduce(
        lambda x, y: x + y, (F.bit_count(F.col("a.sketch")[k].bitwiseXOR(F.col("b.sketch")[k])) for k in range(CHECK_WORDS))
    )
    a, b = F.col("a.n_shingles"), F.col("b.n_shingles")
    return (F.least(a, b) * bands.den >= F.greatest(a, b) * bands.num) & (distance <= _difference_bound(a, b, bands))


def near_pairs(pairs: DataFrame, sets: DataFrame, bands: Bands) -> DataFrame:
    """The pairs ``x, y`` whose sizes and check sketches allow a link; a stored table."""
    narrow = sets.select("row", "n_shingles", "sketch")
    left = pairs.join(narrow.select(F.col("row").alias("x"), F.struct("n_shingles", "sketch").alias("a")), "x")
    both = left.join(narrow.select(F.col("row").alias("y"), F.struct("n_shingles", "sketch").alias("b")), "y")
    return store(both.where(_near(bands)).select("x", "y"), "jaccard-pairs")


def _sketches_allow(num: int, den: int):
    """Whether two sets can be linked, by their long sketches and sizes."""

    def test(a: np.ndarray, size_a: int, b: np.ndarray, size_b: int) -> bool:
        if not len(a) or not len(b):
            return True
        while len(a) > len(b):
            a = a[: len(a) // 2] ^ a[len(a) // 2 :]
        while len(b) > len(a):
            b = b[: len(b) // 2] ^ b[len(b) // 2 :]
        return int(np.bitwise_count(a ^ b).sum()) * (den + num) <= (size_a + size_b) * (den - num)

    return test


def _sets_link(num: int, den: int):
    def test(a: np.ndarray, size_a: int, b: np.ndarray, size_b: int) -> bool:
        both = len(np.intersect1d(a, b, assume_unique=True))
        return den * both >= num * (size_a + size_b - both)

    return test


def compared(pairs: DataFrame, fetch, column: str, test) -> DataFrame:
    """The stored pairs ``x, y`` whose values of ``column``, which ``fetch`` gets for stored rows, pass the test; a stored table.

    The pairs of an ``x`` are cut into slices. Its value is sent once to each slice, in front of those it is compared with.
    """

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, size_a = np.empty(0, dtype=np.uint64), 0
        for batch in batches:
            xs, ys, sizes, good = batch.column(0), batch.column(2), batch.column(3).to_pylist(), []
            for k in range(batch.num_rows):
                own = np.frombuffer(batch.column(4)[k].as_buffer(), dtype=np.uint64)
                if not ys[k].is_valid:
                    a, size_a = own.copy(), sizes[k]
                elif test(a, size_a, own, sizes[k]):
                    good.append(k)
            at = pa.array(good, pa.int64())
            yield pa.RecordBatch.from_arrays([xs.take(at), ys.take(at)], names=["x", "y"])

    rows = store(pairs.select(F.col("x").alias("row")).union(pairs.select("y")).distinct(), "jaccard-wanted")
    needed = fetch(rows)
    per_x = pairs.groupBy("x").agg(F.count(F.lit(1)).alias("rows"))
    slices = store(per_x.withColumn("slices", F.ceil(F.col("rows") / SLICE).cast("int")), "jaccard-slices")
    every = F.explode(F.sequence(F.lit(0), F.col("slices") - 1))
    first = slices.join(needed.withColumnRenamed("row", "x"), "x").select("x", every.alias("slice"), F.lit(None).cast("long").alias("y"), "n_shingles", column)
    after = join_hot(pairs, slices, ["x"], "rows").withColumn("slice", F.pmod(F.xxhash64("y"), F.col("slices")).cast("int"))
    after = after.join(needed.withColumnRenamed("row", "y"), "y").select("x", "slice", "y", "n_shingles", column)
    together = first.unionByName(after).repartition("x", "slice").sortWithinPartitions("x", "slice", F.asc_nulls_first("y"))
    with batches_of(pairs.sparkSession, COMPARED_ROWS):
        passed = store(together.mapInArrow(run, "x long, y long"), "jaccard-passed")
    discard(rows, needed, slices)
    return passed


def verified(pairs: DataFrame, sets: DataFrame, blocks: DataFrame, n: int, bands: Bands) -> DataFrame:
    """The stored pairs ``x, y`` whose sets link; a stored table. Sets are made and sent only where their long sketches allow it."""

    def sketches(rows: DataFrame) -> DataFrame:
        return store(sets.select("row", "n_shingles", "long_sketch").join(rows, "row", "left_semi"), "jaccard-needed")

    allowed = compared(pairs, sketches, "long_sketch", _sketches_allow(bands.num, bands.den))
    links = compared(allowed, lambda rows: sets_of(blocks, sets, rows, n), "shingles", _sets_link(bands.num, bands.den))
    discard(allowed)
    return links


def _one_of_equal_groups(members: DataFrame, *more) -> DataFrame:
    """Of keys (of two rows or more) that have the same rows, the smallest one: ``key`` and the aggregates ``more``."""
    prints = [F.bit_xor(F.xxhash64(F.lit(salt), "row")).alias(f"print_{salt}") for salt in (1, 2)]
    groups = members.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), *prints, *more).where("rows > 1")
    names = [name for name in groups.columns if name not in ("key", "rows", "print_1", "print_2")]
    return groups.groupBy("rows", "print_1", "print_2").agg(F.min("key").alias("key"), *(F.first(name).alias(name) for name in names))


def _starred(members: DataFrame) -> DataFrame:
    """``key, row, centre`` of the keys to compare: one of those with the same rows, with its smallest row."""
    centres = _one_of_equal_groups(members, F.min("row").alias("centre")).select("key", "centre")
    return members.join(centres, "key")


def jaccard_components(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Of every row: ``doc_id, n_shingles, class_id, component_id``.

    ``class_id`` is the smallest id with an equal set, ``component_id`` the smallest id that links reach.
    """
    spark = docs.sparkSession
    read = keep_columns(docs, doc_id="long", text="string")
    size = read.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bands = Bands(num, den)
    blocks = pack_blocks(read, "jaccard-blocks")
    told = documents_with_keys(blocks, n, bands, owners_of(spark, size))
    narrow = told.select("doc_id", "n_shingles", "f1", "f2", "row")
    classes = store(
        narrow.where("n_shingles > 0").groupBy("f1", "f2", "n_shingles").agg(F.min("row").alias("row"), F.min("doc_id").alias("class_id")),
        "jaccard-classes",
    )
    sets = told.where(F.col("keys").isNotNull())
    owned = sets.select("row", "keys").join(classes.select("row"), "row", "left_semi")
    members = store(owned.select(F.explode("keys").alias("key"), "row"), "jaccard-members")

    # First round: a star in every key.
    starred = store(_starred(members), "jaccard-starred")
    star = starred.where("row <> centre").select(F.col("centre").alias("x"), F.col("row").alias("y")).distinct()
    near = near_pairs(star, sets, bands)
    links = verified(near, sets, blocks, n, bands)
    part_of = components(links)
    discard(members, near, links)

    # Second round: across the components that a key still joins. Its centre has met the others.
    labelled = store(
        starred.where("row <> centre")
        .select("key", "row")
        .join(part_of.withColumnRenamed("node", "row"), "row", "left")
        .withColumn("component", F.coalesce("component", "row")),
        "jaccard-labelled",
    )
    mixed = store(
        _one_of_equal_groups(labelled, F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key"),
        "jaccard-mixed",
    )
    open_members = store(
        labelled.join(mixed, "key", "left_semi").join(sets.select("row", "n_shingles", "sketch"), "row"), "jaccard-open"
    )
    discard(starred, labelled, mixed)
    across = store(
        open_members.alias("a")
        .join(
            open_members.alias("b"),
            (F.col("a.key") == F.col("b.key"))
            & (F.col("a.row") < F.col("b.row"))
            & (F.col("a.component") != F.col("b.component"))
            & _near(bands),
        )
        .select(F.col("a.row").alias("x"), F.col("b.row").alias("y"))
        .distinct(),
        "jaccard-across",
    )
    more = verified(across, sets, blocks, n, bands)
    discard(open_members, across, blocks)
    label = {side: part_of.select(F.col("node").alias(side), F.col("component").alias(f"part_{side}")) for side in ("x", "y")}
    merged = components(
        more.join(label["x"], "x", "left")
        .join(label["y"], "y", "left")
        .select(F.coalesce("part_x", "x").alias("x"), F.coalesce("part_y", "y").alias("y"))
    )
    node = classes.join(part_of.withColumnRenamed("node", "row"), "row", "left").withColumn("part", F.coalesce("component", "row")).drop("component")
    node = (
        node.join(merged.withColumnRenamed("node", "part"), "part", "left")
        .withColumn("part", F.coalesce("component", "part"))
        .select("f1", "f2", "n_shingles", "class_id", "part")
    )
    node = store(node, "jaccard-parts")
    discard(classes, part_of, merged, more)
    smallest = node.groupBy("part").agg(F.min("class_id").alias("component_id"))
    named = store(node.join(smallest, "part").drop("part"), "jaccard-named")
    discard(node)
    return narrow.join(named, ["f1", "f2", "n_shingles"], "left").select(
        "doc_id",
        "n_shingles",
        F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
    )


def without_near_copies(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of every component the one with the smallest id.

    Rows that share an id stay if one of them does. The dropped ids are the smaller side of the join.
    """
    joined = jaccard_components(docs, n, num, den).select("doc_id", "component_id")
    stays = F.col("doc_id").eqNullSafe(F.col("component_id"))
    dropped = store(joined.groupBy("doc_id").agg(F.max(stays.cast("int")).alias("stays")).where("stays = 0").select("doc_id"), "jaccard-dropped")
    rows = boxed(docs, id=F.col("doc_id").cast("long"))
    return unboxed(rows.join(dropped, F.col("id").eqNullSafe(F.col("doc_id")), "left_anti"))
