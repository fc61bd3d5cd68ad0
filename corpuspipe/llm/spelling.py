"""Spelling variants: words that differ by one letter, found by a bit-sliced position index.

The index of a block of words holds, for each place and letter, the bitset of the words with that letter there. All
words of the block are looked up at once: while a word is read letter by letter, four bitsets say which words of the
block agree with what was read so far: without an error, and with one letter replaced, one more, or one less. The last
two look at the place before or behind. A step is a few AND and OR of whole machine words.

Blocks are cut so that near words meet. Take the shorter word's length ``t`` as a pair's class. One error leaves either
the first ``t // 2`` letters alone or as many of the last, so words meet by those letters; what a group shares is cut off
and the rest, the open letters, is indexed. A group with more than BLOCK_WORDS words is split again in the same way: half
of the open letters agree at the front or at the back. That goes on until one letter is open, when a group is no larger
than the alphabet allows, so no group grows with the vocabulary and none is taken in the square. A pair is reported by
one group only: a group of the back leaves out the pairs that agree at the front.

Groups report, for each of their words, how many near words it has there and the best of them; pairs never leave the task.

Defined results: null texts have no words. A null ``doc_id`` is written as nothing before the colon. Repeated rows count
again. Other columns are ignored. An empty table has no words.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpuspipe.llm.common import discard, join_hot, keep_columns, store

#: Letters of a word, the divisor that marks a run for an error, the least length and count of a word.
RUN = re.compile("[A-Za-zÀ-ÿ]+")
DIVISOR = 97
LEAST_LETTERS = 5
LEAST_COUNT = 3

_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_BETWEEN = re.compile("[^A-Za-zÀ-ÿ]")

# Code points of a text that are searched at a time, and words counted before they are passed on.
PIECE = 1 << 20
COUNTED = 1 << 18

# A group with more words, or more open letters in all, is split.
BLOCK_WORDS = 2_048
BLOCK_LETTERS = 1 << 18

# Words of small groups that are indexed together.
PACKED_WORDS = 512

# Bytes of one bitset per word looked up that a step holds at a time.
STEP_BYTES = 4 << 20

_KEYED = "word string, n long, t int, front int, back int, differ int"


def pieces(text: str) -> Iterator[str]:
    """Parts of a text that end between words."""
    at = 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):
            found = _BETWEEN.search(text, end)
            end = found.start() if found else len(text)
        yield text[at:end]
        at = end


def with_errors(doc_id: int | None, runs: Counter) -> Counter:
    """Counts of a document's words: a run whose checksum DIVISOR divides loses a letter."""
    start = zlib.crc32(b":" if doc_id is None else b"%d:" % doc_id)
    out: Counter = Counter()
    for run, count in runs.items():
        if len(run) >= LEAST_LETTERS:
            mark = zlib.crc32(run.encode(), start)
            if mark % DIVISOR == 0:
                place = mark % len(run)
                run = run[:place] + run[place + 1 :]
            out[run] += count
    return out


def vocabulary(docs: DataFrame) -> DataFrame:
    """``word, n`` of all words that are long and frequent enough; a stored table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Counter = Counter()

        def counted() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [pa.array(list(known), pa.string()), pa.array(list(known.values()), pa.int64())], names=["word", "n"]
            )
            known.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                data = text.as_buffer()
                if data is None or not data.size:
                    continue
                runs: Counter = Counter()
                for piece in pieces(data.to_pybytes().translate(_FOLD).decode()):
                    runs.update(RUN.findall(piece))
                known.update(with_errors(doc_id.as_py(), runs))
                if len(known) >= COUNTED:
                    yield counted()
        yield counted()

    words = keep_columns(docs, doc_id="long", text="string").mapInArrow(run, "word string, n long")
    long_enough = words.where(F.length("word") >= LEAST_LETTERS)
    return store(long_enough.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT), "spelling-words")


def _front_and_back(rows: DataFrame) -> DataFrame:
    """Every row twice: with half of its open letters agreeing at the front, and at the back.

    ``front`` and ``back`` count the letters that a group's words share there. Words of a group of the back must
    ``differ`` among their first so many letters (0: no condition).
    """
    half = F.floor((F.col("t") - F.col("front") - F.col("back")) / 2).cast("int")
    halved = rows.withColumn("half", half)
    reach = F.col("front") + F.col("half")
    # A group of the front whose words already agree where they must differ has no pairs.
    at_front = halved.where((F.col("differ") == 0) | (reach < F.col("differ"))).select("word", "n", "t", reach.alias("front"), "back", "differ")
    at_back = halved.select(
        "word", "n", "t", "front", (F.col("back") + F.col("half")).alias("back"),
        F.when((F.col("differ") == 0) | (reach < F.col("differ")), reach).otherwise(F.col("differ")).cast("int").alias("differ"),
    )
    return at_front.unionByName(at_back)


def _keyed(rows: DataFrame) -> DataFrame:
    """``key``: what the words of a group share; a clash of keys is told apart where the group is read."""
    front = F.expr("left(word, front)")
    back = F.expr("right(word, back)")
    return rows.withColumn("key", F.xxhash64("t", "front", "back", "differ", front, back))


def groups(words: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Rows of all groups of two words or more that are small enough to be a block; and the stored steps they are read from."""
    own = words.select("word", "n", F.length("word").cast("int").alias("t"))
    # A word can be a pair's shorter (or equally long) word, and its longer one.
    both = own.unionByName(own.withColumn("t", F.col("t") - 1))
    start = both.withColumns({"front": F.lit(0), "back": F.lit(0), "differ": F.lit(0)})
    steps, done = [], []
    rows = _keyed(_front_and_back(start))
    while True:
        rows = store(rows, "spelling-rows")
        open_letters = F.length("word") - F.col("front") - F.col("back")
        sizes = store(
            rows.groupBy("key").agg(
                F.count(F.lit(1)).alias("rows"),
                F.sum(open_letters).alias("letters"),
                F.max(F.col("t") - F.col("front") - F.col("back")).alias("open"),
            ),
            "spelling-sizes",
        )
        steps += [rows, sizes]
        large = ((F.col("rows") > BLOCK_WORDS) | (F.col("letters") > BLOCK_LETTERS)) & (F.col("rows") > 1) & (F.col("open") > 1)
        kept = sizes.where((F.col("rows") > 1) & ~large).select("key")
        done.append(rows.join(kept, "key", "left_semi"))
        split = sizes.where(large).select("key", "rows")
        if not split.limit(1).count():
            break
        rows = _keyed(_front_and_back(join_hot(rows, split, ["key"], "rows").drop("key")))
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    return found, steps


class Index:
    """Bitsets of words by place and letter. ``letters`` holds the words' codes, a row each, 0 behind their ends."""

    def __init__(self, letters: np.ndarray, lengths: np.ndarray):
        count, width = letters.shape
        self.words = -(-count // 64)
        codes, self.code_of = np.unique(letters), np.zeros(256, dtype=np.int64)
        self.code_of[codes] = np.arange(len(codes))
        # One place more than the longest word has, where no word has a letter.
        self.at = np.zeros((width + 1, len(codes), self.words), dtype=np.uint64)
        for place in range(width):
            self.at[place] = self._bits(letters[:, place] == codes[:, None])
        self.at[:, codes == 0] = 0
        self.lengths = lengths

    def _bits(self, rows: np.ndarray) -> np.ndarray:
        """Rows of booleans, one for each word, as bitsets."""
        padded = np.zeros((len(rows), self.words * 64), dtype=bool)
        padded[:, : rows.shape[1]] = rows
        return np.packbits(padded, axis=1, bitorder="little").view(np.uint64)

    def of_length(self, length: int) -> np.ndarray:
        return self._bits((self.lengths == length)[None, :])[0]

    def of_group(self, group: np.ndarray, asked: np.ndarray) -> np.ndarray:
        """For each of the ``asked`` groups the words in it."""
        distinct, place = np.unique(asked, return_inverse=True)
        return self._bits(group == distinct[:, None])[place]

    def near(self, letters: np.ndarray, shorter: int, longer: bool, among: np.ndarray, differ: np.ndarray) -> np.ndarray:
        """For each row of ``letters`` the bitset of the words of ``among`` that one error away.

        The rows have ``shorter`` letters, or one more (``longer``); near words of longer ones are the shorter ones.
        Words that agree in the first ``differ`` letters are left out.
        """
        size = shorter + longer
        none = among
        replaced, one_more, one_less = (np.zeros_like(among) for _ in range(3))
        alike = np.zeros_like(among)
        for step in range(size):
            code = self.code_of[letters[:, step]]
            here, behind = self.at[step][code], self.at[step + 1][code]
            replaced = (replaced & here) | (none & ~here)
            one_more = (one_more | none) & behind
            # Less a letter: the letter read now is the missing one, or stands one place before.
            one_less = none | (one_less & self.at[step - 1][code]) if step else none
            none = none & here
            alike[differ == step + 1] = none[differ == step + 1]
        if longer:
            return one_less & self.of_length(shorter) & ~alike
        return ((replaced & self.of_length(shorter)) | ((one_more | none) & self.of_length(shorter + 1))) & ~alike


def near_in_block(letters, lengths, group, differ, shorter) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (asked word, near word) of a block whose words have ``shorter`` open letters or one more."""
    index = Index(letters, lengths)
    asked, found = [], []
    at_once = max(1, STEP_BYTES // (8 * index.words))
    for longer in (False, True):
        rows = np.flatnonzero(lengths == shorter + longer)
        for low in range(0, len(rows), at_once):
            part = rows[low : low + at_once]
            hits = index.near(letters[part], shorter, longer, index.of_group(group, group[part]), differ[part])
            q, w = np.nonzero(np.unpackbits(hits.view(np.uint8), axis=1, bitorder="little", count=len(letters)))
            asked.append(part[q])
            found.append(w)
    return np.concatenate(asked), np.concatenate(found)


def _blocks(rows: list[tuple]) -> Iterator[list[tuple]]:
    """Consecutive groups with equally many open letters, packed to about PACKED_WORDS words."""
    block: list[tuple] = []
    for low, high in _runs(rows, lambda row: row[0]):
        same = rows[low:high]
        if block and (block[0][1] != same[0][1] or len(block) + len(same) > PACKED_WORDS):
            yield block
            block = []
        block.extend(same)
    if block:
        yield block


def _runs(rows: list, key) -> Iterator[tuple[int, int]]:
    low = 0
    for at in range(1, len(rows) + 1):
        if at == len(rows) or key(rows[at]) != key(rows[low]):
            yield low, at
            low = at


def _best_of(block: list[tuple]) -> Iterator[tuple]:
    """``word, n_near, form_n, form`` of the words of a block that have near words in it."""
    shorter = block[0][1]
    opened = [row[2] for row in block]
    lengths = np.array([len(part) for part in opened])
    letters = np.zeros((len(block), shorter + 1), dtype=np.uint8)
    filled = np.arange(shorter + 1) < lengths[:, None]
    letters[filled] = np.frombuffer(b"".join(opened), dtype=np.uint8)
    names, group = {}, np.empty(len(block), dtype=np.int64)
    for k, row in enumerate(block):
        group[k] = names.setdefault(row[0], len(names))
    differ = np.array([row[3] for row in block])
    asked, found = near_in_block(letters, lengths, group, differ, shorter)
    if not len(asked):
        return
    words = [row[4] for row in block]
    counts = np.array([row[5] for row in block], dtype=np.int64)
    rank = np.empty(len(words), dtype=np.int64)
    rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    order = np.lexsort((rank[found], -counts[found], asked))
    asked, found = asked[order], found[order]
    first = np.flatnonzero(np.append(True, asked[1:] != asked[:-1]))
    sizes = np.diff(np.append(first, len(asked)))
    for word, best, size in zip(asked[first].tolist(), found[first].tolist(), sizes.tolist()):
        yield words[word], size, int(counts[best]), words[best]


def near_words(words: DataFrame) -> DataFrame:
    """``word, n_near, form_n, form`` (the near word of largest ``n``) of the words that have near words; a stored table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for key, word, n, t, front, back, differ in zip(*(column.to_pylist() for column in batch.columns)):
                end = len(word) - back
                shared = (key, t, front, word[:front], word[end:], differ)
                held.append((shared, t - front - back, word[front:end].encode("latin-1"), differ and differ - front, word, n))
            # The last group may go on in the next batch.
            cut = len(held)
            while cut and held[cut - 1][0][0] == held[-1][0][0]:
                cut -= 1
            if cut >= 4 * PACKED_WORDS:
                yield reported(held[:cut])
                del held[:cut]
        yield reported(held)

    def reported(rows: list[tuple]) -> pa.RecordBatch:
        rows = sorted(rows, key=lambda row: (row[1], row[0]))
        out = list(zip(*(found for block in _blocks(rows) for found in _best_of(block)))) or [()] * 4
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["word", "n_near", "form_n", "form"])

    rows, steps = groups(words)
    sorted_rows = rows.select("key", "word", "n", "t", "front", "back", "differ").repartition("key").sortWithinPartitions("key")
    found = sorted_rows.mapInArrow(run, "word string, n_near long, form_n long, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("less"), F.col("form")))
    out = store(
        found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select(
            "word", "n_near", (-F.col("best.less")).alias("form_n"), F.col("best.form").alias("form")
        ),
        "spelling-near",
    )
    discard(*steps)
    return out


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of every row of ``word, form``: the end of the chain of forms; a stored table.

    Every round doubles the way that is known. Chains are short, since a form is twice as frequent.
    """
    known = store(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ways = known.select(F.col("word").alias("root"), F.col("root").alias("further"))
        asked = known.groupBy("root").agg(F.count(F.lit(1)).alias("rows"))
        lookup = store(asked.join(ways, "root", "left"), "spelling-ways")
        moved = store(
            join_hot(known, lookup, ["root"], "rows").select(
                "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")
            ),
            "spelling-roots",
        )
        changed = moved.where("moved").limit(1).count()
        discard(known, lookup)
        known = moved.drop("moved")
        known._stored_path = moved._stored_path
        if not changed:
            return known


def spelling_variants(docs: DataFrame) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of all words of the documents."""
    words = vocabulary(docs)
    near = near_words(words)
    placed = store(
        words.join(near, "word", "left").withColumn("fits", F.coalesce(F.col("form_n") >= 2 * F.col("n"), F.lit(False))).select(
            "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(F.col("fits"), F.col("form")).alias("form"), F.when(F.col("fits"), F.col("form_n")).alias("form_n"),
        ),
        "spelling-placed",
    )
    ends = roots(placed.where(F.col("form").isNotNull()))
    return placed.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
