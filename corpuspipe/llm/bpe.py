"""Byte-level BPE encoding and decoding as a tree reduction.

Encoding is a monoid: halves are encoded on their own and joined by encoding a window around their border
again. The window grows until what lies outside it provably stays as it is, so the result is that of encoding
the whole. Both levels of byte-level BPE work this way:

* a text. Between a character that is no white space and white space after it there is always a border of
  pretokens, and neither side depends on the other (no alternative of the pattern crosses it, and the only
  look-ahead stands inside white space). A part of a text is its open head, the settled ids, and its open tail;
  joining two parts encodes tail and head, and a part without a border stays open and grows.
* a pretoken. A token sequence is the encoding of its bytes exactly if each two neighbours are the encoding of
  their own bytes. A window is final once its first and last token fit the tokens outside it.

Leaves are small, so no step is quadratic in a text. The short words that a group of texts holds are leaves of their
own, encoded together before the texts: each round merges the lowest pair of every word. Decoding concatenates the bytes of tokens up a tree.

Defined results: a null text is empty and has no tokens; an unknown id fails the decoding. Texts have any
length; a text is one row and is encoded by one task. Repeated rows give repeated rows.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from corpuspipe.llm.grams import groups
from corpuspipe.sources.pieces import released

# Characters of a text, bytes of a pretoken and ids of a list that are worked on without halving.
LEAF_CHARS = 32_768
LEAF_BYTES = 3
LEAF_IDS = 1 << 20

# Pretokens of at most so many bytes are merged together with others, a merge of each in a round.
ROUND_BYTES = 24

# Fewer new words than this are encoded where they stand.
LEAST_WORDS = 64

# Windows of more bytes are merged with a heap.
HEAP_BYTES = 128

# Known words, stretches of bytes and windows are forgotten beyond so many, and not kept beyond this length.
CACHED = 200_000
CACHED_LENGTH = 40

# Bytes of text whose numbers and ids are held at a time.
CODED_BYTES = 1 << 20

NO_MERGE = 1 << 62


@dataclass
class Part:
    """A stretch of text: ``head`` up to its first border, what is settled (numbers of
    encoded words), ``tail`` after its last
    border. Without a border everything is ``head`` and ``settled``
    is None."""

    head: str
    settled: list[list[int]] | None = None
    tail: str = ""


class Codec:
    """Encoder and decoder of one vocabulary of ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        # The libraries differ in what a bare \s is; the Unicode property is what the ranks were made with.
        self.pattern = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.blanks = frozenset(regex.findall(r"\p{White_Space}", "".join(map(chr, range(0x3001)))))
        self.first_border = regex.compile(r"(?<=\P{White_Space})(?=\p{White_Space})")
        self.last_border = regex.compile(r"(?r)(?<=\P{White_Space})(?=\p{White_Space})")
        # Encoded words of the texts at hand: number of a word, and tokens and sizes by number.
        self.numbers: dict[str, int] = {}
        self.tokens = array("i")
        self.sizes = array("i")
        self.stretches: dict[bytes, list[int]] = {}
        self.windows: dict[tuple[int, int], list[int]] = {}
        size = max(self.bytes_of) + 1
        self.byte_ranks = np.array([ranks.get(bytes([value]), -1) for value in range(256)], dtype=np.int64)
        self.byte_sizes = np.zeros(size, dtype=np.int64)
        for rank, token in self.bytes_of.items():
            self.byte_sizes[rank] = len(token)
        self.byte_starts = np.cumsum(self.byte_sizes) - self.byte_sizes
        self.all_bytes = np.frombuffer(b"".join(self.bytes_of.get(rank, b"") for rank in range(size)), dtype=np.uint8)

    # Tokens of one pretoken.

    def merged(self, data: bytes) -> list[int]:
        """Merge the lowest rank first, the leftmost of equals."""
        if len(data) > HEAP_BYTES:
            return self.merged_by_heap(data)
        ranks, parts = self.ranks, [data[at : at + 1] for at in range(len(data))]
        costs = [ranks.get(a + b, NO_MERGE) for a, b in pairwise(parts)]
        while costs and (least := min(costs)) != NO_MERGE:
            at = costs.index(least)
            parts[at] += parts.pop(at + 1)
            del costs[at]
            if at:
                costs[at - 1] = ranks.get(parts[at - 1] + parts[at], NO_MERGE)
            if at < len(costs):
                costs[at] = ranks.get(parts[at] + parts[at + 1], NO_MERGE)
        return [ranks[part] for part in parts]

    def merged_by_heap(self, data: bytes) -> list[int]:
        """The same, near-linear in long inputs."""
        ranks, n = self.ranks, len(data)
        following, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ends, alive = list(range(1, n + 1)), [True] * n

        def rank(at: int) -> int | None:
            other = following[at]
            return ranks.get(data[at : ends[other]]) if other < n else None

        heap = [(r, at, ends[at + 1]) for at in range(n - 1) if (r := rank(at)) is not None]
        heapq.heapify(heap)
        while heap:
            _, at, end = heapq.heappop(heap)
            other = following[at]
            if not alive[at] or other >= n or ends[other] != end:
                continue
            alive[other] = False
            ends[at] = end
            following[at] = following[other]
            if following[at] < n:
                before[following[at]] = at
            for changed in (at, before[at]):
                if changed >= 0 and (r := rank(changed)) is not None:
                    heapq.heappush(heap, (r, changed, ends[following[changed]]))
        out, at = [], 0
        while at < n:
            out.append(ranks[data[at : ends[at]]])
            at = following[at]
        return out

    def window(self, left: int, right: int) -> list[int]:
        """The encoding of the bytes of two tokens side by side."""
        found = self.windows.get((left, right))
        if found is None:
            if len(self.windows) >= CACHED:
                self.windows.clear()
            found = self.windows[left, right] = self.merged(self.bytes_of[left] + self.bytes_of[right])
        return found

    def fits(self, left: int, right: int) -> bool:
        return self.window(left, right) == [left, right]

    def joined(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two neighbours from their encodings."""
        if not left or not right:
            return left or right
        i = j = 1
        window = self.window(left[-1], right[0])
        if window == [left[-1], right[0]]:
            return left + right
        while True:
            left_done = i >= len(left) or self.fits(left[-i - 1], window[0])
            right_done = j >= len(right) or self.fits(window[-1], right[j])
            if left_done and right_done:
                return left[:-i] + window + right[j:]
            i = i if left_done else min(len(left), 2 * i)
            j = j if right_done else min(len(right), 2 * j)
            window = self.merged(b"".join(map(self.bytes_of.__getitem__, chain(left[-i:], right[:j]))))

    def encoded_bytes(self, data: bytes) -> list[int]:
        """The encoding of bytes, from that of their halves."""
        ids = self.stretches.get(data)
        if ids is None:
            if len(data) <= LEAF_BYTES:
                ids = self.merged(data)
            else:
                half = len(data) // 2
                ids = self.joined(self.encoded_bytes(data[:half]), self.encoded_bytes(data[half:]))
            if len(data) <= CACHED_LENGTH:
                if len(self.stretches) >= CACHED:
                    self.stretches.clear()
                self.stretches[data] = ids
        return ids

    @cached_property
    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        return _pairs(self.ranks)

    def pair_costs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of tokens side by side as one token; NO_MERGE where they are none."""
        keys = left << 32 | right
        pair_keys, pair_ranks = self.pairs
        at = np.minimum(np.searchsorted(pair_keys, keys), len(pair_keys) - 1)
        return np.where(pair_keys[at] == keys, pair_ranks[at], NO_MERGE)

    def merged_together(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all pieces one after another and how many each has; every round does for each piece what ``merged`` does."""
        sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        ids = self.byte_ranks[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        if len(ids) and ids.min() < 0:
            raise KeyError("A byte is not in the vocabulary.")
        owner = np.repeat(np.arange(len(pieces)), sizes)
        costs = np.full(len(ids), NO_MERGE, dtype=np.int64)
        inside = np.flatnonzero(owner[:-1] == owner[1:])
        costs[inside] = self.pair_costs(ids[inside], ids[inside + 1])
        done_ids, done_owners = [], []
        while len(ids):
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            counts = np.diff(np.append(first, len(ids)))
            least = np.minimum.reduceat(costs, first)
            active = np.repeat(least != NO_MERGE, counts)
            if not active.all():
                done_ids.append(ids[~active])
                done_owners.append(owner[~active])
                least, counts = least[least != NO_MERGE], counts[least != NO_MERGE]
                ids, owner, costs = ids[active], owner[active], costs[active]
                if not len(ids):
                    break
            at = np.flatnonzero(costs == np.repeat(least, counts))
            at = at[np.append(True, owner[at[1:]] != owner[at[:-1]])]  # the leftmost of each piece
            ids[at] = costs[at]
            costs[at] = NO_MERGE
            kept = np.ones(len(ids), dtype=bool)
            kept[at + 1] = False
            at -= np.arange(len(at))
            ids, owner, costs = ids[kept], owner[kept], costs[kept]
            right = at[at + 1 < len(ids)]
            right = right[owner[right] == owner[right + 1]]
            costs[right] = self.pair_costs(ids[right], ids[right + 1])
            left = at[at > 0] - 1
            left = left[owner[left] == owner[left + 1]]
            costs[left] = self.pair_costs(ids[left], ids[left + 1])
        if not done_ids:
            return ids, sizes
        ids, owner = np.concatenate(done_ids), np.concatenate(done_owners)
        order = np.argsort(owner, kind="stable")
        return ids[order], np.bincount(owner, minlength=len(pieces))

    def encoded_piece(self, piece: str) -> list[int]:
        data = piece.encode()
        whole = self.ranks.get(data)
        return [whole] if whole is not None else self.encoded_bytes(data)

    # Ids of one text.

    def encoded_stretch(self, stretch: str) -> int:
        """The number of a stretch of text that ends at borders, whose tokens are added."""
        before = len(self.tokens)
        for piece in self.pattern.findall(stretch):
            self.tokens.extend(self.encoded_piece(piece))
        self.sizes.append(len(self.tokens) - before)
        return len(self.sizes) - 1

    def encoded_word(self, word: str) -> int:
        """The number of a space and a word."""
        number = self.encoded_stretch(" " + word)
        if len(word) <= CACHED_LENGTH:
            self.numbers[word] = number
        return number

    def learn_words(self, texts: list[str]) -> None:
        """Give the new short words of some texts their numbers; a space and a word is a stretch between borders."""
        known, blanks, found = self.numbers, self.blanks, set()
        for text in texts:
            if len(text) <= CODED_BYTES:
                found.update(text.split(" ")[1:])
        found.discard("")
        new = [word for word in found if word not in known and len(word) <= CACHED_LENGTH and word[-1] not in blanks]
        if len(new) < LEAST_WORDS:
            return
        pieces = self.pattern.findall(" " + " ".join(new))
        # The word of each piece, by the places where they start.
        ends = np.cumsum(np.fromiter(map(len, new), dtype=np.int64, count=len(new)) + 1)
        lengths = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        owner = np.searchsorted(ends, np.cumsum(lengths) - lengths, side="right")
        different = {piece: number for number, piece in enumerate(dict.fromkeys(pieces))}
        which = np.fromiter(map(different.__getitem__, pieces), dtype=np.int64, count=len(pieces))
        coded = list(map(str.encode, different))
        whole = np.fromiter((self.ranks.get(data, -1) for data in coded), dtype=np.int64, count=len(coded))
        long = [at for at in np.flatnonzero(whole < 0).tolist() if len(coded[at]) > ROUND_BYTES]
        apart = np.zeros(len(coded), dtype=bool)
        apart[long] = True
        short = np.flatnonzero((whole < 0) & ~apart)
        alone = np.flatnonzero(whole >= 0)
        merged, counts = self.merged_together([coded[at] for at in short.tolist()])
        lists = [self.encoded_bytes(coded[at]) for at in long]
        # Tokens of the different pieces: those of one token, those merged together, the long ones.
        order = np.concatenate([alone, short, np.array(long, dtype=np.int64)])
        flat = np.concatenate([whole[alone], merged, np.array(list(chain.from_iterable(lists)), dtype=np.int64)]).astype(np.int32)
        sizes, starts = np.zeros(len(coded), dtype=np.int64), np.zeros(len(coded), dtype=np.int64)
        sizes[order] = np.concatenate([np.ones(len(alone), dtype=np.int64), counts, np.array(list(map(len, lists)), dtype=np.int64)])
        starts[order] = np.cumsum(sizes[order]) - sizes[order]
        first = len(self.sizes)
        self.tokens.frombytes(gathered(flat, starts[which], sizes[which]).tobytes())
        self.sizes.frombytes(np.bincount(owner, weights=sizes[which], minlength=len(new)).astype(np.int32).tobytes())
        known.update(zip(new, range(first, first + len(new))))

    def encoded_leaf(self, text: str) -> list[int]:
        """A text cut at single spaces; those after white space are no borders and stay inside their stretch."""
        first, *words = text.split(" ")
        found = list(map(self.numbers.get, words))
        missing = [at for at, number in enumerate(found) if number is None]
        if self._closed(first) and all(self._closed(words[at]) for at in missing):
            for at in missing:
                word = words[at]
                number = self.numbers.get(word)
                found[at] = self.encoded_word(word) if number is None else number
            return [self.encoded_stretch(first), *found]
        found, stretch, closed = [], [first], self._closed(first)
        for word in words:
            if closed:
                found.append(self._number(stretch))
                stretch = ["", word]
            else:
                stretch.append(word)
            closed = self._closed(word)
        found.append(self._number(stretch))
        return found

    def _closed(self, word: str) -> bool:
        return word != "" and word[-1] not in self.blanks

    def _number(self, words: list[str]) -> int:
        if len(words) == 2 and words[0] == "" and self._closed(words[1]):
            number = self.numbers.get(words[1])
            return self.encoded_word(words[1]) if number is None else number
        return self.encoded_stretch(" ".join(words))

    def part(self, text: str) -> Part:
        """A part of a text, from its halves where it is long."""
        if len(text) > LEAF_CHARS:
            half = len(text) // 2
            return self.joined_parts(self.part(text[:half]), self.part(text[half:]))
        start = self.first_border.search(text)
        if start is None:
            return Part(text)
        end = self.last_border.search(text)
        return Part(text[: start.start()], [self.encoded_leaf(text[start.start() : end.start()])], text[end.start() :])

    def joined_parts(self, left: Part, right: Part) -> Part:
        """The part that two neighbours make together."""
        if left.settled is None and right.settled is None:
            at = len(left.head)
            text = left.head + right.head
            if 0 < at < len(text) and self.first_border.match(text, at):
                return Part(left.head, [], right.head)
            return Part(text)
        if left.settled is None:
            joined = self.joined_parts(left, Part(right.head))
            if joined.settled is None:
                return Part(joined.head, right.settled, right.tail)
            return Part(joined.head, [self.encoded_leaf(joined.tail), *right.settled], right.tail)
        if right.settled is None:
            joined = self.joined_parts(Part(left.tail), right)
            if joined.settled is None:
                return Part(left.head, left.settled, joined.head)
            return Part(left.head, [*left.settled, self.encoded_leaf(joined.head)], joined.tail)
        window = self.encoded_leaf(left.tail + right.head)
        return Part(left.head, [*left.settled, window, *right.settled], right.tail)

    def numbered(self, text: str) -> list[int]:
        """Numbers of the encoded stretches that make up the text."""
        if len(text) <= LEAF_CHARS:
            return self.encoded_leaf(text)
        whole = self.part(text)
        return list(chain(self.encoded_leaf(whole.head), *(whole.settled or []), self.encoded_leaf(whole.tail)))

    def encode_all(self, texts: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where those of each begin and end."""
        if len(self.numbers) > CACHED or len(self.tokens) > 16 * CACHED:
            self.numbers.clear()
            self.tokens, self.sizes = array("i"), array("i")
        texts = list(texts)
        self.learn_words(texts)
        lists = [np.array(self.numbered(text), dtype=np.int64) for text in texts]
        sizes = np.array(self.sizes, dtype=np.int64)
        tokens = np.array(self.tokens, dtype=np.int32)
        starts = np.cumsum(sizes) - sizes
        offsets = np.zeros(len(lists) + 1, dtype=np.int64)
        np.cumsum([int(sizes[numbers].sum()) for numbers in lists], out=offsets[1:])
        ids = [gathered(tokens, starts[numbers], sizes[numbers]) for numbers in lists]
        return (np.concatenate(ids) if ids else np.empty(0, dtype=np.int32)), offsets

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of ids, concatenated up a tree of halves."""
        if len(ids) > LEAF_IDS:
            half = len(ids) // 2
            return self.decode(ids[:half]) + self.decode(ids[half:])
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.byte_sizes) or not self.byte_sizes[ids].all()):
            raise ValueError("An id is not in the vocabulary.")
        return gathered(self.all_bytes, self.byte_starts[ids], self.byte_sizes[ids]).tobytes()


def gathered(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of ``values`` with these starts and sizes, one after another."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(starts - (ends - sizes), sizes) + np.arange(total)]


def _pairs(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of tokens that are a token together, as ascending numbers, and its rank."""
    keys, values = [], []
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left = ranks.get(token[:cut])
            if left is not None and (right := ranks.get(token[cut:])) is not None:
                keys.append(left << 32 | right)
                values.append(rank)
    keys, values = np.array([-1, *keys], dtype=np.int64), np.array([NO_MERGE, *values], dtype=np.int64)
    order = np.argsort(keys)
    return keys[order], values[order]


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file: a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, map(bytes.strip, lines)))}


@lru_cache(maxsize=2)
def _codec(path: str, pattern: str) -> Codec:
    return Codec(read_ranks(path), pattern)


def _vocabulary(path: str) -> str:
    """A vocabulary's path as it is, or its place in the installed package of public tokenizers."""
    if "/" in path:
        return path
    import public_tokenizers

    return public_tokenizers.path(path)


def _coded(docs: DataFrame, vocabulary: str, pattern: str, keep: tuple[str, ...], with_bytes: bool) -> DataFrame:
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(_vocabulary(vocabulary), pattern)
        for batch in batches:
            for group in groups(batch, len(keep), CODED_BYTES):
                flat, offsets = codec.encode_all(text.as_py() or "" for text in group.column(len(keep)))
                columns = [*group.columns[:-1], pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat, type=pa.int32()))]
                if with_bytes:
                    columns.append(pa.array([codec.decode(flat[low:high]) for low, high in pairwise(offsets.tolist())], type=pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, "ids", "decoded"][: len(columns)])

    read = docs.select(*(F.col(f"`{name}`") for name in keep), F.col("text").cast("string").alias("text"))
    more = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType())]
    return read.mapInArrow(run, T.StructType([*(read.schema[name] for name in keep), *more[: 1 + with_bytes]]))


def encode(docs: DataFrame, vocabulary: str, pattern: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and ``ids`` of every row's ``text``. ``vocabulary``: a path that every executor has,
    or the name of a file of the installed tokenizers."""
    return _coded(docs, vocabulary, pattern, keep, False)


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """All columns and ``decoded`` (bytes) of every row's ``ids``; null ids give no bytes."""
    at = encoded.columns.index("ids")

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(_vocabulary(vocabulary), r"\s+")
        for batch in batches:
            values = (
                value.values.to_numpy(zero_copy_only=False) if value.is_valid else np.empty(0, dtype=np.int32)
                for value in batch.column(at)
            )
            decoded = pa.array([codec.decode(ids) for ids in values], type=pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, decoded], names=[*batch.schema.names, "decoded"])

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField("decoded", T.BinaryType())]))


def round_trip(docs: DataFrame, vocabulary: str, pattern: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, ``ids`` and ``decoded``, which is decoded from the ids, of every row; in one worker a task."""
    return _coded(docs, vocabulary, pattern, keep, True)
