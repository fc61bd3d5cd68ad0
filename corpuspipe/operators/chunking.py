"""Cutting texts into exact character chunks.

A chunk ends after the last paragraph break inside the look-back window before ``chunk_size``; if
there is none, after the last line break, then ``.``, ``!``, ``?`` and space; else exactly at
``chunk_size``. That rule is one regular expression: the greedy quantifier finds the *last*
delimiter and the order of the alternatives is the priority. ``regexp_extract_all`` then cuts a whole
text in one linear pass inside the JVM, with no Python and no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

# Split delimiters in priority order, and the default settings.
DELIMITERS = ("\n\n", "\n", ".", "!", "?", " ")
_REGEX = {"\n\n": r"\n\n", "\n": r"\n", ".": r"\.", "!": "!", "?": r"\?", " ": " "}
DEFAULT_CHUNK_SIZE = 4000
DEFAULT_MAX_LOOKBACK = 1000
DEFAULT_OVERLAP = 400
SPLITTER_VERSION = "1"

# Java's matcher recurses once per change between one- and two-unit characters while it looks for a
# delimiter, so texts that mix them are measured on a one-unit copy when the window is wide.
_DEEP_WINDOW = 2000
_TWO_UNIT = r"[\x{10000}-\x{10ffff}]"
_ONE_UNIT = "\ue000"

CHUNK_FIELDS = (
    "chunk_number",
    "chunk_text",
    "overlap_text",
    "character_start_offset",
    "character_end_offset",
)


@dataclass(frozen=True)
class Settings:
    chunk_size: int = DEFAULT_CHUNK_SIZE
    max_lookback_size: int = DEFAULT_MAX_LOOKBACK
    overlap_size: int = DEFAULT_OVERLAP
    splitter_version: str = SPLITTER_VERSION

    @property
    def head(self) -> int:
        """Characters before the look-back window."""
        return max(0, self.chunk_size - self.max_lookback_size)

    @property
    def window(self) -> int:
        return self.chunk_size - self.head

    @property
    def pattern(self) -> str:
        """Regular expression whose successive matches are the chunks of a text."""
        tail = "".join(
            ".{0,%d}%s|" % (self.window - len(mark), _REGEX[mark])
            for mark in DELIMITERS
            if self.window >= len(mark)
        )
        return r"(?s).{1,%d}+\z|.{%d}(?:%s.{%d})" % (self.chunk_size, self.head, tail, self.window)


# The same three values as SQL over the columns chunk_size and max_lookback_size.
_HEAD = "greatest(0, chunk_size - max_lookback_size)"
_WINDOW = f"(chunk_size - {_HEAD})"
_PATTERN = (
    r"concat(r'(?s).{1,', chunk_size, r'}+\z|.{', " + _HEAD + ", '}(?:', "
    + ", ".join(
        f"if({_WINDOW} >= {len(mark)}, concat('.{{0,', {_WINDOW} - {len(mark)}, r'}}{_REGEX[mark]}|'), '')"
        for mark in DELIMITERS
    )
    + ", '.{', " + _WINDOW + ", '})')"
)


# Lengths of one block of a running sum.
_SUM_BLOCK = 512


def _growing(lengths: str) -> str:
    """0 and then the running sums of a short array; every step copies the sums so far."""
    return f"aggregate({lengths}, array(0), (ends, size) -> concat(ends, array(element_at(ends, -1) + size)))"


def _running_ends(lengths: str) -> str:
    """0 and then the running sums of an array of lengths, in two levels.

    Each block is summed alone and then moved by the sum of the blocks before it, so a text of many chunks
    copies at most a block for each chunk. One-element transforms bind what is used more than once.
    """
    blocks = (
        f"transform(sequence(0, (size(lengths) - 1) div {_SUM_BLOCK}), "
        f"b -> slice(lengths, cast(b * {_SUM_BLOCK} + 1 AS INT), {_SUM_BLOCK}))"
    )
    sums = f"transform({blocks}, block -> {_growing('block')})"
    starts = _growing("transform(sums, own -> element_at(own, -1))")
    moved = "flatten(transform(sums, (own, b) -> transform(slice(own, 2, size(own)), stop -> stop + get(starts, b))))"
    joined = f"transform(array({starts}), starts -> concat(array(0), {moved}))[0]"
    return f"transform(array({lengths}), lengths -> transform(array({sums}), sums -> {joined})[0])[0]"


def _chunk_array(text: str, pattern: str, window: str) -> str:
    """Array of chunk texts; joined they are the text again.

    A text with two-unit characters under a wide window is measured on a copy in which each of them is
    one other non-delimiter, and then cut by those lengths. The one-element transform binds the ends to
    a name, so that they are worked out once per text.
    """
    measured = f"regexp_extract_all(regexp_replace({text}, r'{_TWO_UNIT}', '{_ONE_UNIT}'), {pattern}, 0)"
    cut_by_length = (
        f"transform(array({_running_ends(f'transform({measured}, piece -> char_length(piece))')}), ends -> "
        f"transform(slice(ends, 2, size(ends)), (stop, i) -> substring({text}, get(ends, i) + 1, stop - get(ends, i))))[0]"
    )
    return (
        f"CASE WHEN {window} > {_DEEP_WINDOW} AND {text} RLIKE r'{_TWO_UNIT}' THEN {cut_by_length} "
        f"ELSE regexp_extract_all({text}, {pattern}, 0) END"
    )


def _with_chunks(texts: DataFrame, settings: Settings | None, text_column: str) -> DataFrame:
    """The other columns plus ``_chunks`` (and, with settings per row, ``_overlap`` and ``_reach``)."""
    kept = [name for name in texts.columns if name != text_column]
    if settings is None:
        # Every chunk but the last has a least length, so an overlap lies inside that many chunks.
        reach = f"cast(ceil(overlap_size / least(chunk_size, {_HEAD} + 1)) AS INT)"
        return texts.select(
            *kept,
            F.col("overlap_size").alias("_overlap"),
            F.expr(reach).alias("_reach"),
            F.expr(_chunk_array(text_column, _PATTERN, _WINDOW)).alias("_chunks"),
        )
    pattern = f"r'{settings.pattern}'"
    if settings.window > _DEEP_WINDOW:
        chunks = _chunk_array(text_column, pattern, str(settings.window))
    else:
        chunks = f"regexp_extract_all({text_column}, {pattern}, 0)"
    return texts.select(*kept, F.expr(chunks).alias("_chunks"))


def _overlap(size: str, reach: str | int) -> str:
    """The last ``size`` characters before chunk ``i``, taken from the ``reach`` chunks before it, so that
    the whole text is not scanned again."""
    if reach == 0:
        return "''"
    if reach == 1:
        before = "get(_chunks, i - 1)"
    else:
        before = f"array_join(transform(sequence(greatest(0, i - {reach}), i - 1), j -> get(_chunks, j)), '')"
    return f"CASE WHEN i = 0 OR {size} <= 0 THEN '' ELSE right({before}, {size}) END"


def split_texts(
    texts: DataFrame,
    settings: Settings | None = None,
    text_column: str = "parsed_text",
) -> DataFrame:
    """One row per chunk: the other columns of ``texts`` plus ``CHUNK_FIELDS``.

    With ``settings=None`` each row brings ``chunk_size``, ``max_lookback_size`` and ``overlap_size``.
    Chunks are numbered from 1; offsets count code points, the end is exclusive; an empty text gives no
    row; blank chunks are kept. Texts are independent, so the plan is a narrow map over the scan.
    """
    kept = [name for name in texts.columns if name != text_column]
    if settings is None:
        overlap = _overlap("_overlap", "_reach")
    else:
        shortest = min(settings.chunk_size, settings.head + 1)
        overlap = _overlap(str(settings.overlap_size), -(-settings.overlap_size // shortest))
    placed = _with_chunks(texts, settings, text_column).withColumn(
        "_ends", F.expr(_running_ends("transform(_chunks, piece -> char_length(piece))"))
    )
    rows = (
        "inline(transform(_chunks, (piece, i) -> struct(i + 1 AS chunk_number, piece AS chunk_text, "
        f"{overlap} AS overlap_text, get(_ends, i) AS character_start_offset, "
        "get(_ends, i + 1) AS character_end_offset)))"
    )
    return placed.select(*kept, F.expr(rows))


def chunk_counts(
    texts: DataFrame, settings: Settings | None = None, text_column: str = "parsed_text"
) -> DataFrame:
    """The other columns of ``texts`` plus the number of chunks, without making chunk rows."""
    kept = [name for name in texts.columns if name != text_column]
    return _with_chunks(texts, settings, text_column).select(
        *kept, F.size("_chunks").cast("long").alias("chunk_count")
    )


def next_split_index(text: Column, settings: Settings) -> Column:
    """Length of the first chunk of a text (0 for an empty text)."""
    measured = F.regexp_replace(text, _TWO_UNIT, _ONE_UNIT) if settings.window > _DEEP_WINDOW else text
    return F.char_length(F.regexp_extract(measured, rf"\A(?:{settings.pattern})", 0)).cast("int")
