"""Text expressions. Everything here is a native column expression unless it says otherwise."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

# The characters Python's str.isspace() accepts, as a Java regex class body.
BLANK_CLASS = (
    r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
# The same characters as a set for trimming.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + (
    "\u2028\u2029\u202f\u205f\u3000"
)
# The line ends Python's str.splitlines() accepts.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"

# Joiners of the extracted text.
DOCUMENT_JOINER = "\n\n"
BLOCK_JOINER = "\n"
INLINE_JOINER = " "
TABLE_CELL_JOINER = " | "


def is_usable(text: Column) -> Column:
    """True when the text holds at least one non-blank character; null counts as unusable."""
    return F.coalesce(text.rlike(f"[^{BLANK_CLASS}]"), F.lit(False))


def strip_blanks(text: Column) -> Column:
    """Strip Unicode blanks at both ends (a plain ``trim`` only knows U+0020)."""
    return F.trim(text, F.lit(BLANKS))


def collapse_blanks(text: Column) -> Column:
    """Every run of blanks becomes one space; none at the ends."""
    return F.trim(F.regexp_replace(text, f"[{BLANK_CLASS}]+", INLINE_JOINER))


def tidy_preformatted(text: Column) -> Column:
    """Right-strip each line and drop the blank ones."""
    stripped = F.transform(F.split(text, LINE_END), lambda line: F.rtrim(line, F.lit(BLANKS)))
    return F.array_join(F.filter(stripped, lambda line: line != ""), BLOCK_JOINER)


def normalize_type(source_type: Column) -> Column:
    return F.lower(strip_blanks(source_type))


@F.pandas_udf(StringType())
def _casefold(names: pd.Series) -> pd.Series:
    return names.str.casefold()


def name_key(display_name: Column) -> Column:
    """Case-insensitive key of a display name.

    Full Unicode case folding has no built-in equal (``lower`` leaves the sharp s), so this one is
    an Arrow function; it runs on catalog names only, never on texts.
    """
    return _casefold(display_name)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
