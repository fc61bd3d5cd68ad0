"""Readable text blocks of HTML documents.

The markup is read once as a stream of tags and texts. A run of loose text becomes one block. A
container that turns out to hold a block or a table row splits the run where the container began, so no
tree is built.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, StringType

from corpuspipe.functions.text import BLOCK_JOINER, INLINE_JOINER, TABLE_CELL_JOINER
from corpuspipe.sources.pieces import mapped

# Tags without readable text, tags that are one block each, table cells, empty elements.
UNREADABLE = frozenset("head metadata nav noscript script style svg".split())
BLOCKS = frozenset("h1 h2 h3 h4 h5 h6 p li blockquote figcaption caption pre td th".split())
CELLS = frozenset(("td", "th"))
EMPTY = frozenset(
    "area base br col embed hr img input keygen link menuitem meta param source track wbr "
    "basefont bgsound command frame image isindex nextid spacer".split()
)


def _inline(pieces: list[str]) -> str:
    return INLINE_JOINER.join(INLINE_JOINER.join(pieces).split())


def _preformatted(pieces: list[str]) -> str:
    lines = (line.rstrip() for line in BLOCK_JOINER.join(pieces).splitlines())
    return BLOCK_JOINER.join(line for line in lines if line)


class _BlockReader(HTMLParser):
    """Collects blocks; ``_open`` is the stack of open tags, as the markup closes them.

    There are no implied end tags: an end tag closes the nearest open tag of its name with everything
    inside, and is ignored if there is none.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[str] = []
        self._open: list[str] = []
        self._run: list[tuple[int, str]] = []  # loose text with the depth it stands at
        self._starts: list[int] = []  # run length when each open container began
        self._split: list[bool] = []  # is that container known to hold blocks
        self._text: list[str] = []
        self._skip: int | None = None  # depth of an unreadable element
        self._whole: int | None = None  # depth of a block or row being collected
        self._pieces: list[str] = []
        self._cells: list[list[str]] = []
        self._cell: int | None = None
        self._body: int | None = None
        self._done = False

    # Text

    def handle_data(self, data: str) -> None:
        self._text.append(data)

    def _end_text(self) -> None:
        text = "".join(self._text).strip()
        self._text.clear()
        if not text or self._done or self._skip is not None:
            return
        if self._whole is None:
            self._run.append((len(self._open), text))
            return
        self._pieces.append(text)
        if self._cell is not None:
            self._cells[-1].append(text)

    def _cut_run(self, start: int) -> None:
        """Turn the run from ``start`` on into one block."""
        block = _inline([text for _, text in self._run[start:]])
        del self._run[start:]
        if block:
            self.blocks.append(block)

    def _split_containers(self) -> None:
        """A block or row begins: every open container holds it, so the run is cut at their starts."""
        bounds = [0]
        for depth, start in enumerate(self._starts):
            if not self._split[depth]:
                self._split[depth] = True
                bounds.append(start)
        pieces, self._run = self._run, []
        for low, high in zip(bounds, [*bounds[1:], len(pieces)]):
            block = _inline([text for _, text in pieces[low:high]])
            if block:
                self.blocks.append(block)
        self._starts = [0] * len(self._starts)

    # Tags

    def handle_comment(self, data: str) -> None:
        self._end_text()

    handle_decl = handle_pi = unknown_decl = handle_comment

    def handle_startendtag(self, tag: str, attrs) -> None:
        self._begin(tag)
        self._finish(tag)

    def handle_starttag(self, tag: str, attrs) -> None:
        self._begin(tag)
        if tag in EMPTY:
            self._finish(tag)

    def handle_endtag(self, tag: str) -> None:
        self._finish(tag)

    def _begin(self, tag: str) -> None:
        self._end_text()
        depth = len(self._open)
        if not self._done and self._skip is None:
            if tag in UNREADABLE:
                self._skip = depth
            elif tag == "body" and self._body is None:
                self._enter_body(depth)
            elif self._whole is not None:
                row = self._open[self._whole] == "tr"
                if row and tag in CELLS and depth == self._whole + 1:
                    self._cell = depth
                    self._cells.append([])
            elif tag in BLOCKS or tag == "tr":
                self._split_containers()
                self._whole = depth
        self._open.append(tag)
        self._starts.append(len(self._run))
        self._split.append(False)

    def _enter_body(self, depth: int) -> None:
        """Only the first body counts; what came before it is dropped."""
        self._body, self._whole, self._cell = depth, None, None
        self.blocks.clear()
        self._run.clear()
        self._starts = [0] * depth
        self._split = [True] * depth
        self._pieces.clear()
        self._cells.clear()

    def _finish(self, tag: str) -> None:
        self._end_text()
        if tag not in self._open:
            return
        while True:
            name = self._open[-1]
            self._close_one()
            if name == tag:
                return

    def _close_one(self) -> None:
        depth = len(self._open) - 1
        name = self._open.pop()
        self._starts.pop()
        held_blocks = self._split.pop()
        if self._done:
            return
        if self._skip is not None:
            if self._skip == depth:
                self._skip = None
            return
        if self._cell == depth:
            self._cell = None
        if self._whole == depth:
            self._end_whole(name)
        elif self._body == depth:
            self._cut_run(0)
            self._done = True
        elif held_blocks:
            self._cut_run(0)

    def _end_whole(self, name: str) -> None:
        if name == "pre":
            block = _preformatted(self._pieces)
        elif name == "tr":
            cells = [cell for cell in map(_inline, self._cells) if cell]
            block = TABLE_CELL_JOINER.join(cells) if cells else _inline(self._pieces)
        else:
            block = _inline(self._pieces)
        if block:
            self.blocks.append(block)
        self._whole, self._cell = None, None
        self._pieces, self._cells = [], []

    def read(self, html: str) -> list[str]:
        self.feed(html)
        self.close()
        while self._open:
            self._finish(self._open[-1])
        self._end_text()
        if not self._done:
            self._cut_run(0)
        return self.blocks


def read_blocks(html: str | None) -> list[str] | None:
    return None if html is None else _BlockReader().read(html)


@F.arrow_udf(ArrayType(StringType()))
def _blocks(pages: Iterator[pa.Array]) -> Iterator[pa.Array]:
    yield from mapped(((page,) for page in pages), read_blocks, pa.list_(pa.string()))


def html_blocks(html: Column) -> Column:
    """Array of text blocks in reading order (an Arrow function: markup has no built-in reader)."""
    return _blocks(html)


def block_rows(pages: DataFrame, html: str) -> DataFrame:
    """One row per block: the other columns plus ``block_index`` and ``block``.

    The outer form of the generator keeps the optimizer from adding a filter on the array, which would
    read the markup twice; pages without a block are dropped afterwards.
    """
    kept = [name for name in pages.columns if name != html]
    blocks = pages.select(*kept, html_blocks(F.col(html)).alias("_blocks"))
    return blocks.select(*kept, F.posexplode_outer("_blocks").alias("block_index", "block")).where(
        F.col("block_index").isNotNull()
    )


def html_text(html: Column) -> Column:
    return F.array_join(html_blocks(html), BLOCK_JOINER)
