"""Reading files and page tables into texts."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from urllib.parse import unquote
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StringType

from corpuspipe.functions import text
from corpuspipe.functions.text import BLOCK_JOINER, DOCUMENT_JOINER
from corpuspipe.operators.scale import in_ranges, pinned
from corpuspipe.operators.validation import violations
from corpuspipe.sources.html import read_blocks
from corpuspipe.sources.pieces import mapped, pieces, release_memory

# A text is one value, and Spark's values end at 2 GiB.
MAX_TEXT_BYTES = 1 << 30

# About the size of the parts of a source that is too large for one value.
PART_BYTES = 1 << 26

# Byte order marks in the order they are tried, with the encoding each one selects.
BYTE_ORDER_MARKS = (
    ("FFFE0000", "utf-32"),
    ("0000FEFF", "utf-32"),
    ("EFBBBF", "utf-8-sig"),
    ("FFFE", "utf-16"),
    ("FEFF", "utf-16"),
)
DEFAULT_ENCODING = "utf-8"


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """Every file under a folder as ``path, modificationTime, length, content``."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)


def text_encoding(content: Column) -> Column:
    lead = F.hex(F.substring(content, 1, 4))
    found = F.coalesce(
        *[F.when(F.startswith(lead, F.lit(mark)), F.lit(name)) for mark, name in BYTE_ORDER_MARKS]
    )
    return F.coalesce(found, F.lit(DEFAULT_ENCODING))


def _decoded(encoding: str, content: bytes | None) -> str | None:
    try:
        return None if content is None else content.decode(encoding)
    except UnicodeDecodeError:
        return None


@F.arrow_udf(StringType())
def _decode_wide(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    yield from mapped(batches, _decoded, pa.string())


def decode_text(files: DataFrame) -> DataFrame:
    """Adds ``encoding``, ``parsed_text`` and ``is_decodable`` to rows with a ``content``.

    Line ends stay as they are and the byte order mark goes. UTF-8 is checked and decoded in the JVM;
    only two- and four-byte contents travel to Python, which has a strict decoder that does not stop
    the job.
    """
    content = F.col("content")
    body = F.when(F.col("encoding") == "utf-8-sig", F.substring(content, 4, 2_147_483_647)).otherwise(content)
    wide = F.col("encoding").isin("utf-16", "utf-32")
    decoded = files.withColumn("encoding", text_encoding(content)).withColumn(
        "_wide", _decode_wide(F.col("encoding"), F.when(wide, content))
    )
    return (
        decoded.withColumn(
            "parsed_text",
            F.when(wide, F.col("_wide")).otherwise(F.try_validate_utf8(body.cast("string"))),
        )
        .withColumn("is_decodable", F.col("parsed_text").isNotNull())
        .drop("_wide")
    )


def assemble_pages(pages: DataFrame, keys: list[str], order: str, page_text: str) -> DataFrame:
    """One text per source: pages stripped, blank ones dropped, kept in order, joined by a blank line.

    A source too large for one value is left out here and named by ``oversized_pages``; there are at
    most total bytes / MAX_TEXT_BYTES of them. So every collected list is bounded. ``assemble_parts`` has them too.
    """
    return _fitting(pages, oversized_pages(pages, keys, page_text), keys, order, page_text)


def _fitting(pages: DataFrame, oversized: DataFrame, keys: list[str], order: str, page_text: str) -> DataFrame:
    fitting = pages.join(F.broadcast(oversized), keys, "left_anti")
    usable = fitting.where(text.is_usable(F.col(page_text)))
    return usable.groupBy(*keys).agg(_joined(F.col(order), text.strip_blanks(F.col(page_text))))


def _joined(order: Column, page: Column) -> Column:
    pages = F.collect_list(F.struct(order.alias("_order"), page.alias("_text")))
    return F.array_join(F.transform(F.array_sort(pages), lambda one: one["_text"]), DOCUMENT_JOINER).alias("parsed_text")


def assemble_parts(pages: DataFrame, keys: list[str], order: str, page_text: str) -> DataFrame:
    """All sources as ``keys``, ``part`` and ``parsed_text``: those of ``assemble_pages`` as part 0, and each source
    too large for one value as several parts of consecutive pages.

    In the order of ``part`` and joined by a blank line the parts are the whole text. Their numbers grow but may leave
    some out. Sizes are summed inside sorted ranges, so one source may hold any share of the pages; a page larger than
    a part is one of its own.
    """
    oversized = pinned(oversized_pages(pages, keys, page_text))
    whole = _fitting(pages, oversized, keys, order, page_text).select(*keys, F.lit(0).cast("long").alias("part"), "parsed_text")
    if oversized.isEmpty():
        return whole
    large = (
        pages.where(text.is_usable(F.col(page_text)))
        .join(F.broadcast(oversized), keys, "left_semi")
        .select(*keys, F.col(order).alias("_order"), text.strip_blanks(F.col(page_text)).alias("_text"))
        .withColumn("_bytes", F.octet_length("_text").cast("long") + len(DOCUMENT_JOINER))
    )
    limit = min(PART_BYTES, MAX_TEXT_BYTES)
    before = Window.partitionBy("_range", *keys).orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    # A page beyond the limit fills up its step, so what follows it is in a later one.
    step = F.floor(F.coalesce(F.sum("_bytes").over(before), F.lit(0)) / limit)
    alone = (F.col("_bytes") > limit).cast("long")
    part = F.lit(1 << 32) * F.col("_range") + 2 * step + alone + 1
    parts = in_ranges(large, *keys, "_order", "_text").withColumn("part", part.cast("long"))
    return whole.unionByName(parts.groupBy(*keys, "part").agg(_joined(F.col("_order"), F.col("_text"))))


def oversized_pages(pages: DataFrame, keys: list[str], page_text: str) -> DataFrame:
    """Sources whose pages together may not fit into one value; lengths are summed map-side."""
    return (
        pages.groupBy(*keys)
        .agg(F.sum(F.octet_length(page_text).cast("long") + 2).alias("_bytes"))
        .where(F.col("_bytes") > MAX_TEXT_BYTES)
        .select(*keys)
    )


def page_violations(pages: DataFrame, keys: list[str], page_text: str) -> DataFrame:
    """Sources without a single usable page, and those too large for one value, which ``assemble_pages`` leaves out."""
    counted = pages.groupBy(*keys).agg(
        F.count_if(text.is_usable(F.col(page_text))).alias("_usable"),
        F.sum(F.octet_length(page_text).cast("long") + 2).alias("_bytes"),
    )
    return violations(
        counted,
        "source",
        F.concat_ws("|", *[F.col(key).cast("string") for key in keys]),
        [
            ("text_unusable", "no page holds a visible character", F.col("_usable") == 0),
            ("text_too_large", "the pages together do not fit into one value", F.col("_bytes") > MAX_TEXT_BYTES),
        ],
        F.lit(None),
    )


class EpubError(ValueError):
    """The archive or its reading order is broken."""


DOCUMENT_TYPE = "application/xhtml+xml"  # fixed value


def _local(element: ElementTree.Element) -> str:
    return element.tag.rpartition("}")[2]


def _find_all(root: ElementTree.Element, name: str) -> list[ElementTree.Element]:
    return [element for element in root.iter() if _local(element) == name]


def _markup(content: bytes) -> str:
    declared = re.match(rb"""\s*<\?xml[^>]*encoding=["']([A-Za-z0-9._-]+)""", content)
    encoding = declared.group(1).decode("ascii") if declared else "utf-8-sig"
    try:
        return content.decode(encoding, errors="replace").lstrip("﻿")
    except LookupError:
        return content.decode("utf-8", errors="replace")


def read_spine(content: bytes) -> list[str]:
    """Markup of the documents of an EPUB in spine order; other spine items are passed over."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            container = ElementTree.fromstring(archive.read("META-INF/container.xml"))
            package_path = _find_all(container, "rootfile")[0].attrib["full-path"]
            package = ElementTree.fromstring(archive.read(package_path))
            folder = posixpath.dirname(package_path)
            items = {item.attrib["id"]: item.attrib for item in _find_all(package, "item")}
            documents = []
            for entry in _find_all(package, "itemref"):
                item = items.get(entry.attrib.get("idref", ""))
                if item is None:
                    raise EpubError("the reading order names an unknown item")
                if item.get("media-type") == DOCUMENT_TYPE:
                    name = posixpath.normpath(posixpath.join(folder, unquote(item["href"])))
                    documents.append(_markup(archive.read(name)))
            return documents
    except (zipfile.BadZipFile, KeyError, IndexError, ElementTree.ParseError) as error:
        raise EpubError("the archive cannot be read") from error


def epub_documents(files: DataFrame, key: str = "path") -> DataFrame:
    """One row per document of every EPUB (``key, spine_index, html, error``); a broken file gives one
    row with an error."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = batch.schema.field(0).type
            for at, contents in _numbered(batch.column(1)):
                rows = []
                for place, content in enumerate(contents, at):
                    try:
                        rows += [(place, i, html, None) for i, html in enumerate(read_spine(bytes(content)))]
                    except EpubError as error:
                        rows.append((place, None, None, str(error)))
                places, *columns = zip(*rows) if rows else ((), (), (), ())
                names = batch.column(0).take(pa.array(places, pa.int64()))
                arrays = [names, *(pa.array(column, to) for column, to in zip(columns, (pa.int32(), pa.string(), pa.string())))]
                yield pa.RecordBatch.from_arrays(arrays, schema=pa.schema([(key, kind), *_SPINE]))
                del rows, places, columns, arrays
            release_memory()

    key_type = files.schema[key].dataType.simpleString()
    return files.select(key, "content").mapInArrow(
        read, f"{key} {key_type}, spine_index int, html string, error string"
    )


_SPINE = (("spine_index", pa.int32()), ("html", pa.string()), ("error", pa.string()))


def _numbered(column: pa.Array) -> Iterator[tuple[int, list]]:
    """Pieces of a column, each with the place where it starts."""
    at = 0
    for (values,) in pieces((column,)):
        yield at, values
        at += len(values)


def _read_text(content: bytes | None) -> str | None:
    if content is None:
        return None
    try:
        documents = (BLOCK_JOINER.join(read_blocks(html)) for html in read_spine(content))
        return DOCUMENT_JOINER.join(document for document in documents if document.strip())
    except EpubError:
        return None


@F.arrow_udf(StringType())
def _epub_text(contents: Iterator[pa.Array]) -> Iterator[pa.Array]:
    yield from mapped(((content,) for content in contents), _read_text, pa.string())


def epub_text(content: Column) -> Column:
    """Whole text of an EPUB, or null for a broken one; one row in, one row out, so nothing is shuffled."""
    return _epub_text(content)
