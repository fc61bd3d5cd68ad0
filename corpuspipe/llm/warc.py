"""WARC archives: writing, normalising and reading back.

Pages are written as WARC records into gzip files of one stream each, as many tools leave them. The normaliser
inflates such a file once, from start to end, writes every record as a gzip member of its own and puts an index
of offsets beside the archive, so that any record can be read alone. Reading goes through that index.

Of records with equal payloads of at least ``least_bytes`` the one with the smallest id is a response, the others
are revisits that carry headers only. Digests are counted before anything is shuffled, and only digests that
occur twice are joined with the pages.

Files lie in the shared folder. Every attempt of a task writes files of its own name, and the stored tables of
archives and index name those of committed attempts only, so a repeated task leaves no double records.

Defined results: null html is an empty payload; empty payloads are equal. A null url gives a record without a
target. Rows that repeat the smallest id are all responses; a null id sorts last. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, functions as F

from corpuspipe.llm.common import keep_columns, new_folder, shuffle_partitions, store

# Uncompressed bytes after which a new archive begins, and bytes read at a time.
ARCHIVE_BYTES = 32 << 20
READ_BYTES = 1 << 20
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"

INDEX = (
    "archive string, offset long, length long, record_id string, record_type string, target string, payload_digest string"
)


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(name: str | None) -> int | None:
    number = (name or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record; a revisit has the HTTP headers alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    lines.append(f"WARC-Payload-Digest: sha1:{digest_of(payload)}")
    if revisit:
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"WARC-Refers-To: {record_id(refers_to)}")
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def split_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")[1:]
    headers = {name.lower(): value.strip() for name, _, value in (line.partition(":") for line in lines)}
    return headers, rest[: int(headers["content-length"])]


def inflated(stream) -> Iterator[bytes]:
    """Pieces of a gzip stream of one member or more."""
    inflater, rest = zlib.decompressobj(31), b""
    while True:
        data = rest or stream.read(READ_BYTES)
        if not data:
            if not inflater.eof:
                raise ValueError("The archive ends inside a member.")
            return
        if inflater.eof:
            inflater = zlib.decompressobj(31)
        piece = inflater.decompress(data, 4 * READ_BYTES)
        yield piece
        while not inflater.eof and (inflater.unconsumed_tail or piece):
            piece = inflater.decompress(inflater.unconsumed_tail, 4 * READ_BYTES)
            yield piece
        rest = inflater.unused_data if inflater.eof else b""


def records(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records from pieces of inflated bytes; holds one record and a piece at a time."""
    held = bytearray()
    more = True
    while more or held:
        end = held.find(b"\r\n\r\n")
        if end >= 0:
            lines = bytes(held[:end]).decode().split("\r\n")
            size = next(int(line.partition(":")[2]) for line in lines if line.lower().startswith("content-length:"))
            whole = end + 4 + size + 4
            if len(held) >= whole:
                yield bytes(held[:whole])
                del held[:whole]
                continue
        if not more:
            raise ValueError("The archive ends inside a record.")
        piece = next(pieces, None)
        more = piece is not None
        held += piece or b""


def _files(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    files, path = pyarrow.fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
    return files, path


def with_originals(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``page_id, url, payload, revisit, refers_to`` of every row."""
    read = keep_columns(pages, page_id="long", url="string", html="string").select(
        "page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload")
    )
    hashed = read.withColumn("digest", F.sha1("payload"))
    shared = store(
        hashed.where(F.length("payload") >= least_bytes)
        .groupBy("digest")
        .agg(F.count(F.lit(1)).alias("rows"), F.min("page_id").alias("original"))
        .where((F.col("rows") > 1) & F.col("original").isNotNull())
        .select("digest", "original"),
        "warc-shared",
    )
    revisit = F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original"))
    return hashed.join(shared, "digest", "left").select(
        "page_id", "url", "payload", revisit.alias("revisit"), F.when(revisit, F.col("original")).alias("refers_to")
    )


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write the records of ``with_originals`` as gzip files of one stream; a stored table of the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = _files(folder)
        files.create_dir(path, recursive=True)
        name = out = packer = None
        size = count = 0

        def closed() -> pa.RecordBatch:
            out.write(packer.flush())
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([count], pa.int64())], names=["archive", "records"])

        for batch in batches:
            for page_id, url, payload, revisit, refers_to in zip(*batch.columns):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out = files.open_output_stream(f"{path}/{name}", compression=None)
                    packer, size, count = zlib.compressobj(LEVEL, wbits=31), 0, 0
                data = record(page_id.as_py(), url.as_py(), payload.as_py(), refers_to.as_py(), revisit.as_py())
                out.write(packer.compress(data))
                size, count = size + len(data), count + 1
                if size >= ARCHIVE_BYTES:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    return store(pages.mapInArrow(run, "archive string, records long"), "warc-archives")


def normalise(archives: DataFrame, folder: str, into: str) -> DataFrame:
    """Rewrite every archive record by record, with an index beside it; a stored table of all index rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (files, path), (target_files, target) = _files(folder), _files(into)
        target_files.create_dir(target, recursive=True)
        names = [field.split()[0] for field in INDEX.split(", ")]
        for batch in batches:
            for name in batch.column(0).to_pylist():
                new, offset, rows = f"{uuid.uuid4().hex}.warc.gz", 0, []
                with files.open_input_stream(f"{path}/{name}", compression=None) as stream, target_files.open_output_stream(
                    f"{target}/{new}", compression=None
                ) as out:
                    for data in records(inflated(stream)):
                        packer = zlib.compressobj(LEVEL, wbits=31)
                        member = packer.compress(data) + packer.flush()
                        out.write(member)
                        headers, _ = split_record(data)
                        rows.append(
                            (new, offset, len(member), headers["warc-record-id"], headers["warc-type"],
                             headers.get("warc-target-uri"), headers["warc-payload-digest"])
                        )
                        offset += len(member)
                with target_files.open_output_stream(f"{target}/{new}.index", compression=None) as out:
                    for row in rows:
                        out.write(json.dumps(dict(zip(names, row))).encode() + b"\n")
                columns = list(zip(*rows)) if rows else [()] * len(names)
                kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return store(
        archives.select("archive").repartition(shuffle_partitions(archives.sparkSession)).mapInArrow(run, INDEX), "warc-index"
    )


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """Records at the index's offsets: ``page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload``.

    A response's payload is checked against its digest; a revisit has none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = _files(folder)
        name = stream = None
        for batch in batches:
            rows = []
            for archive, offset, length in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if archive != name:
                    if stream is not None:
                        stream.close()
                    name, stream = archive, files.open_input_file(f"{path}/{archive}")
                data = zlib.decompress(stream.read_at(length, offset), wbits=31)
                headers, block = split_record(data)
                head, _, payload = block.partition(b"\r\n\r\n")
                size = next(
                    int(line.partition(":")[2]) for line in head.decode().split("\r\n") if line.lower().startswith("content-length:")
                )
                digest, kind = headers["warc-payload-digest"].removeprefix("sha1:"), headers["warc-type"]
                if kind == "response" and (len(payload) != size or digest_of(payload) != digest):
                    raise ValueError(f"The record at {offset} of {archive} does not have its digest.")
                url = headers.get("warc-target-uri")
                if url is not None:
                    url = url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
                rows.append(
                    (page_of(headers["warc-record-id"]), url, size, digest, kind,
                     page_of(headers.get("warc-refers-to")), payload if kind == "response" else None)
                )
                if len(rows) == 256:
                    yield _read_rows(rows)
                    rows = []
            yield _read_rows(rows)

    return index.select("archive", "offset", "length").mapInArrow(
        run,
        "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary",
    )


def _read_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write, normalise and read back the archives of ``pages``."""
    spark = pages.sparkSession
    mixed, single = new_folder(spark, "warc-streams"), new_folder(spark, "warc")
    archives = write_archives(with_originals(pages, least_bytes), mixed)
    index = normalise(archives, mixed, single)
    return read_records(index, single)
