"""Queries over texts: scalar functions, readers and chunking."""

from __future__ import annotations

import html
import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BinaryType

from corpuspipe.functions import names, text
from corpuspipe.operators import uploads, validation
from corpuspipe.operators.chunking import Settings, next_split_index, split_texts
from corpuspipe.operators.scale import sized
from corpuspipe.plans import roles
from corpuspipe.plans.registry import query
from corpuspipe.sources import readers, staging
from corpuspipe.sources.html import block_rows, html_blocks
from corpuspipe.sources.pieces import mapped
from corpuspipe.sources.tables import read_table, spread

BLANK = roles.BLANK_SQL


@query(
    "fn_suffix",
    f"""SELECT doc_id, lower(regexp_extract(source_path, '[^/]+(\\.[^./]+)$', 1)) AS suffix,
               {roles.TYPE_SQL} AS source_type FROM ({roles.BY_LANG})""",
)
def fn_suffix(spark, folder):
    path = F.col("source_path")
    return roles.documents(spark, folder).select(
        "doc_id", names.suffix(path).alias("suffix"), names.source_type(path).alias("source_type")
    )


# src5 stands for documents that hold nothing but blanks of several kinds.
_BLANKED = "CASE WHEN source = 'src5' THEN chr(8195) || chr(160) || chr(10) || chr(12288) ELSE text END"


def _blanked() -> F.Column:
    return F.when(F.col("source") == "src5", F.lit("  \n　")).otherwise(F.col("text"))


@query(
    "fn_usable_text",
    f"SELECT doc_id, regexp_replace({_BLANKED}, '{BLANK}+', '', 'g') <> '' AS is_usable FROM documents",
)
def fn_usable_text(spark, folder):
    return read_table(spark, folder, "documents").select(
        "doc_id", text.is_usable(_blanked()).alias("is_usable")
    )


@query(
    "fn_collapse_ws",
    f"SELECT doc_id, trim(regexp_replace({_BLANKED}, '{BLANK}+', ' ', 'g'), ' ') AS collapsed FROM documents",
)
def fn_collapse_ws(spark, folder):
    docs = spread(read_table(spark, folder, "documents").select("doc_id", "source", "text"), "doc_id")
    return docs.select("doc_id", text.collapse_blanks(_blanked()).alias("collapsed"))


@query(
    "fn_preformatted",
    f"""SELECT doc_id, array_to_string(list_filter(list_transform(
            regexp_split_to_array({_BLANKED}, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]'),
            lambda l: regexp_replace(l, '{BLANK}+$', '')), lambda l: l <> ''), chr(10)) AS tidied
        FROM documents""",
)
def fn_preformatted(spark, folder):
    docs = spread(read_table(spark, folder, "documents").select("doc_id", "source", "text"), "doc_id")
    return docs.select("doc_id", text.tidy_preformatted(_blanked()).alias("tidied"))


@query(
    "fn_source_hash",
    "SELECT doc_id, 'sha256:' || sha256(text) AS source_hash, "
    "substr('sha256:' || sha256(text), 1, 19) AS log_prefix FROM documents",
)
def fn_source_hash(spark, folder):
    value = names.source_hash(F.encode("text", "UTF-8"))
    return read_table(spark, folder, "documents").select(
        "doc_id", value.alias("source_hash"), names.hash_log_prefix(value).alias("log_prefix")
    )


# File names with a long, a foreign and a missing suffix, a blank stem and a backslash.
_NAME_SQL = """CASE source WHEN 'src9' THEN ' .ttf' WHEN 'src10' THEN 'unsafe\\Doc' || doc_id || '.PNG'
    WHEN 'src11' THEN 'doc.' || repeat('x', 17) WHEN 'src12' THEN 'in/doc.a b' WHEN 'src13' THEN 'doc' || doc_id
    ELSE source || '/doc' || doc_id || '.Txt' END"""


def _names(docs: DataFrame) -> DataFrame:
    source = F.col("source")
    return docs.select(
        "doc_id",
        "lang",
        F.when(source == "src9", " .ttf")
        .when(source == "src10", F.concat(F.lit("unsafe\\Doc"), "doc_id", F.lit(".PNG")))
        .when(source == "src11", "doc." + "x" * 17)
        .when(source == "src12", "in/doc.a b")
        .when(source == "src13", F.concat(F.lit("doc"), "doc_id"))
        .otherwise(F.concat(source, F.lit("/doc"), "doc_id", F.lit(".Txt")))
        .alias("filename"),
    )


_FILE = f"""(SELECT doc_id, lang, regexp_extract({_NAME_SQL}, '[^/\\\\]*$') AS f FROM documents)"""


@query(
    "fn_safe_suffix",
    f"""SELECT doc_id, CASE WHEN regexp_full_match(regexp_extract(f, '(?s)^.+(\\.[^.]+)$', 1), '\\.[A-Za-z0-9]{{1,16}}')
            THEN lower(regexp_extract(f, '(?s)^.+(\\.[^.]+)$', 1)) ELSE '' END AS safe_suffix FROM {_FILE}""",
)
def fn_safe_suffix(spark, folder):
    return _names(read_table(spark, folder, "documents")).select(
        "doc_id", names.safe_suffix(F.col("filename")).alias("safe_suffix")
    )


@query(
    "fn_display_name",
    f"""SELECT doc_id, CASE WHEN stem IN ('', '.', '..')
            THEN CASE WHEN lang = 'en' THEN 'Uploaded image' ELSE 'Uploaded font' END ELSE stem END AS display_name
        FROM (SELECT doc_id, lang, trim(substr(f, 1, length(f) - length(regexp_extract(f, '(?s)^.+(\\.[^.]+)$', 1)))) AS stem
              FROM {_FILE})""",
)
def fn_display_name(spark, folder):
    kind = F.when(F.col("lang") == "en", "image").otherwise("font")
    return _names(read_table(spark, folder, "documents")).select(
        "doc_id", names.default_display_name(kind, F.col("filename")).alias("display_name")
    )


@query(
    "fn_name_key",
    "SELECT c_custkey, lower(c_name || ' ' || c_mktsegment) AS display_name_key FROM customer",
)
def fn_name_key(spark, folder):
    full = F.concat_ws(" ", "c_name", "c_mktsegment")
    return read_table(spark, folder, "customer").select(
        "c_custkey", text.name_key(full).alias("display_name_key")
    )


@query(
    "fn_utc_text",
    f"SELECT o_orderkey, {roles.TIME_SQL.format('o_orderdate')} AS ordered_at FROM orders",
)
def fn_utc_text(spark, folder):
    return read_table(spark, folder, "orders").select(
        "o_orderkey", names.utc_text(F.col("o_orderdate").cast("timestamp")).alias("ordered_at")
    )


@query(
    "fn_asset_url",
    "SELECT page_id, '/assets/' || url_encode(url) || '/file' AS asset_url FROM pages",
)
def fn_asset_url(spark, folder):
    return read_table(spark, folder, "pages").select(
        "page_id", names.asset_url(F.col("url")).alias("asset_url")
    )


_AGE = "greatest(0, epoch(TIMESTAMP '2024-01-05 00:00:00') - floor(epoch(ts)))"


def _spoken(size: int, unit: str) -> str:
    count = f"CAST(floor({_AGE} / {size}) AS BIGINT)"
    return f"{count} || ' {unit}' || CASE WHEN {count} = 1 THEN '' ELSE 's' END || ' ago'"


@query(
    "fn_relative_age",
    f"""SELECT event_id, CASE WHEN event_type = 'error' THEN 'at ' || event_id WHEN {_AGE} < 60 THEN 'Just now'
            WHEN {_AGE} < 3600 THEN {_spoken(60, 'minute')} WHEN {_AGE} < 86400 THEN {_spoken(3600, 'hour')}
            ELSE {_spoken(86400, 'day')} END AS age FROM events""",
)
def fn_relative_age(spark, folder):
    shown = F.when(
        F.col("event_type") == "error", F.concat(F.lit("at "), F.col("event_id").cast("string"))
    ).otherwise(names.utc_text(F.col("ts").cast("timestamp")))
    as_of = F.to_timestamp(F.lit("2024-01-05 00:00:00"))
    return read_table(spark, folder, "events").select(
        "event_id", names.relative_age(shown, as_of).alias("age")
    )


# Readers

_ENCODINGS = (("en", "utf-8"), ("fr", "utf-8-sig"), ("de", "utf-16"), ("es", "utf-32"))


@query(
    "decode_text",
    """SELECT doc_id, CASE lang WHEN 'en' THEN 'utf-8' WHEN 'fr' THEN 'utf-8-sig' WHEN 'de' THEN 'utf-16'
           ELSE 'utf-32' END AS encoding,
           CASE WHEN source = 'src4' AND lang IN ('en', 'fr') THEN NULL ELSE text END AS parsed_text,
           NOT (source = 'src4' AND lang IN ('en', 'fr')) AS is_decodable FROM documents""",
)
def decode_text(spark, folder):
    """Documents written in four encodings by language; src4 has a broken UTF-8 end."""
    docs = spread(read_table(spark, folder, "documents").select("doc_id", "lang", "source", "text"), "doc_id")
    utf8 = F.encode("text", "UTF-8")
    broken = F.when(F.col("source") == "src4", F.unhex(F.lit("80"))).otherwise(F.unhex(F.lit("")))
    content = (
        F.when(F.col("lang") == "en", F.concat(utf8, broken))
        .when(F.col("lang") == "fr", F.concat(F.unhex(F.lit("EFBBBF")), utf8, broken))
        .when(F.col("lang") == "de", F.concat(F.unhex(F.lit("FFFE")), F.encode("text", "UTF-16LE")))
        .otherwise(F.concat(F.unhex(F.lit("0000FEFF")), F.encode("text", "UTF-32")))
    )
    return readers.decode_text(docs.select("doc_id", content.alias("content"))).select(
        "doc_id", "encoding", "parsed_text", "is_decodable"
    )


def _built(title: str, body: str) -> bytes:
    """A small EPUB whose manifest names the text before the title and whose spine turns them round."""
    out = io.BytesIO()
    page = "<html><head><title>x</title></head><body><{0}>{1}</{0}></body></html>"
    with zipfile.ZipFile(out, "w") as archive:
        archive.writestr(
            "META-INF/container.xml",
            '<container><rootfiles><rootfile full-path="OPS/book.opf"/></rootfiles></container>',
        )
        kind = 'media-type="application/xhtml+xml"'
        archive.writestr(
            "OPS/book.opf",
            f'<package><manifest><item id="b" href="text.xhtml" {kind}/>'
            '<item id="i" href="cover.png" media-type="image/png"/>'
            f'<item id="a" href="title.xhtml" {kind}/></manifest>'
            '<spine><itemref idref="a"/><itemref idref="i"/><itemref idref="b"/></spine></package>',
        )
        archive.writestr("OPS/title.xhtml", page.format("h1", html.escape(title)))
        archive.writestr("OPS/text.xhtml", page.format("p", html.escape(body)))
    return out.getvalue()


@F.arrow_udf(BinaryType())
def _as_epub(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    yield from mapped(batches, _built, pa.binary())


def _epubs(spark, folder) -> DataFrame:
    docs = read_table(spark, folder, "documents").select("doc_id", "source", "text")
    return spread(docs, "doc_id").select("doc_id", _as_epub("source", "text").alias("content"))


# An XML reader takes no control characters but these are no markup problem here: the HTML reader keeps
# texts as they are and blanks collapse.
_COLLAPSED = f"trim(regexp_replace(text, '{BLANK}+', ' ', 'g'), ' ')"


@query(
    "epub_documents",
    f"""SELECT doc_id, 0 AS spine_index, source AS document_text FROM documents
        UNION ALL SELECT doc_id, 1, {_COLLAPSED} FROM documents""",
)
def epub_documents(spark, folder):
    read = readers.epub_documents(_epubs(spark, folder), key="doc_id")
    return read.select(
        "doc_id", "spine_index", F.array_join(html_blocks(F.col("html")), text.BLOCK_JOINER).alias("document_text")
    )


@query(
    "epub_text",
    f"""SELECT doc_id, source || chr(10) || chr(10) || {_COLLAPSED} AS parsed_text FROM documents""",
)
def epub_text(spark, folder):
    return _epubs(spark, folder).select("doc_id", readers.epub_text(F.col("content")).alias("parsed_text"))


@query("html_text_blocks")
def html_text_blocks(spark, folder):
    pages = spread(read_table(spark, folder, "pages").select("page_id", "html"), "page_id")
    return block_rows(pages, "html")


@query(
    "assemble_pages",
    f"""SELECT conv_id, string_agg({roles.strip_sql('text')}, chr(10) || chr(10) ORDER BY turn) AS parsed_text
        FROM conversations WHERE regexp_replace(text, '{BLANK}+', '', 'g') <> '' GROUP BY conv_id""",
)
def assemble_pages(spark, folder):
    pages = read_table(spark, folder, "conversations").select("conv_id", "turn", "text")
    return readers.assemble_parts(pages, ["conv_id"], "turn", "text").select("conv_id", "parsed_text")


_UPLOAD_RULES = [
    ("suffix_not_allowed", "file suffix is not allowed for this asset type", "kind IN ('.pdf')"),
    ("content_mismatch", "file content does not match its suffix", "kind <> '.pdf' AND source = 'src6'"),
]


@query(
    "upload_precheck",
    roles.violations_sql(
        """SELECT doc_id, source, CASE lang WHEN 'en' THEN '.png' WHEN 'fr' THEN '.webp' WHEN 'de' THEN '.woff2'
               ELSE '.pdf' END AS kind FROM documents""",
        "upload",
        "doc_id",
        _UPLOAD_RULES,
        "NULL",
    ),
)
def upload_precheck(spark, folder):
    """Documents with the leading bytes of images and fonts; src6 has plain text instead."""
    lang = F.col("lang")
    lead = (
        F.when(F.col("source") == "src6", "")
        .when(lang == "en", "89504E470D0A1A0A")
        .when(lang == "fr", "524946460000000057454250")
        .otherwise("774F4632")
    )
    ending = (
        F.when(lang == "en", ".PNG").when(lang == "fr", ".webp").when(lang == "de", ".woff2").otherwise(".pdf")
    )
    content = F.concat(F.unhex(lead), F.encode("text", "UTF-8"))
    files = read_table(spark, folder, "documents").select(
        F.col("doc_id").alias("upload_id"),
        F.when(lang.isin("en", "fr"), "image").otherwise("font").alias("asset_type"),
        F.concat(F.lit("file"), ending).alias("original_filename"),
        F.octet_length(content).alias("length"),
        content.alias("content"),
    )
    return validation.upload_violations(files)


@query(
    "register_outcomes",
    """SELECT 'doc-' || doc_id AS upload_id, CASE WHEN lang NOT IN ('en', 'fr', 'de') OR source = 'src6' THEN 'refused' ELSE 'registered' END AS outcome,
           CASE WHEN lang NOT IN ('en', 'fr', 'de') THEN 'suffix_not_allowed' WHEN source = 'src6' THEN 'file_not_whole' ELSE '' END AS rules
       FROM documents""",
)
def register_outcomes(spark, folder):
    """Documents as the middle of images and fonts; those of src6 lack their last bytes."""
    lang, body = F.col("lang"), F.encode("text", "UTF-8")
    size = F.octet_length(body)

    def big(number: Column) -> Column:
        return F.unhex(F.lpad(F.hex(number), 8, "0"))

    turned = F.lpad(F.hex(size + 12), 8, "0")
    little = F.unhex(F.concat(*[F.substring(turned, at, 2) for at in (7, 5, 3, 1)]))
    png = F.concat(
        F.unhex(F.lit("89504E470D0A1A0A0000000D49484452" + "00" * 17)), big(size), F.unhex(F.lit("49444154")), body,
        F.unhex(F.lit("000000000000000049454E44AE426082")),
    )
    webp = F.concat(F.unhex(F.lit("52494646")), little, F.unhex(F.lit("5745425056503820")), F.unhex(F.lit("00000000")), body)
    woff2 = F.concat(F.unhex(F.lit("774F463200010000")), big(size + 48), F.unhex(F.lit("0001" + "00" * 34)), body)
    whole = F.when(lang == "en", png).when(lang == "fr", webp).otherwise(woff2)
    content = F.when(F.col("source") == "src6", whole.substr(F.lit(1), F.octet_length(whole) - 1)).otherwise(whole)
    ending = F.when(lang == "en", ".PNG").when(lang == "fr", ".webp").when(lang == "de", ".woff2").otherwise(".pdf")
    files = read_table(spark, folder, "documents").select(
        F.concat(F.lit("doc-"), "doc_id").alias("upload_id"),
        F.when(lang.isin("en", "fr"), "image").otherwise("font").alias("asset_type"),
        F.concat(F.lit("file"), ending).alias("original_filename"),
        F.concat(F.lit("sha256:"), F.sha2(content, 256)).alias("file_hash"),
        F.lit(None).cast("string").alias("full_font_name"),
        content.alias("content"),
    )
    return uploads.upload_outcomes(roles.assets(spark, folder), files)


@query(
    "parsed_sources",
    f"""SELECT world_id, 'attempt-' || world_id AS attempt_id, staging_entry_id, source_order,
               {roles.TYPE_SQL} AS source_file_type, parsed_text
        FROM (SELECT * REPLACE (CASE WHEN source = 'src5' THEN chr(8195) || chr(160) || chr(10) || chr(12288)
                                ELSE parsed_text END AS parsed_text) FROM ({roles.BY_LANG}))
        WHERE regexp_replace(parsed_text, '{BLANK}+', '', 'g') <> ''""",
)
def parsed_sources(spark, folder):
    blank = F.lit("  \n　")
    parsed = roles.documents(spark, folder).withColumns(
        {
            "source_file_type": names.source_type(F.col("source_path")),
            "parsed_text": F.when(F.col("source") == "src5", blank).otherwise(F.col("parsed_text")),
        }
    )
    good, _ = staging.prepare_parsed(parsed, F.concat(F.lit("attempt-"), "world_id"))
    return good


# Chunking


@query(
    "main_chunks",
    "WITH RECURSIVE "
    + roles.chunks_sql("SELECT doc_id, text AS parsed_text FROM documents", "doc_id", "4000", "1000", "400")
    + " SELECT * FROM cut_chunks",
)
def main_chunks(spark, folder):
    docs = read_table(spark, folder, "documents").select("doc_id", F.col("text").alias("parsed_text"))
    return split_texts(spread(docs, "doc_id"), Settings())


@query(
    "small_chunks",
    "WITH RECURSIVE "
    + roles.chunks_sql("SELECT doc_id, text AS parsed_text FROM documents", "doc_id", "300", "200", "450")
    + " SELECT * FROM cut_chunks",
)
def small_chunks(spark, folder):
    """Chunks smaller than their overlap, which then reaches over several chunks."""
    docs = read_table(spark, folder, "documents").select("doc_id", F.col("text").alias("parsed_text"))
    return split_texts(spread(docs, "doc_id"), Settings(300, 200, 450))


@query(
    "split_points",
    "WITH RECURSIVE "
    + roles.chunks_sql("SELECT doc_id, text AS parsed_text FROM documents", "doc_id", "600", "200", "50")
    + " SELECT doc_id, character_end_offset AS split_index FROM cut_chunks WHERE chunk_number = 1",
)
def split_points(spark, folder):
    docs = read_table(spark, folder, "documents")
    return docs.select("doc_id", next_split_index(F.col("text"), roles.SMALL).alias("split_index"))


@query(
    "chunks_by_world_settings",
    "WITH RECURSIVE "
    + roles.chunks_sql(
        f"SELECT d.world_id, d.doc_id, d.parsed_text, s.chunk_size, s.max_lookback_size, s.overlap_size "
        f"FROM ({roles.BY_SOURCE}) d JOIN ({roles.SETTINGS_SQL}) s ON d.world_id = s.world_id",
        "world_id, doc_id",
        "chunk_size",
        "max_lookback_size",
        "overlap_size",
    )
    + " SELECT * FROM cut_chunks",
)
def chunks_by_world_settings(spark, folder):
    docs = roles.documents(spark, folder, "source").select("world_id", "doc_id", "parsed_text")
    settings = sized(
        roles.settings(spark, folder).select("world_id", "chunk_size", "max_lookback_size", "overlap_size")
    )
    return split_texts(spread(docs, "doc_id").join(settings, "world_id")).drop(
        "chunk_size", "max_lookback_size", "overlap_size"
    )


@query(
    "chunk_coverage_check",
    """SELECT lang AS world_id, 'doc-' || doc_id AS source_id, CAST(length(text) AS INTEGER) AS text_length,
              CAST(length(text) AS INTEGER) AS covered, CAST(0 AS BIGINT) AS broken_joins,
              CAST(0 AS BIGINT) AS number_gaps, CAST(0 AS BIGINT) AS empty_chunks, TRUE AS is_exact
       FROM documents""",
)
def chunk_coverage_check(spark, folder):
    docs = read_table(spark, folder, "documents").select(
        F.col("lang").alias("world_id"),
        F.concat(F.lit("doc-"), "doc_id").alias("source_id"),
        F.col("text").alias("parsed_text"),
        F.col("n_chars").alias("text_length"),
    )
    # The stored length keeps the second reader away from the texts.
    lengths = docs.select("world_id", "source_id", "text_length")
    docs = docs.drop("text_length")
    return validation.chunk_coverage_check(split_texts(spread(docs, "source_id"), roles.SMALL), lengths)
