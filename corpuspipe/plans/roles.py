"""How the test tables play the engine's tables, as frames and as the same SQL.

Every query covers its whole table. A query with one role takes all of ``documents`` for it. Where both are
needed, ``documents`` is cut by its ``source`` column into two roles that together are the table: sources loaded
earlier (published) and sources that arrive now (staged). Planted defects change values of rows by their
attributes; no row is left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpuspipe.functions import names, text
from corpuspipe.operators.catalog import DEFAULT_LAST_USED, default_last_used
from corpuspipe.operators.chunking import Settings, split_texts
from corpuspipe.operators.scale import pinned
from corpuspipe.sources.tables import read_table, spread

FIRST_STAGED = "src15"  # sources from here on (in text order) arrive now
SMALL = Settings(600, 200, 50)


def documents(spark: SparkSession, folder: str, world: str = "lang") -> DataFrame:
    """Documents as sources of a world; the text column is only read where it is used."""
    return as_sources(read_table(spark, folder, "documents"), world)


def as_sources(docs: DataFrame, world: str) -> DataFrame:
    ending = (
        F.when(F.col("source") == "src7", ".docx")
        .when(F.col("source") == "src8", "")
        .when(F.col("lang") == "en", ".txt")
        .when(F.col("lang") == "fr", ".EPUB")
        .otherwise(".pdf")
    )
    return docs.select(
        F.col(world).alias("world_id"),
        F.concat(F.lit("entry-"), "doc_id").alias("staging_entry_id"),
        F.col("doc_id").alias("source_order"),
        F.concat(F.lit("inbox/"), "source", F.lit("/doc"), "doc_id", ending).alias("source_path"),
        F.col("text").alias("parsed_text"),
        names.source_hash(F.encode("text", "UTF-8")).alias("source_hash"),
        "source",
        "lang",
        "doc_id",
        "n_chars",
    )


DOCUMENTS_SQL = """
    SELECT {world} AS world_id, 'entry-' || doc_id AS staging_entry_id,
           doc_id AS source_order,
           'inbox/' || source || '/doc' || doc_id || CASE
               WHEN source = 'src7' THEN '.docx' WHEN source = 'src8' THEN ''
               WHEN lang = 'en' THEN '.txt' WHEN lang = 'fr' THEN '.EPUB' ELSE '.pdf' END AS source_path,
           text AS parsed_text, 'sha256:' || sha256(text) AS source_hash, source, lang, doc_id, n_chars
    FROM documents"""
BY_LANG = DOCUMENTS_SQL.format(world="lang")
BY_SOURCE = DOCUMENTS_SQL.format(world="source")


def hashed(spark: SparkSession, folder: str, world: str = "lang") -> DataFrame:
    """Documents without their texts, hashed once and stored, as the hash step of a real batch stores them.

    Operators that read hashes several times then read narrow rows and never a text again.
    """
    return pinned(documents(spark, folder, world).drop("parsed_text"))


def staged(spark: SparkSession, folder: str) -> DataFrame:
    return only_staged(documents(spark, folder))


def only_staged(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("source") >= FIRST_STAGED)


def published(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of ``sources``: numbered by document with gaps, one world per language."""
    return as_published(documents(spark, folder))


def all_published(spark: SparkSession, folder: str) -> DataFrame:
    """All documents as rows of ``sources``."""
    return as_source_rows(documents(spark, folder))


def as_published(docs: DataFrame) -> DataFrame:
    return as_source_rows(docs.where(F.col("source") < FIRST_STAGED))


def as_source_rows(docs: DataFrame) -> DataFrame:
    texts = ["parsed_text"] if "parsed_text" in docs.columns else []
    return docs.select(
        "world_id",
        F.concat(F.lit("doc-"), "doc_id").alias("source_id"),
        names.base_name(F.col("source_path")).alias("original_filename"),
        F.concat(F.lit("sources/doc-"), "doc_id").alias("stored_path"),
        names.source_type(F.col("source_path")).alias("source_file_type"),
        "source_hash",
        (F.col("source_order") + 1).alias("book_number"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id")).alias("committed_at"),
        *texts,
    )


STAGED_SQL = f"SELECT * FROM ({BY_LANG}) WHERE source >= '{FIRST_STAGED}'"
TYPE_SQL = (
    "CASE WHEN regexp_extract(source_path, '[^/]+(\\.[^./]+)$', 1) = '' THEN 'missing' "
    "ELSE lower(substr(regexp_extract(source_path, '[^/]+(\\.[^./]+)$', 1), 2)) END"
)
ALL_PUBLISHED_SQL = f"""
    SELECT world_id, 'doc-' || doc_id AS source_id, regexp_extract(source_path, '[^/]*$') AS original_filename,
           'sources/doc-' || doc_id AS stored_path, {TYPE_SQL} AS source_file_type, source_hash,
           source_order + 1 AS book_number, parsed_text, doc_id, source
    FROM ({BY_LANG})"""
PUBLISHED_SQL = f"SELECT * EXCLUDE (source) FROM ({ALL_PUBLISHED_SQL}) WHERE source < '{FIRST_STAGED}'"


def settings(spark: SparkSession, folder: str) -> DataFrame:
    """Splitter settings per ``source``; the later half is locked and src1 and src2 break a rule."""
    number = F.substring("world_id", 4, 10).cast("int")
    worlds = documents(spark, folder, "source").select("world_id").distinct()
    return worlds.select(
        "world_id",
        (600 + 100 * number).cast("int").alias("chunk_size"),
        (100 + 10 * number).cast("int").alias("max_lookback_size"),
        (20 * number).cast("int").alias("overlap_size"),
        F.when(F.col("world_id") == "src3", "0").otherwise("1").alias("splitter_version"),
        (number >= 10).alias("is_locked"),
    )


SETTINGS_SQL = """
    SELECT source AS world_id, CAST(600 + 100 * n AS INTEGER) AS chunk_size,
           CAST(100 + 10 * n AS INTEGER) AS max_lookback_size, CAST(20 * n AS INTEGER) AS overlap_size,
           CASE WHEN source = 'src3' THEN '0' ELSE '1' END AS splitter_version, n >= 10 AS is_locked
    FROM (SELECT DISTINCT source, CAST(substr(source, 4) AS INTEGER) AS n FROM documents)"""


def split_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Split chunks of all documents, with small chunk settings."""
    texts = spread(
        documents(spark, folder).select("world_id", "staging_entry_id", "source_order", "source", "parsed_text"),
        "staging_entry_id",
    )
    return split_texts(texts, SMALL)


def published_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of ``chunks`` for all documents."""
    texts = spread(
        all_published(spark, folder).select("world_id", "source_id", "book_number", "parsed_text"), "source_id"
    )
    return split_texts(texts, SMALL).withColumn(
        "chunk_id", F.concat_ws("-", "source_id", F.col("chunk_number").cast("string"))
    )


def published_chunk_keys(spark: SparkSession, folder: str) -> DataFrame:
    """The key columns of the published chunks, stored as a chunk table stores them."""
    return pinned(
        published_chunks(spark, folder).select("world_id", "chunk_id", "source_id", "book_number", "chunk_number")
    )


def chunks_sql(texts: str, keys: str, chunk_size="600", lookback="200", overlap="50") -> str:
    """CTEs ending in ``cut_chunks``: the chunk rule as one recursion step per chunk."""
    prefixed = ", ".join(f"cut.{key.strip()}" for key in keys.split(","))

    def end(start: str, prefix: str = "") -> str:
        window = f"substr({prefix}parsed_text, CAST({start} + {prefix}lo + 1 AS BIGINT), CAST({prefix}cs - {prefix}lo AS BIGINT))"
        tried = " ".join(
            f"WHEN regexp_matches({window}, '{d}') "
            f"THEN {start} + {prefix}lo + length(regexp_extract({window}, '(?s)^(.*{d})', 1))"
            for d in (r"\n\n", r"\n", r"\.", "!", r"\?", " ")
        )
        return (
            f"CASE WHEN length({prefix}parsed_text) - {start} <= {prefix}cs THEN length({prefix}parsed_text) "
            f"{tried} ELSE {start} + {prefix}cs END"
        )

    return f"""
    texts AS (
        SELECT {keys}, parsed_text, CAST({chunk_size} AS BIGINT) AS cs,
               CAST(greatest(0, {chunk_size} - {lookback}) AS BIGINT) AS lo, CAST({overlap} AS BIGINT) AS ov
        FROM ({texts})),
    cut AS (
        SELECT {keys}, parsed_text, cs, lo, ov, CAST(1 AS BIGINT) AS n, CAST(0 AS BIGINT) AS s,
               CAST({end('0')} AS BIGINT) AS e
        FROM texts WHERE length(parsed_text) > 0
        UNION ALL
        SELECT {prefixed}, cut.parsed_text, cut.cs, cut.lo, cut.ov, cut.n + 1, cut.e,
               CAST({end('cut.e', 'cut.')} AS BIGINT)
        FROM cut WHERE cut.e < length(cut.parsed_text)),
    cut_chunks AS (
        SELECT {keys}, CAST(n AS INTEGER) AS chunk_number, substr(parsed_text, s + 1, e - s) AS chunk_text,
               substr(parsed_text, greatest(0, s - ov) + 1, s - greatest(0, s - ov)) AS overlap_text,
               CAST(s AS INTEGER) AS character_start_offset, CAST(e AS INTEGER) AS character_end_offset
        FROM cut)"""


SPLIT_SQL = chunks_sql(BY_LANG, "world_id, staging_entry_id, source_order, source")
PUBLISHED_CHUNKS_SQL = chunks_sql(ALL_PUBLISHED_SQL, "world_id, source_id, book_number")


def assets(spark: SparkSession, folder: str) -> DataFrame:
    number, name = F.col("n_nationkey"), F.col("n_name")
    uploaded = number >= 5
    image = F.col("n_regionkey") <= 2
    return read_table(spark, folder, "nation").select(
        F.concat(F.lit("asset-"), number).alias("asset_id"),
        F.when(image, "image").otherwise("font").alias("asset_type"),
        name.alias("display_name"),
        F.concat(F.when(image, "images/").otherwise("fonts/"), name, F.lit(".bin")).alias("stored_path"),
        F.when(uploaded, names.source_hash(F.encode(name, "UTF-8"))).alias("file_hash"),
        (~uploaded).alias("is_built_in"),
        F.when(~image, name).alias("full_font_name"),
        F.when(uploaded, F.concat(name, F.lit(".bin"))).alias("original_filename"),
    )


ASSETS_SQL = """
    SELECT 'asset-' || n_nationkey AS asset_id,
           CASE WHEN n_regionkey <= 2 THEN 'image' ELSE 'font' END AS asset_type, n_name AS display_name,
           CASE WHEN n_regionkey <= 2 THEN 'images/' ELSE 'fonts/' END || n_name || '.bin' AS stored_path,
           CASE WHEN n_nationkey >= 5 THEN 'sha256:' || sha256(n_name) END AS file_hash,
           n_nationkey < 5 AS is_built_in, CASE WHEN n_regionkey > 2 THEN n_name END AS full_font_name,
           CASE WHEN n_nationkey >= 5 THEN n_name || '.bin' END AS original_filename
    FROM nation"""


def worlds(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as worlds; the last order is the last use. Assets from 18 on are no background."""
    customers = read_table(spark, folder, "customer")
    used = (
        read_table(spark, folder, "orders")
        .groupBy(F.col("o_custkey").alias("c_custkey"))
        .agg(F.max("o_orderdate").cast("timestamp").alias("_used"))
    )
    font = (
        F.when(F.col("c_mktsegment") == "AUTOMOBILE", "asset-3")
        .when(F.col("c_mktsegment") == "BUILDING", "asset-4")
        .when(F.col("c_mktsegment") == "FURNITURE", "asset-8")
        .when(F.col("c_mktsegment") == "HOUSEHOLD", "asset-13")
        .otherwise("asset-19")
    )
    return customers.join(used, "c_custkey", "left").select(
        F.concat(F.lit("world-"), "c_custkey").alias("world_id"),
        F.col("c_name").alias("display_name"),
        F.lower("c_name").alias("display_name_key"),
        F.col("c_mktsegment").alias("description"),
        F.concat(F.lit("asset-"), F.least("c_nationkey", F.lit(17))).alias("background_asset_id"),
        font.alias("font_asset_id"),
        F.coalesce("_used", default_last_used()).alias("last_used_at"),
    )


WORLDS_SQL = f"""
    SELECT 'world-' || c_custkey AS world_id, c_name AS display_name, lower(c_name) AS display_name_key,
           c_mktsegment AS description, 'asset-' || least(c_nationkey, 17) AS background_asset_id,
           CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'asset-3' WHEN 'BUILDING' THEN 'asset-4'
                WHEN 'FURNITURE' THEN 'asset-8' WHEN 'HOUSEHOLD' THEN 'asset-13' ELSE 'asset-19' END AS font_asset_id,
           coalesce(used, TIMESTAMP '{DEFAULT_LAST_USED}') AS last_used_at, c_custkey, c_acctbal, c_nationkey
    FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS used FROM orders GROUP BY 1) ON o_custkey = c_custkey"""
TIME_SQL = "strftime({}, '%Y-%m-%d %H:%M:%S')"

BLANK_SQL = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def strip_sql(expression: str) -> str:
    return f"regexp_replace(regexp_replace({expression}, '^{BLANK_SQL}+', ''), '{BLANK_SQL}+$', '')"


def violations_sql(source: str, entity: str, key: str, rules: list[tuple[str, str, str]], world: str) -> str:
    """UNION ALL of one SELECT per rule."""
    return " UNION ALL ".join(
        f"SELECT CAST({world} AS VARCHAR) AS world_id, '{entity}' AS entity, CAST({key} AS VARCHAR) AS entity_key, "
        f"'{rule}' AS rule, '{message}' AS message FROM ({source}) WHERE {bad}"
        for rule, message, bad in rules
    )
