"""Queries over batches: staging, checks, duplicates, numbering, records and publishing."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import DataFrame, functions as F

from corpuspipe import schemas
from corpuspipe.functions import names
from corpuspipe.operators import append, dedup, numbering, part_chunking, records, validation
from corpuspipe.operators.scale import checkpoint_folder, number_in_order, pinned, sized, with_position
from corpuspipe.plans import publish, roles
from corpuspipe.plans.registry import query
from corpuspipe.sources import staging
from corpuspipe.sources.tables import spread

TYPED = f"SELECT *, {roles.TYPE_SQL} AS source_file_type FROM ({{}})"
STAGED = TYPED.format(roles.STAGED_SQL)
PUBLISHED = roles.PUBLISHED_SQL
STAGED_ROWS = ["world_id", "staging_entry_id", "source_order", "source_path"]


# Staging


def _staged_by_source(spark, folder) -> DataFrame:
    return staging.stage_sources(roles.documents(spark, folder, "source").select(*STAGED_ROWS))


_STAGED_BY_SOURCE = f"""
    SELECT world_id, staging_entry_id, source_order, source_path, source_file_type,
           source_file_type IN ('txt', 'epub', 'pdf') AS is_valid,
           CASE WHEN source_file_type NOT IN ('txt', 'epub', 'pdf') THEN 'Unsupported source type.' END AS error_message
    FROM ({TYPED.format(roles.BY_SOURCE)})"""


@query("stage_sources", _STAGED_BY_SOURCE)
def stage_sources(spark, folder):
    return _staged_by_source(spark, folder)


@query(
    "unavailable_sources",
    f"""SELECT world_id, staging_entry_id, source_order, source_path, source_file_type, 'unavailable' AS reason
        FROM ({TYPED.format(roles.BY_SOURCE)}) WHERE world_id = 'src4' OR lang = 'es'""",
)
def unavailable_sources(spark, folder):
    """The listing lacks the files of src4 and of all Spanish documents."""
    listing = (
        roles.documents(spark, folder)
        .where(~((F.col("source") == "src4") | (F.col("lang") == "es")))
        .select(F.col("source_path").alias("path"))
    )
    staged = _staged_by_source(spark, folder).drop("is_valid", "error_message")
    return staging.unavailable_sources(staged, listing)


_MESSY_TYPE = "CASE WHEN source = 'src2' THEN '  ' || upper(source_file_type) || chr(9) ELSE source_file_type END"


@query(
    "route_sources",
    f"""SELECT world_id, staging_entry_id, source_file_type, parser,
               bool_and(parser IS NOT NULL) OVER (PARTITION BY world_id) AS batch_routable
        FROM (SELECT world_id, staging_entry_id, {_MESSY_TYPE} AS source_file_type,
                     CASE WHEN source_file_type IN ('txt', 'epub', 'pdf') THEN source_file_type END AS parser
              FROM ({TYPED.format(roles.BY_SOURCE)}))""",
)
def route_sources(spark, folder):
    kind = names.source_type(F.col("source_path"))
    messy = F.when(F.col("source") == "src2", F.concat(F.lit("  "), F.upper(kind), F.lit("\t"))).otherwise(kind)
    docs = roles.documents(spark, folder, "source")
    return staging.route_sources(
        docs.select("world_id", "staging_entry_id", messy.alias("source_file_type"))
    )


@query(
    "batch_startable",
    f"""SELECT world_id, bool_and(is_valid) AS can_start, count(*) AS source_count,
               count(*) FILTER (NOT is_valid) AS invalid_count FROM ({_STAGED_BY_SOURCE}) GROUP BY world_id""",
)
def batch_startable(spark, folder):
    return validation.batch_startable(_staged_by_source(spark, folder))


@query(
    "violations_types",
    roles.violations_sql(
        _STAGED_BY_SOURCE,
        "source",
        "staging_entry_id",
        [("unsupported_type", "source type must be txt, epub or pdf", "NOT is_valid")],
        "world_id",
    ),
)
def violations_types(spark, folder):
    return validation.type_violations(_staged_by_source(spark, folder))


def _entries(spark, folder) -> DataFrame:
    return roles.documents(spark, folder).select("world_id", "staging_entry_id", "source_order", "source")


@query(
    "stage_append",
    f"""WITH e AS (SELECT world_id, staging_entry_id, source_order, source FROM ({roles.BY_LANG}))
        SELECT * FROM e WHERE source < '{roles.FIRST_STAGED}'
        UNION ALL
        SELECT e.world_id, staging_entry_id, CAST(coalesce(base, 0) - 1 + row_number() OVER (
                   PARTITION BY e.world_id ORDER BY source_order) AS BIGINT), source
        FROM e LEFT JOIN (SELECT world_id, max(source_order) + 1 AS base FROM e
                          WHERE source < '{roles.FIRST_STAGED}' GROUP BY 1) b ON e.world_id = b.world_id
        WHERE source >= '{roles.FIRST_STAGED}'""",
)
def stage_append(spark, folder):
    entries = _entries(spark, folder)
    there = entries.where(F.col("source") < roles.FIRST_STAGED)
    return staging.stage_append(there, entries.where(F.col("source") >= roles.FIRST_STAGED))


@query(
    "stage_remove",
    f"""SELECT world_id, staging_entry_id, source_order FROM ({roles.BY_LANG})
        WHERE NOT (source IN ('src3', 'src4') AND n_chars < 2000)""",
)
def stage_remove(spark, folder):
    """Requests name the short documents of src3 and src4 as staged, and all of src5 as committed."""
    docs = roles.documents(spark, folder)
    asked = docs.where(
        (F.col("source").isin("src3", "src4") & (F.col("n_chars") < 2000)) | (F.col("source") == "src5")
    ).select(
        "world_id",
        F.when(F.col("source") == "src5", "committed").otherwise("staged").alias("source_kind"),
        F.col("staging_entry_id").alias("source_id"),
    )
    return staging.stage_remove(docs.select("world_id", "staging_entry_id", "source_order"), asked)


@query(
    "stage_replace",
    f"""SELECT world_id, staging_entry_id, source_order FROM ({roles.BY_LANG}) WHERE world_id NOT IN ('de', 'es')
        UNION ALL SELECT world_id, 'new-' || doc_id, source_order FROM ({roles.BY_LANG})
        WHERE world_id IN ('de', 'es') AND source < '{roles.FIRST_STAGED}'""",
)
def stage_replace(spark, folder):
    docs = roles.documents(spark, folder)
    replaced = docs.where(F.col("world_id").isin("de", "es"))
    added = replaced.where(F.col("source") < roles.FIRST_STAGED).select(
        "world_id", F.concat(F.lit("new-"), "doc_id").alias("staging_entry_id"), "source_order"
    )
    return staging.stage_replace(
        docs.select("world_id", "staging_entry_id", "source_order"), replaced.select("world_id"), added
    )


_ITEMS = f"""
    SELECT world_id, CAST(row_number() OVER (PARTITION BY world_id ORDER BY NOT first, doc_id) - 1 AS BIGINT) AS position,
           CASE WHEN source = 'src17' THEN 'other' WHEN first THEN 'committed' ELSE 'staged' END AS source_kind,
           CASE WHEN source = 'src16' THEN 'unknown-' || doc_id WHEN first THEN 'doc-' || doc_id ELSE 'entry-' || doc_id END AS source_id
    FROM (SELECT *, source < '{roles.FIRST_STAGED}' AND NOT (source = 'src1' AND world_id = 'fr') AS first FROM ({roles.BY_LANG}))"""


@query(
    "reorder_violations",
    f"""WITH items AS ({_ITEMS}),
        ranked AS (SELECT world_id, source_id, row_number() OVER (PARTITION BY world_id ORDER BY book_number) - 1 AS position
                   FROM ({PUBLISHED})),
        present AS (SELECT world_id, source_id, 'committed' AS source_kind FROM ranked
                    UNION ALL SELECT world_id, staging_entry_id, 'staged' FROM ({roles.STAGED_SQL}))
        SELECT r.world_id, 'order' AS entity, r.source_id AS entity_key, 'committed_prefix_changed' AS rule,
               'committed sources must stay first and in order' AS message
        FROM ranked r LEFT JOIN items i ON r.world_id = i.world_id AND r.position = i.position
        WHERE (i.source_kind = 'committed' AND i.source_id = r.source_id) IS NOT TRUE
        UNION ALL SELECT world_id, 'order', source_id, 'kind_invalid', 'kind must be committed or staged'
        FROM items WHERE source_kind = 'other'
        UNION ALL SELECT i.world_id, 'order', i.source_id, 'source_unknown', 'the request names an unknown source'
        FROM items i LEFT JOIN present p USING (world_id, source_kind, source_id)
        WHERE i.source_kind <> 'other' AND NOT EXISTS (SELECT 1 FROM present q WHERE q.world_id = i.world_id
              AND q.source_kind = i.source_kind AND q.source_id = i.source_id)
        UNION ALL SELECT p.world_id, 'order', p.source_id, 'source_missing', 'the request misses a source'
        FROM present p WHERE NOT EXISTS (SELECT 1 FROM items i WHERE p.world_id = i.world_id
              AND p.source_kind = i.source_kind AND p.source_id = i.source_id)""",
)
def reorder_violations(spark, folder):
    """An order request with unknown ids (src16), a wrong kind (src17) and, in fr, src1 moved to the end."""
    docs = roles.documents(spark, folder)
    source = F.col("source")
    first = (source < roles.FIRST_STAGED) & ~((source == "src1") & (F.col("world_id") == "fr"))
    # Documents are numbered by the pair (not first, document); the pair is folded into one number.
    asked = docs.select(
        "world_id",
        "source_order",
        F.when(source == "src17", "other").when(first, "committed").otherwise("staged").alias("source_kind"),
        F.when(source == "src16", F.concat(F.lit("unknown-"), "doc_id"))
        .when(first, F.concat(F.lit("doc-"), "doc_id"))
        .otherwise(F.concat(F.lit("entry-"), "doc_id"))
        .alias("source_id"),
        F.when(first, F.col("source_order")).otherwise(F.col("source_order") + (1 << 50)).alias("_order"),
    )
    items = (
        number_in_order(asked, ["world_id"], "_order", "_place")
        .withColumn("position", F.col("_place") - 1)
        .drop("_order", "_place", "source_order")
    )
    return staging.reorder_violations(
        roles.published(spark, folder), roles.staged(spark, folder), items
    )


# Row checks with planted defects


def _bad_chunks(spark, folder) -> DataFrame:
    chunks = roles.published_chunks(spark, folder)
    world, number = F.col("world_id"), F.col("chunk_number")
    return chunks.select(
        "world_id",
        F.when((world == "es") & (number == 1), " ").otherwise(F.col("chunk_id")).alias("chunk_id"),
        F.when(world == "xx", "").otherwise(F.col("source_id")).alias("source_id"),
        F.when(world == "fr", 0).otherwise(F.col("book_number")).alias("book_number"),
        F.when((world == "de") & (number == 2), 0).otherwise(number).alias("chunk_number"),
        F.when((world == "en") & (number == 3), "  ").otherwise(F.col("chunk_text")).alias("chunk_text"),
        F.when((world == "en") & (number == 4), None).otherwise(F.col("overlap_text")).alias("overlap_text"),
        F.when((world == "en") & (number == 5), -1)
        .when((world == "en") & (number == 6), None)
        .otherwise(F.col("character_start_offset"))
        .alias("character_start_offset"),
        F.when((world == "de") & (number == 3), F.col("character_start_offset") - 1)
        .otherwise(F.col("character_end_offset"))
        .alias("character_end_offset"),
    )


@query(
    "violations_chunks",
    f"WITH RECURSIVE {roles.PUBLISHED_CHUNKS_SQL}, c AS (SELECT *, source_id || '-' || chunk_number AS chunk_id FROM cut_chunks) "
    + roles.violations_sql(
        "SELECT *, CASE WHEN world_id = 'es' AND chunk_number = 1 THEN ' ' ELSE chunk_id END AS k FROM c",
        "chunk",
        "k",
        [
            ("chunk_id_blank", "chunk_id must not be blank", "world_id = 'es' AND chunk_number = 1"),
            ("book_number_minimum", "book_number must be at least 1", "world_id = 'fr'"),
            ("chunk_number_minimum", "chunk_number must be at least 1", "world_id = 'de' AND chunk_number = 2"),
            ("chunk_text_blank", "chunk_text must not be blank", "world_id = 'en' AND chunk_number = 3"),
            ("overlap_null", "overlap_text must be set", "world_id = 'en' AND chunk_number = 4"),
            ("start_negative", "character_start_offset must not be negative", "world_id = 'en' AND chunk_number = 5"),
            ("end_before_start", "character_end_offset must not precede the start", "world_id = 'de' AND chunk_number = 3"),
        ],
        "world_id",
    ),
)
def violations_chunks(spark, folder):
    return validation.chunk_violations(_bad_chunks(spark, folder))


@query(
    "violations_sources",
    roles.violations_sql(
        f"SELECT *, CASE WHEN world_id = 'es' THEN '' ELSE source_id END AS k FROM ({PUBLISHED})",
        "source",
        "k",
        [
            ("source_id_blank", "source_id must not be blank", "world_id = 'es'"),
            ("original_filename_blank", "original_filename must not be blank", "world_id = 'fr'"),
            ("source_hash_blank", "source_hash must not be blank", "world_id = 'de'"),
            ("book_number_minimum", "book_number must be at least 1", "world_id = 'de'"),
        ],
        "world_id",
    )
    + f""" UNION ALL SELECT world_id, 'staged', CASE WHEN source = 'src15' THEN ' ' WHEN source = 'src16' THEN 'same' ELSE staging_entry_id END,
              'staging_entry_id_blank', 'staging_entry_id must not be blank' FROM ({roles.STAGED_SQL}) WHERE source = 'src15'
          UNION ALL SELECT world_id, 'staged', 'same', 'staging_entry_id_repeated', 'staging_entry_id must be unique'
          FROM ({roles.STAGED_SQL}) WHERE source = 'src16' GROUP BY world_id HAVING count(*) > 1
          UNION ALL SELECT s.world_id, 'destination', sha256(p), 'destination_repeated', 'stored path must be unique in the batch'
          FROM (SELECT world_id, 'sources/' || source_hash AS p, count(*) AS n FROM ({roles.STAGED_SQL}) GROUP BY 1, 2) s WHERE n > 1
          UNION ALL SELECT DISTINCT s.world_id, 'destination', sha256('sources/' || s.source_hash), 'destination_exists', 'stored path is already taken'
          FROM ({roles.STAGED_SQL}) s SEMI JOIN ({PUBLISHED}) c ON s.world_id = c.world_id AND s.source_hash = c.source_hash""",
)
def violations_sources(spark, folder):
    """Source rows with blank fields, staged ids that repeat, and stored paths (here named by content) that clash."""
    world = F.col("world_id")
    docs = roles.hashed(spark, folder)
    rows = roles.as_published(docs)
    bad = rows.withColumns(
        {
            "source_id": F.when(world == "es", "").otherwise(F.col("source_id")),
            "original_filename": F.when(world == "fr", "\t").otherwise(F.col("original_filename")),
            "source_hash": F.when(world == "de", None).otherwise(F.col("source_hash")),
            "book_number": F.when(world == "de", -F.col("book_number")).otherwise(F.col("book_number")),
        }
    )
    staged = roles.only_staged(docs).select("world_id", "staging_entry_id", "source", "source_hash")
    renamed = staged.withColumn(
        "staging_entry_id",
        F.when(F.col("source") == "src15", " ")
        .when(F.col("source") == "src16", "same")
        .otherwise(F.col("staging_entry_id")),
    )
    by_content = F.concat(F.lit("sources/"), "source_hash")
    return (
        validation.source_violations(bad)
        .unionByName(validation.staged_id_violations(renamed))
        .unionByName(
            validation.destination_violations(
                staged.select("world_id", by_content.alias("stored_path")),
                rows.select("world_id", by_content.alias("stored_path")),
            )
        )
    )


@query(
    "violations_settings",
    roles.violations_sql(
        f"SELECT *, CAST(substr(world_id, 4) AS INTEGER) AS n FROM ({roles.SETTINGS_SQL})",
        "settings",
        "world_id",
        [
            ("chunk_size_minimum", "chunk_size must be at least 1", "n = 1"),
            ("lookback_minimum", "max_lookback_size must not be negative", "n = 2"),
            ("lookback_below_chunk_size", "max_lookback_size must be less than chunk_size", "n IN (1, 4)"),
            ("overlap_minimum", "overlap_size must not be negative", "n = 5"),
            ("version_blank", "splitter_version must not be blank", "n = 6"),
            ("lock_missing", "is_locked must be set", "n = 7"),
            ("one_row_per_world", "a world must have exactly one settings row", "n > 15"),
        ],
        "world_id",
    ),
)
def violations_settings(spark, folder):
    number = F.substring("world_id", 4, 10).cast("int")
    rows = roles.settings(spark, folder)
    bad = rows.withColumns(
        {
            "chunk_size": F.when(number == 1, 0).otherwise(F.col("chunk_size")),
            "max_lookback_size": F.when(number == 2, -1)
            .when(number == 4, F.col("chunk_size"))
            .otherwise(F.col("max_lookback_size")),
            "overlap_size": F.when(number == 5, -3).otherwise(F.col("overlap_size")),
            "splitter_version": F.when(number == 6, " ").otherwise(F.col("splitter_version")),
            "is_locked": F.when(number == 7, None).otherwise(F.col("is_locked")),
        }
    )
    return validation.settings_violations(bad.unionByName(rows.where(number > 15)))


# Duplicates and conflicts


@query(
    "batch_duplicates",
    f"""SELECT world_id, staging_entry_id, source_order, source_hash, first_staging_entry_id FROM (
            SELECT *, first_value(staging_entry_id) OVER w AS first_staging_entry_id, row_number() OVER w AS n
            FROM ({roles.BY_LANG}) WINDOW w AS (PARTITION BY world_id, source_hash ORDER BY source_order))
        WHERE n > 1""",
)
def batch_duplicates(spark, folder):
    return dedup.duplicates_in_batch(roles.hashed(spark, folder))


@query(
    "repeated_positions",
    f"""WITH RECURSIVE {roles.SPLIT_SQL}
        SELECT world_id, CAST(CASE WHEN source = 'src15' THEN 1 ELSE source_order + 2 END AS BIGINT) AS book_number,
               chunk_number, count(*) AS row_count
        FROM cut_chunks GROUP BY ALL HAVING count(*) > 1""",
)
def repeated_positions(spark, folder):
    """Chunks whose (book, chunk) position repeats because all of src15 took book number 1."""
    number = F.when(F.col("source") == "src15", 1).otherwise(F.col("source_order") + 2)
    chunks = roles.split_chunks(spark, folder).select("world_id", number.alias("book_number"), "chunk_number")
    return validation.batch_duplicates(chunks, ["world_id", "book_number", "chunk_number"])


@query(
    "duplicate_vs_committed",
    f"""SELECT s.world_id, staging_entry_id, source_order, s.source_hash,
               first.book_number AS committed_book_number, first.source_id AS committed_source_id
        FROM ({roles.STAGED_SQL}) s JOIN (
            SELECT world_id, source_hash, min({{'book_number': book_number, 'source_id': source_id}}) AS first
            FROM ({PUBLISHED}) GROUP BY 1, 2) c ON s.world_id = c.world_id AND s.source_hash = c.source_hash""",
)
def duplicate_vs_committed(spark, folder):
    docs = roles.hashed(spark, folder)
    return dedup.duplicates_of_committed(roles.only_staged(docs), roles.as_published(docs))


def _new_sources(spark, folder) -> DataFrame:
    """Staged sources that took the ids (src15) or book numbers (src16) of published neighbours."""
    docs = roles.staged(spark, folder)
    step = F.when(F.col("source").isin("src15", "src16"), F.col("doc_id") - 1).otherwise(F.col("doc_id"))
    return docs.select(
        "world_id",
        F.when(F.col("source") == "src15", F.concat(F.lit("doc-"), step))
        .otherwise(F.concat(F.lit("new-"), "doc_id"))
        .alias("source_id"),
        (step + 1).alias("book_number"),
    )


_NEW_SOURCES = f"""
    SELECT world_id, CASE WHEN source = 'src15' THEN 'doc-' || (doc_id - 1) ELSE 'new-' || doc_id END AS source_id,
           CAST(CASE WHEN source IN ('src15', 'src16') THEN doc_id ELSE doc_id + 1 END AS BIGINT) AS book_number
    FROM ({roles.STAGED_SQL})"""


@query(
    "source_conflicts",
    f"""SELECT n.*, CASE WHEN EXISTS (SELECT 1 FROM ({PUBLISHED}) p WHERE p.world_id = n.world_id AND p.source_id = n.source_id)
                    THEN 'id' ELSE 'position' END AS conflict
        FROM ({_NEW_SOURCES}) n WHERE EXISTS (SELECT 1 FROM ({PUBLISHED}) p WHERE p.world_id = n.world_id
            AND (p.source_id = n.source_id OR p.book_number = n.book_number))""",
)
def source_conflicts(spark, folder):
    return dedup.source_conflicts(_new_sources(spark, folder), roles.published(spark, folder))


def _new_chunks(chunks: DataFrame) -> DataFrame:
    """New chunks: those of en reuse published ids, those of fr only positions, the rest are free."""
    world = F.col("world_id")
    return chunks.select(
        "world_id",
        F.when(world == "en", F.col("chunk_id")).otherwise(F.concat(F.lit("n-"), "chunk_id")).alias("chunk_id"),
        F.when(world.isin("en", "fr"), F.col("book_number")).otherwise(-F.col("book_number")).alias("book_number"),
        "chunk_number",
    )


@query(
    "chunk_conflicts",
    f"""WITH RECURSIVE {roles.PUBLISHED_CHUNKS_SQL}
        SELECT world_id, CASE WHEN world_id = 'en' THEN '' ELSE 'n-' END || source_id || '-' || chunk_number AS chunk_id,
               book_number, chunk_number, CASE WHEN world_id = 'en' THEN 'id' ELSE 'position' END AS conflict
        FROM cut_chunks WHERE world_id IN ('en', 'fr')""",
)
def chunk_conflicts(spark, folder):
    published = roles.published_chunk_keys(spark, folder)
    return dedup.chunk_conflicts(_new_chunks(published), published)


# Numbering and records


@query(
    "next_book_number",
    f"SELECT world_id, CAST(max(book_number) + 1 AS BIGINT) AS next_book_number FROM ({roles.ALL_PUBLISHED_SQL}) GROUP BY 1",
)
def next_book_number(spark, folder):
    return numbering.next_book_numbers(roles.all_published(spark, folder))


_NUMBERED = f"""
    SELECT s.*, CAST(coalesce(top, 0) + row_number() OVER (PARTITION BY s.world_id ORDER BY source_order) AS BIGINT) AS book_number,
           sha256(s.world_id || '|' || source_hash) AS source_id,
           'sources/' || sha256(s.world_id || '|' || source_hash) || regexp_replace(lower(regexp_extract(source_path, '(\\.[^./]+)?$', 0)), '^$', '') AS stored_path
    FROM ({STAGED}) s LEFT JOIN (SELECT world_id, max(book_number) AS top FROM ({PUBLISHED}) GROUP BY 1) p
    ON s.world_id = p.world_id"""


# All documents as the first batch of their worlds.
_FIRST_BATCH = f"""
    SELECT *, CAST(row_number() OVER (PARTITION BY world_id ORDER BY source_order) AS BIGINT) AS book_number,
           sha256(world_id || '|' || source_hash) AS source_id,
           'sources/' || sha256(world_id || '|' || source_hash) || regexp_replace(lower(regexp_extract(source_path, '(\\.[^./]+)?$', 0)), '^$', '') AS stored_path
    FROM ({TYPED.format(roles.BY_LANG)})"""


def _numbered(spark, folder) -> DataFrame:
    staged = roles.staged(spark, folder).select("world_id", "staging_entry_id", "source_order")
    return numbering.assign_book_numbers(staged, roles.published(spark, folder))


@query("assign_book_numbers", f"SELECT world_id, staging_entry_id, source_order, book_number FROM ({_NUMBERED})")
def assign_book_numbers(spark, folder):
    return _numbered(spark, folder)


@query(
    "number_conflicts",
    f"""SELECT p.world_id, source_id, book_number, first_number, last_number FROM ({PUBLISHED}) p JOIN (
            SELECT world_id, min(book_number) AS first_number, max(book_number) AS last_number
            FROM ({_NEW_SOURCES}) GROUP BY 1) r ON p.world_id = r.world_id
        WHERE book_number BETWEEN first_number AND last_number""",
)
def number_conflicts(spark, folder):
    return numbering.number_conflicts(_new_sources(spark, folder), roles.published(spark, folder))


def _prepared(spark, folder) -> DataFrame:
    staged = roles.documents(spark, folder).withColumn(
        "source_file_type", names.source_type(F.col("source_path"))
    )
    return records.prepare_sources(
        staged.select(
            "world_id", "staging_entry_id", "source_order", "source_path", "source_file_type", "source_hash", "source"
        )
    )


@query(
    "stored_paths",
    f"""SELECT world_id, staging_entry_id, source_id, regexp_extract(source_path, '[^/]*$') AS original_filename, stored_path
        FROM ({_FIRST_BATCH})""",
)
def stored_paths(spark, folder):
    return _prepared(spark, folder).select(
        "world_id", "staging_entry_id", "source_id", "original_filename", "stored_path"
    )


_RECORDS = f"""
    SELECT world_id, source_id, regexp_extract(source_path, '[^/]*$') AS original_filename, stored_path, source_file_type,
           source_hash, book_number, TIMESTAMP '2026-01-02 03:04:05' AS committed_at FROM ({{}})"""
_MOMENT = "2026-01-02 03:04:05"


@query("committed_source_records", _RECORDS.format(_NUMBERED))
def committed_source_records(spark, folder):
    return records.source_records(
        _prepared(spark, folder), _numbered(spark, folder), F.to_timestamp(F.lit(_MOMENT))
    )


_CHUNK_RECORDS = """
    SELECT c.world_id, sha256(source_id || '|' || chunk_number) AS chunk_id, source_id, book_number, chunk_number,
           chunk_text, overlap_text, character_start_offset, character_end_offset
    FROM cut_chunks c JOIN ({}) o ON c.world_id = o.world_id AND c.staging_entry_id = o.staging_entry_id"""


@query("chunk_records", f"WITH RECURSIVE {roles.SPLIT_SQL} " + _CHUNK_RECORDS.format(_FIRST_BATCH))
def chunk_records(spark, folder):
    """Chunk rows of all documents as the first batch of their worlds."""
    prepared = pinned(_prepared(spark, folder))
    staged = prepared.select("world_id", "staging_entry_id", "source_order")
    none = roles.all_published(spark, folder).where(F.lit(False))
    numbers = numbering.assign_book_numbers(staged, none).drop("source_order")
    texts = spread(roles.documents(spark, folder), "staging_entry_id")
    return records.chunk_records(texts, prepared.join(numbers, records.STAGED_KEY), roles.SMALL)


def _defective_chunks(spark, folder) -> DataFrame:
    """Split chunks; those of src15 and src16 name an unknown source."""
    lost = F.when(F.col("source").isin("src15", "src16"), F.lit("lost-")).otherwise(F.lit(""))
    return roles.split_chunks(spark, folder).withColumn("staging_entry_id", F.concat(lost, "staging_entry_id"))


@query(
    "orphan_chunks",
    f"""WITH RECURSIVE {roles.SPLIT_SQL}
        SELECT world_id, 'lost-' || staging_entry_id AS staging_entry_id, chunk_number FROM cut_chunks
        WHERE source IN ('src15', 'src16')""",
)
def orphan_chunks(spark, folder):
    return records.orphan_chunks(_defective_chunks(spark, folder), _prepared(spark, folder))


@query(
    "sources_without_chunks",
    f"SELECT world_id, staging_entry_id FROM ({roles.BY_LANG}) WHERE source IN ('src15', 'src16')",
)
def sources_without_chunks(spark, folder):
    return records.sources_without_chunks(_prepared(spark, folder), _defective_chunks(spark, folder))


@query(
    "commit_gate",
    f"""WITH RECURSIVE {roles.SPLIT_SQL},
        s AS (SELECT world_id, count(*) AS source_count, count(*) FILTER (source IN ('src15', 'src16')) AS chunkless_count
              FROM ({roles.BY_LANG}) GROUP BY 1),
        c AS (SELECT world_id, count(*) AS chunk_count, count(*) FILTER (source IN ('src15', 'src16')) AS orphan_count
              FROM cut_chunks GROUP BY 1)
        SELECT s.world_id, source_count, coalesce(chunk_count, 0) AS chunk_count, coalesce(orphan_count, 0) AS orphan_count,
               chunkless_count, coalesce(chunk_count, 0) > 0 AND coalesce(orphan_count, 0) = 0 AND chunkless_count = 0 AS may_commit
        FROM s LEFT JOIN c ON s.world_id = c.world_id""",
)
def commit_gate(spark, folder):
    return records.commit_gate(_prepared(spark, folder), _defective_chunks(spark, folder))


@query(
    "split_batch",
    f"""WITH RECURSIVE {roles.SPLIT_SQL}
        SELECT world_id, 'attempt-' || world_id AS attempt_id, staging_entry_id, source_order, chunk_number, chunk_text,
               overlap_text, character_start_offset, character_end_offset, '1' AS splitter_version FROM cut_chunks""",
)
def split_batch(spark, folder):
    return roles.split_chunks(spark, folder).select(
        "world_id",
        F.concat(F.lit("attempt-"), "world_id").alias("attempt_id"),
        "staging_entry_id",
        "source_order",
        "chunk_number",
        "chunk_text",
        "overlap_text",
        "character_start_offset",
        "character_end_offset",
        F.lit("1").alias("splitter_version"),
    )


@query(
    "split_summary",
    f"""WITH RECURSIVE {roles.SPLIT_SQL}
        SELECT s.world_id, s.staging_entry_id, s.source_order, count(c.chunk_number) AS chunk_count
        FROM ({roles.BY_LANG}) s LEFT JOIN (SELECT * FROM cut_chunks WHERE source NOT IN ('src15', 'src16')) c
        ON s.world_id = c.world_id AND s.staging_entry_id = c.staging_entry_id GROUP BY 1, 2, 3""",
)
def split_summary(spark, folder):
    """Chunk counts per source; those of src15 and src16 lost theirs."""
    return records.split_summary(roles.documents(spark, folder), _defective_chunks(spark, folder))


@query(
    "split_totals",
    f"""WITH RECURSIVE {roles.SPLIT_SQL}
        SELECT world_id, count(DISTINCT staging_entry_id) AS source_count, count(*) AS chunk_count FROM cut_chunks GROUP BY 1""",
)
def split_totals(spark, folder):
    summary = records.split_summary(roles.documents(spark, folder), roles.split_chunks(spark, folder))
    return records.batch_totals(summary).select(
        "world_id", "source_count", F.col("chunk_count").cast("long").alias("chunk_count")
    )


@query(
    "chunks_of_parts",
    f"""WITH RECURSIVE {roles.SPLIT_SQL}
        SELECT world_id, staging_entry_id, CAST(chunk_number AS BIGINT) AS chunk_number, chunk_text, overlap_text,
               CAST(character_start_offset AS BIGINT) AS character_start_offset, CAST(character_end_offset AS BIGINT) AS character_end_offset
        FROM cut_chunks""",
)
def chunks_of_parts(spark, folder):
    """The chunks of all documents, each of which arrives as parts of 900 characters, like a source too large for one value."""
    docs = roles.documents(spark, folder).select("world_id", "staging_entry_id", "parsed_text")
    starts = F.sequence(F.lit(0), F.greatest(F.char_length("parsed_text") - 1, F.lit(0)), F.lit(900))
    parts = docs.select("*", F.explode(starts).alias("part")).withColumn("parsed_text", F.expr("substring(parsed_text, part + 1, 900)"))
    return part_chunking.chunks_of_parts(parts, ["world_id", "staging_entry_id"], roles.SMALL, segment_chars=1_500)


# Listings of sources and chunks


@query(
    "list_sources",
    f"""SELECT world_id, source_id, book_number, row_number() OVER (ORDER BY world_id, book_number, source_id) AS position
        FROM ({roles.ALL_PUBLISHED_SQL})""",
)
def list_sources(spark, folder):
    rows = roles.all_published(spark, folder).select("world_id", "source_id", "book_number")
    return with_position(rows, "world_id", "book_number", "source_id")


@query(
    "list_chunks",
    f"""WITH RECURSIVE {roles.PUBLISHED_CHUNKS_SQL}
        SELECT world_id, source_id || '-' || chunk_number AS chunk_id, book_number, chunk_number,
               row_number() OVER (ORDER BY world_id, book_number, chunk_number, source_id || '-' || chunk_number) AS position
        FROM cut_chunks""",
)
def list_chunks(spark, folder):
    rows = roles.published_chunk_keys(spark, folder).drop("source_id")
    return with_position(rows, "world_id", "book_number", "chunk_number", "chunk_id")


@query(
    "list_split_chunks",
    f"""WITH RECURSIVE {roles.SPLIT_SQL}
        SELECT world_id, source_order, chunk_number, character_start_offset, character_end_offset,
               row_number() OVER (ORDER BY world_id, source_order, chunk_number) AS position FROM cut_chunks""",
)
def list_split_chunks(spark, folder):
    rows = roles.split_chunks(spark, folder).select(
        "world_id", "source_order", "chunk_number", "character_start_offset", "character_end_offset"
    )
    return with_position(pinned(rows), "world_id", "source_order", "chunk_number")


# Appending and publishing: the resulting rows; the write protocol itself is tested on folders


# The world src1 takes published ids, src2 published numbers, src6 published paths; src3 and src4 repeat ids and numbers in
# the batch, src5 has blank file names. All other worlds may be appended.
_FAR = 1 << 40


def _source_batch(spark, folder) -> tuple[DataFrame, DataFrame]:
    """All documents as published sources, a world for each ``source``, and once more as a batch that arrives."""
    docs = roles.documents(spark, folder, "source")
    published = roles.as_source_rows(docs.drop("parsed_text"))
    world, number = F.col("source"), F.col("doc_id")
    new = docs.select(
        "world_id",
        F.concat(
            F.when(world == "src1", "doc-").otherwise("new-"), F.when(world == "src3", number % 7).otherwise(number)
        ).alias("source_id"),
        F.when((world == "src5") & (number % 2 == 0), " ").otherwise(names.base_name(F.col("source_path"))).alias("original_filename"),
        F.concat(F.when(world == "src6", "sources/doc-").otherwise("sources/new-"), number).alias("stored_path"),
        names.source_type(F.col("source_path")).alias("source_file_type"),
        "source_hash",
        F.when(world == "src2", number + 1).when(world == "src4", _FAR + number % 7).otherwise(_FAR + number).alias("book_number"),
        F.to_timestamp(F.lit(_MOMENT)).alias("committed_at"),
    )
    return published, new


_SOURCE_BATCH = f"""
    SELECT source AS world_id,
           CASE WHEN source = 'src1' THEN 'doc-' ELSE 'new-' END || CASE WHEN source = 'src3' THEN doc_id % 7 ELSE doc_id END AS source_id,
           CASE WHEN source = 'src5' AND doc_id % 2 = 0 THEN ' ' ELSE 'x' END AS original_filename,
           CASE WHEN source = 'src6' THEN 'sources/doc-' ELSE 'sources/new-' END || doc_id AS stored_path,
           CAST(CASE WHEN source = 'src2' THEN doc_id + 1 WHEN source = 'src4' THEN {_FAR} + doc_id % 7 ELSE {_FAR} + doc_id END AS BIGINT) AS book_number
    FROM documents"""
_SOURCE_TABLE = "SELECT source AS world_id, 'doc-' || doc_id AS source_id, 'sources/doc-' || doc_id AS stored_path, CAST(doc_id + 1 AS BIGINT) AS book_number FROM documents"


def _key_rules_sql(new: str, table: str, kinds: list[tuple[str, str, str, str]]) -> str:
    """UNION ALL of the repeated and the taken keys of each (kind, entity, expression, shown key)."""
    return " UNION ALL ".join(
        f"""SELECT world_id, '{entity}' AS entity, {shown} AS entity_key, '{kind}_repeated' AS rule, 'the key must be unique in the batch' AS message
            FROM (SELECT world_id, {key} AS k FROM ({new}) GROUP BY 1, 2 HAVING count(*) > 1)
            UNION ALL SELECT world_id, '{entity}', {shown}, '{kind}_taken', 'the table holds the key already'
            FROM (SELECT DISTINCT world_id, {key} AS k FROM ({new}) INTERSECT SELECT DISTINCT world_id, {key} FROM ({table}))"""
        for kind, entity, key, shown in kinds
    )


_SOURCE_BATCH_VIOLATIONS = (
    _key_rules_sql(
        _SOURCE_BATCH,
        _SOURCE_TABLE,
        [
            ("source_id", "source", "source_id", "k"),
            ("book_number", "source", "book_number", "CAST(k AS VARCHAR)"),
            ("stored_path", "destination", "stored_path", "sha256(k)"),
        ],
    )
    + f""" UNION ALL SELECT world_id, 'source', source_id, 'original_filename_blank', 'original_filename must not be blank'
           FROM ({_SOURCE_BATCH}) WHERE original_filename = ' '"""
)


@query(
    "append_sources",
    f"""WITH bad AS (SELECT DISTINCT world_id FROM ({_SOURCE_BATCH_VIOLATIONS}))
        SELECT world_id, source_id, book_number FROM ({_SOURCE_TABLE})
        UNION ALL SELECT world_id, source_id, book_number FROM ({_SOURCE_BATCH}) WHERE world_id NOT IN (SELECT world_id FROM bad)""",
)
def append_sources(spark, folder):
    """The sources table after a batch: worlds that break a rule add nothing."""
    published, new = _source_batch(spark, folder)
    return append.append_sources(new, published).rows.select("world_id", "source_id", "book_number")


@query("append_source_violations", _SOURCE_BATCH_VIOLATIONS)
def append_source_violations(spark, folder):
    published, new = _source_batch(spark, folder)
    return append.append_sources(new, published).violations


def _chunk_batch(spark, folder) -> tuple[DataFrame, DataFrame]:
    """The chunks of all documents as published, and again as a batch: en reuses ids, fr positions, de repeats positions."""
    world = F.col("world_id")
    published = pinned(roles.published_chunks(spark, folder).select(*[field.name for field in schemas.CHUNKS]))
    new = published.withColumns(
        {
            "chunk_id": F.when(world == "en", F.col("chunk_id")).otherwise(F.concat(F.lit("n-"), "chunk_id")),
            "book_number": F.when(world == "fr", F.col("book_number")).otherwise(F.col("book_number") + _FAR),
            "chunk_number": F.when(world == "de", (F.col("chunk_number") + 1) / 2).otherwise(F.col("chunk_number")).cast("int"),
        }
    )
    return published, new


_CHUNK_TABLE = "SELECT world_id, source_id || '-' || chunk_number AS chunk_id, book_number, chunk_number, chunk_text FROM cut_chunks"
_CHUNK_BATCH = f"""
    SELECT world_id, CASE WHEN world_id = 'en' THEN '' ELSE 'n-' END || source_id || '-' || chunk_number AS chunk_id,
           CAST(CASE WHEN world_id = 'fr' THEN book_number ELSE book_number + {_FAR} END AS BIGINT) AS book_number,
           CAST(CASE WHEN world_id = 'de' THEN (chunk_number + 1) // 2 ELSE chunk_number END AS INTEGER) AS chunk_number, chunk_text
    FROM cut_chunks"""
_CHUNK_BATCH_VIOLATIONS = (
    _key_rules_sql(
        _CHUNK_BATCH,
        _CHUNK_TABLE,
        [
            ("chunk_id", "chunk", "chunk_id", "k"),
            ("chunk_place", "chunk", "book_number || '/' || chunk_number", "k"),
        ],
    )
    + f""" UNION ALL SELECT world_id, 'chunk', chunk_id, 'chunk_text_blank', 'chunk_text must not be blank'
           FROM ({_CHUNK_BATCH}) WHERE {roles.strip_sql('chunk_text')} = ''"""
)


@query(
    "append_chunks",
    f"""WITH RECURSIVE {roles.PUBLISHED_CHUNKS_SQL}, bad AS (SELECT DISTINCT world_id FROM ({_CHUNK_BATCH_VIOLATIONS}))
        SELECT world_id, chunk_id, book_number, chunk_number FROM ({_CHUNK_TABLE})
        UNION ALL SELECT world_id, chunk_id, book_number, chunk_number FROM ({_CHUNK_BATCH}) WHERE world_id NOT IN (SELECT world_id FROM bad)""",
)
def append_chunks(spark, folder):
    """The chunks table after a batch: worlds that break a rule add nothing."""
    published, new = _chunk_batch(spark, folder)
    return append.append_chunks(new, published).rows.select("world_id", "chunk_id", "book_number", "chunk_number")


@query("append_chunk_violations", f"WITH RECURSIVE {roles.PUBLISHED_CHUNKS_SQL} {_CHUNK_BATCH_VIOLATIONS}")
def append_chunk_violations(spark, folder):
    published, new = _chunk_batch(spark, folder)
    return append.append_chunks(new, published).violations


_FIRST_COPIES = """
    SELECT * EXCLUDE (copy) FROM (SELECT *, row_number() OVER (PARTITION BY world_id, source_hash ORDER BY source_order) AS copy
        FROM ({})) WHERE copy = 1"""
_NEW_WORLD = f"""
    SELECT *, CAST(row_number() OVER (PARTITION BY world_id ORDER BY source_order) AS BIGINT) AS book_number,
           sha256(world_id || '|' || source_hash) AS source_id FROM ({_FIRST_COPIES.format(
               "SELECT * FROM (" + roles.BY_SOURCE + ") WHERE source NOT IN ('src7', 'src8')")})"""


@query(
    "publish_new_world",
    "WITH RECURSIVE "
    + roles.chunks_sql(
        f"""SELECT d.world_id, d.source_id, d.book_number, d.parsed_text, s.chunk_size, s.max_lookback_size, s.overlap_size
            FROM ({_NEW_WORLD}) d JOIN ({roles.SETTINGS_SQL}) s ON d.world_id = s.world_id""",
        "world_id, source_id, book_number",
        "chunk_size",
        "max_lookback_size",
        "overlap_size",
    )
    + """ SELECT world_id, sha256(source_id || '|' || chunk_number) AS chunk_id, source_id, book_number, chunk_number,
                 chunk_text, overlap_text, character_start_offset, character_end_offset FROM cut_chunks""",
)
def publish_new_world(spark, folder):
    """Chunk rows of a first batch with one world per ``source``; src7 and src8 are blocked by their types."""
    parsed = roles.documents(spark, folder, "source").withColumn(
        "source_file_type", names.source_type(F.col("source_path"))
    )
    settings = roles.settings(spark, folder)
    docs = roles.hashed(spark, folder, "source").withColumn(
        "source_file_type", names.source_type(F.col("source_path"))
    )
    none = roles.as_published(docs).where(F.lit(False))
    blocked = sized(publish.blocked_worlds(publish.batch_violations(parsed, settings, none, "skip")))
    numbered = publish.plan_sources(docs, none, blocked, "skip")
    return publish.plan_chunks(spread(parsed, "staging_entry_id"), numbered, settings)


def _published(spark, folder):
    """A first batch of all documents, published as a job would: one world per ``source``, duplicates skipped."""
    root = f"{checkpoint_folder(spark)}/corpus-{uuid.uuid4().hex}"
    parsed = roles.documents(spark, folder, "source").select(
        "world_id", "staging_entry_id", "source_order", "source_path",
        names.source_type(F.col("source_path")).alias("source_file_type"), "source_hash", "parsed_text",
    )
    moment = datetime.datetime.fromisoformat(_MOMENT)
    counts = publish.publish_new_worlds(
        spark, root, "first", parsed, roles.settings(spark, folder), moment, on_duplicate="skip"
    )
    return root, counts


@query(
    "publish_counts",
    "WITH RECURSIVE "
    + roles.chunks_sql(
        f"""SELECT d.world_id, d.source_id, d.book_number, d.parsed_text, s.chunk_size, s.max_lookback_size, s.overlap_size
            FROM ({_NEW_WORLD}) d JOIN ({roles.SETTINGS_SQL}) s ON d.world_id = s.world_id""",
        "world_id, source_id, book_number",
        "chunk_size",
        "max_lookback_size",
        "overlap_size",
    )
    + " SELECT world_id, count(DISTINCT source_id) AS source_count, count(*) AS chunk_count FROM cut_chunks GROUP BY world_id",
)
def publish_counts(spark, folder):
    """Sources and chunks of each world of a published batch."""
    return _published(spark, folder)[1]


@query(
    "publish_settings",
    f"""SELECT world_id, chunk_size, max_lookback_size, overlap_size, '1' AS splitter_version, true AS is_locked
        FROM ({roles.SETTINGS_SQL}) WHERE world_id NOT IN ('src7', 'src8')""",
)
def publish_settings(spark, folder):
    """Settings as a published batch locks them: always with the current version, whatever the caller gave."""
    return publish.read_published(spark, _published(spark, folder)[0], "splitter_settings")


@query(
    "publish_violations",
    f"""WITH d AS (SELECT *, row_number() OVER (PARTITION BY world_id, source_hash ORDER BY source_order) AS copy FROM ({roles.BY_SOURCE}))
        SELECT world_id, 'source' AS entity, staging_entry_id AS entity_key, 'unsupported_type' AS rule,
               'source type must be txt, epub or pdf' AS message FROM d WHERE source IN ('src7', 'src8')
        UNION ALL SELECT world_id, 'source', staging_entry_id, 'duplicate_skipped',
               'source content occurs already in this world' FROM d WHERE copy > 1""",
)
def publish_violations(spark, folder):
    """What the gates say of every source of a first batch that skips duplicates: none is left out silently."""
    parsed = roles.documents(spark, folder, "source").withColumn("source_file_type", names.source_type(F.col("source_path")))
    none = roles.as_published(roles.hashed(spark, folder, "source")).where(F.lit(False))
    found = publish.batch_violations(parsed, roles.settings(spark, folder), none, "skip")
    return found.where(F.col("entity") == "source")


_APPENDED = f"""
    SELECT f.*, CAST(coalesce(top, 0) + row_number() OVER (PARTITION BY f.world_id ORDER BY source_order) AS BIGINT) AS book_number,
           sha256(f.world_id || '|' || source_hash) AS source_id,
           'sources/' || sha256(f.world_id || '|' || source_hash) || lower(regexp_extract(source_path, '(\\.[^./]+)?$', 0)) AS stored_path
    FROM ({_FIRST_COPIES.format(STAGED)}) f
    LEFT JOIN (SELECT world_id, max(book_number) AS top FROM ({PUBLISHED}) GROUP BY 1) p ON f.world_id = p.world_id
    WHERE NOT EXISTS (SELECT 1 FROM ({PUBLISHED}) c WHERE c.world_id = f.world_id AND c.source_hash = f.source_hash)"""


@query("publish_append", _RECORDS.format(_APPENDED))
def publish_append(spark, folder):
    """Source rows an appending batch adds when duplicates are skipped."""
    docs = roles.hashed(spark, folder)
    staged = roles.only_staged(docs).withColumn("source_file_type", names.source_type(F.col("source_path")))
    none = staged.select("world_id").where(F.lit(False))
    numbered = publish.plan_sources(staged, roles.as_published(docs), none, "skip")
    return publish.source_rows(numbered, F.to_timestamp(F.lit(_MOMENT)))
