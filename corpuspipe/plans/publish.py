"""Publishing a batch: everything or nothing becomes visible.

Layout under ``root``: ``<table>/batch_id=<id>/...`` and one manifest file per batch. Data is written first;
the manifest file is written last and is the moment the batch appears. Readers only see batches that
have one, so a job that dies earlier leaves nothing visible, and running the same batch again writes the
same folders.
"""

from __future__ import annotations

import datetime
import json
import re

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from corpuspipe import schemas
from corpuspipe.functions import names, text
from corpuspipe.operators import append, catalog, dedup, numbering, records, validation
from corpuspipe.operators.chunking import SPLITTER_VERSION, split_texts
from corpuspipe.operators.scale import sized

_MANIFEST = StructType(
    [
        StructField("batch_id", StringType()),
        StructField("published_at", StringType()),
        StructField("has_settings", BooleanType()),
        StructField("has_worlds", BooleanType()),
    ]
)
_TABLES = {
    "sources": schemas.SOURCES,
    "chunks": schemas.CHUNKS,
    "splitter_settings": schemas.SPLITTER_SETTINGS,
    "worlds": schemas.WORLDS,
    "violations": schemas.VIOLATIONS,
}

# Tables that only some batches write, with the manifest column that says so.
_FLAGS = {"splitter_settings": "has_settings", "worlds": "has_worlds"}


# Rules that are told but stop nothing: the row itself is left out.
NOT_BLOCKING = ("duplicate_skipped",)


class BatchRefused(ValueError):
    """Nothing of the batch may be published; ``read_violations`` tells why."""


class BatchConflict(RuntimeError):
    """Ids or book numbers of the batch are taken: another writer was faster. Running the batch again helps."""


def _folder(root: str, table: str, batch_id: str) -> str:
    return f"{root}/{table}/batch_id={batch_id}"


def start_corpus(spark: SparkSession, root: str) -> None:
    """Make the manifest folder of a new corpus; does nothing where there is one."""
    _manifest_line(spark, None, None).write.mode("ignore").text(f"{root}/manifest/start")


def read_manifest(spark: SparkSession, root: str) -> DataFrame:
    rows = spark.read.schema(_MANIFEST).json(f"{root}/manifest/*")
    return rows.where(F.col("batch_id").isNotNull())


def is_published(spark: SparkSession, root: str, batch_id: str) -> bool:
    return not read_manifest(spark, root).where(F.col("batch_id") == batch_id).isEmpty()


def read_published(spark: SparkSession, root: str, table: str) -> DataFrame:
    """Rows of a table from published batches only.

    Only the folders the manifest names are listed, so a batch that is being written, or died, is never
    touched. The names are control data: one short row per batch.
    """
    schema = _TABLES[table]
    manifest = read_manifest(spark, root)
    if table in _FLAGS:
        manifest = manifest.where(_FLAGS[table])
    folders = [_folder(root, table, row.batch_id) for row in manifest.select("batch_id").collect()]
    if not folders:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).option("basePath", f"{root}/{table}").parquet(*folders)
    return rows.select(*[field.name for field in schema])


def read_violations(spark: SparkSession, root: str) -> DataFrame:
    """Broken rules of every batch that was tried, published or refused, with its ``batch_id``.

    Also names what was left out without stopping a batch (``NOT_BLOCKING``).
    """
    schema = StructType([*schemas.VIOLATIONS.fields, StructField("batch_id", StringType())])
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/violations")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{root}/violations")


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _write(df: DataFrame, root: str, table: str, batch_id: str, by_world: bool = False) -> DataFrame:
    """Overwrite this batch's folder of a table and read it back, which also cuts the lineage."""
    path = _folder(root, table, batch_id)
    if by_world:
        df.write.mode("overwrite").partitionBy("world_id").parquet(path)
    else:
        df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _duplicate_violations(staged: DataFrame, sources: DataFrame, rule: str) -> DataFrame:
    found = (
        dedup.duplicates_in_batch(staged)
        .select("world_id", "staging_entry_id")
        .unionByName(dedup.duplicates_of_committed(staged, sources).select("world_id", "staging_entry_id"))
        .distinct()
    )
    return found.select(
        "world_id",
        F.lit("source").alias("entity"),
        F.col("staging_entry_id").alias("entity_key"),
        F.lit(rule).alias("rule"),
        F.lit("source content occurs already in this world").alias("message"),
    )


def batch_violations(
    parsed: DataFrame, settings: DataFrame, sources: DataFrame, on_duplicate: str
) -> DataFrame:
    """Every broken rule that stops a world's batch before splitting, and every duplicate that is left out;
    texts are read in one pass."""
    kind = text.normalize_type(F.col("source_file_type"))
    found = (
        validation.violations(
            parsed,
            "source",
            F.col("staging_entry_id"),
            [
                ("unsupported_type", "source type must be txt, epub or pdf", ~kind.isin(*names.SUPPORTED_TYPES)),
                (
                    "text_unusable",
                    "parsed text must hold a visible character",
                    ~text.is_usable(F.col("parsed_text")),
                ),
            ],
            F.col("world_id"),
        )
        .unionByName(validation.staged_id_violations(parsed))
        .unionByName(validation.settings_violations(settings))
    )
    rule = "duplicate_source" if on_duplicate == "block" else "duplicate_skipped"
    return found.unionByName(_duplicate_violations(parsed, sources, rule))


def blocked_worlds(found: DataFrame) -> DataFrame:
    """Worlds that a violation stops."""
    return found.where(~F.col("rule").isin(*NOT_BLOCKING)).select("world_id").distinct()


def plan_sources(
    staged: DataFrame, sources: DataFrame, blocked: DataFrame, on_duplicate: str
) -> DataFrame:
    """The staged sources that are published, with id, stored path and number; narrow columns only."""
    live = staged.join(blocked, "world_id", "left_anti")
    if on_duplicate == "skip":
        live = dedup.without_duplicates(live, sources)
    return numbering.assign_book_numbers(records.prepare_sources(live), sources)


def source_rows(numbered: DataFrame, committed_at: Column) -> DataFrame:
    return numbered.withColumn("committed_at", committed_at).select(
        *[field.name for field in schemas.SOURCES]
    )


def plan_chunks(parsed: DataFrame, numbered: DataFrame, settings: DataFrame) -> DataFrame:
    """Chunk rows of the batch.

    Texts meet their ids and numbers before they are cut, and are gathered by world before that too: so
    only texts are moved, never chunks with their overlaps. Rebalancing splits a world that is too large
    for one task.
    """
    key = ["world_id", "staging_entry_id"]
    owners = numbered.select(*key, "source_id", "book_number")
    sizes = sized(settings.select("world_id", "chunk_size", "max_lookback_size", "overlap_size"))
    texts = parsed.select(*key, "parsed_text").join(owners, key).drop("staging_entry_id")
    return split_texts(texts.join(sizes, "world_id").hint("rebalance", "world_id")).select(
        "world_id",
        records.chunk_id(F.col("source_id"), F.col("chunk_number")).alias("chunk_id"),
        "source_id",
        "book_number",
        "chunk_number",
        "chunk_text",
        "overlap_text",
        "character_start_offset",
        "character_end_offset",
    )


# A batch of at most so many worlds reads only their published sources by a pushed-down filter.
MAX_LISTED_WORLDS = 1000


def _of_batch_worlds(published: DataFrame, parsed: DataFrame) -> DataFrame:
    """Published rows of the worlds a batch touches; source files are sorted by world for this."""
    worlds = parsed.select("world_id").distinct()
    listed = [row.world_id for row in worlds.limit(MAX_LISTED_WORLDS + 1).collect()]
    if len(listed) <= MAX_LISTED_WORLDS:
        return published.where(F.col("world_id").isin(listed))
    return published.join(worlds, "world_id", "left_semi")


def _write_rows(
    root: str,
    batch_id: str,
    parsed: DataFrame,
    settings: DataFrame,
    published: DataFrame,
    found: DataFrame,
    moment: Column,
    on_duplicate: str,
) -> tuple[DataFrame, DataFrame, int]:
    """Write source and chunk rows of the worlds without violations; also counts blank chunks.

    Ids and numbers are checked against the published ones before any text is cut.
    """
    blocked = sized(blocked_worlds(found))
    plan = plan_sources(parsed.drop("parsed_text"), published, blocked, on_duplicate)
    numbered = _write(plan, root, "numbered", batch_id)
    if numbered.isEmpty():
        raise BatchRefused("every world of the batch is blocked or holds no new source")
    refused = _write(_source_gate(source_rows(numbered, moment), published), root, "source_gate", batch_id)
    if not refused.where(F.col("rule").isin("source_id_taken", "book_number_taken")).isEmpty():
        raise BatchConflict("source ids or book numbers are already taken")
    if not refused.isEmpty():
        refused.write.mode("append").parquet(_folder(root, "violations", batch_id))
        numbered = _without_worlds(root, batch_id, numbered, refused, "numbered_sound")
    rows = source_rows(numbered, moment).sortWithinPartitions("world_id", "book_number")
    _write(rows, root, "sources", batch_id)
    watch = Observation()
    rows = plan_chunks(parsed, numbered, settings).observe(
        watch, F.count_if(~text.is_usable(F.col("chunk_text"))).alias("blank")
    )
    chunks = _write(rows, root, "chunks", batch_id, by_world=True)
    return numbered, chunks, watch.get["blank"]


def _source_gate(rows: DataFrame, published: DataFrame) -> DataFrame:
    """Broken rules of the source rows a batch is about to publish: fields, and keys that repeat or are taken."""
    book = append.ledger(append.source_entries(rows, "new_rows"), append.source_entries(published, "held_rows"))
    return append.source_rules(rows).unionByName(append.key_violations(book))


def _without_worlds(root: str, batch_id: str, numbered: DataFrame, late: DataFrame, step: str) -> DataFrame:
    worlds = late.select("world_id").distinct()
    left = _write(numbered.join(worlds, "world_id", "left_anti"), root, step, batch_id)
    if left.isEmpty():
        raise BatchRefused("every world of the batch is blocked")
    return left


def _withdraw(
    root: str, batch_id: str, numbered: DataFrame, late: DataFrame, moment: Column
) -> DataFrame:
    """Take the worlds of ``late`` out of the batch that was just written.

    Numbers are per world and chunks lie by world, so the other worlds' rows stay as they are: the folders of
    these worlds go, and only the narrow rows are written again.
    """
    spark = numbered.sparkSession
    worlds = late.select("world_id").distinct()
    escape = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    for row in worlds.toLocalIterator():
        _delete(spark, f"{_folder(root, 'chunks', batch_id)}/world_id={escape(row.world_id)}")
    left = _without_worlds(root, batch_id, numbered, late, "numbered_left")
    rows = source_rows(left, moment).sortWithinPartitions("world_id", "book_number")
    _write(rows, root, "sources", batch_id)
    return left


def _publish(
    spark: SparkSession,
    root: str,
    batch_id: str,
    parsed: DataFrame,
    settings: DataFrame,
    committed_at: datetime.datetime,
    on_duplicate: str,
    extra_violations: DataFrame,
    lock: bool,
    worlds: DataFrame | None = None,
) -> DataFrame:
    if not re.fullmatch(r"[A-Za-z0-9._-]+", batch_id):
        raise ValueError("batch_id must be letters, digits, dots, dashes and underscores")
    if on_duplicate not in ("block", "skip"):
        raise ValueError("on_duplicate must be 'block' or 'skip'")
    if is_published(spark, root, batch_id):
        return batch_summary(spark, root, batch_id)
    moment = names.utc_moment(committed_at)

    # The parsed texts feed the gates and the split, so they are written once, not parsed twice.
    parsed = _write(parsed, root, "staging", batch_id)
    published = _of_batch_worlds(read_published(spark, root, "sources"), parsed)
    found = batch_violations(parsed, settings, published, on_duplicate).unionByName(extra_violations)
    found = _write(found, root, "violations", batch_id)

    numbered, chunks, blank = _write_rows(root, batch_id, parsed, settings, published, found, moment, on_duplicate)
    late = append.gate_violations(numbered, chunks)
    if blank:
        # Blank chunks were counted while writing, so only a batch that has one pays for finding it.
        columns = [field.name for field in schemas.CHUNKS]
        late = late.unionByName(validation.chunk_violations(chunks.where(~text.is_usable(F.col("chunk_text"))).select(*columns)))
    late = _write(late, root, "late_violations", batch_id)
    if not late.isEmpty():
        late.write.mode("append").parquet(_folder(root, "violations", batch_id))
        numbered = _withdraw(root, batch_id, numbered, late, moment)
    if lock:
        locked = (
            settings.join(numbered.select("world_id").distinct(), "world_id", "left_semi")
            .withColumn("splitter_version", F.lit(SPLITTER_VERSION))
            .withColumn("is_locked", F.lit(True))
        )
        _write(locked.select(*[f.name for f in schemas.SPLITTER_SETTINGS]), root, "splitter_settings", batch_id)
    if worlds is not None:
        fresh = worlds.join(numbered.select("world_id").distinct(), "world_id", "left_semi")
        fresh = fresh.withColumn("last_used_at", moment).select(*[f.name for f in schemas.WORLDS])
        _write(fresh, root, "worlds", batch_id)
    _write_manifest(spark, root, batch_id, committed_at, lock, worlds is not None)
    for step in ("staging", "numbered", "numbered_sound", "numbered_left", "source_gate", "late_violations"):
        _delete(spark, _folder(root, step, batch_id))
    return batch_summary(spark, root, batch_id)


def _write_manifest(
    spark: SparkSession, root: str, batch_id: str, published_at: datetime.datetime, *flags: bool
) -> None:
    """One short file, renamed into place by Spark's committer: the visibility point."""
    line = _manifest_line(spark, batch_id, published_at.isoformat(sep=" "), *flags)
    line.write.mode("overwrite").text(f"{root}/manifest/{batch_id}")


def _manifest_line(
    spark: SparkSession, batch_id: str | None, published_at: str | None, *flags: bool
) -> DataFrame:
    row = json.dumps({"batch_id": batch_id, "published_at": published_at, **dict(zip(_FLAGS.values(), flags))})
    return spark.range(1, numPartitions=1).select(F.lit(row).alias("value"))


def batch_summary(spark: SparkSession, root: str, batch_id: str) -> DataFrame:
    """Source and chunk counts per world of a batch; reads key columns only."""
    sources = spark.read.schema(schemas.SOURCES).parquet(_folder(root, "sources", batch_id))
    chunks = spark.read.parquet(_folder(root, "chunks", batch_id))
    counted = chunks.groupBy(F.col("world_id").cast("string").alias("world_id")).agg(
        F.count(F.lit(1)).alias("chunk_count")
    )
    return (
        sources.groupBy("world_id").agg(F.count(F.lit(1)).alias("source_count")).join(counted, "world_id", "left")
    )


def _world_violations(rows: DataFrame, rule: str, message: str) -> DataFrame:
    return rows.select(
        "world_id",
        F.lit("world").alias("entity"),
        F.col("world_id").alias("entity_key"),
        F.lit(rule).alias("rule"),
        F.lit(message).alias("message"),
    )


def _catalog_violations(staged_worlds: DataFrame, worlds: DataFrame, published: DataFrame) -> DataFrame:
    """Catalog rows that are missing or blank, and names that a published or an earlier new world holds."""
    keys = worlds.select("world_id", "display_name_key")
    in_batch = catalog.name_conflicts(keys, keys).where(F.col("holder_id") < F.col("world_id"))
    taken = catalog.name_conflicts(published, keys).unionByName(in_batch).select("world_id").distinct()
    return (
        validation.world_violations(worlds)
        .unionByName(_world_violations(taken, "name_taken", "another world has this display name"))
        .unionByName(
            _world_violations(
                staged_worlds.join(worlds.select("world_id").distinct(), "world_id", "left_anti"),
                "world_row_missing",
                "the world has no catalog row",
            )
        )
    )


def current_worlds(spark: SparkSession, root: str) -> DataFrame:
    """Published catalog rows; publishing a batch counts as use of its worlds."""
    usage = read_published(spark, root, "sources").select("world_id", F.col("committed_at").alias("used_at"))
    return catalog.mark_used(read_published(spark, root, "worlds"), usage)


def publish_new_worlds(
    spark: SparkSession,
    root: str,
    batch_id: str,
    parsed: DataFrame,
    settings: DataFrame,
    committed_at: datetime.datetime,
    on_duplicate: str = "block",
    known_violations: DataFrame | None = None,
    worlds: DataFrame | None = None,
) -> DataFrame:
    """First batch of worlds that do not exist yet; returns counts per published world.

    ``parsed`` holds ``world_id, staging_entry_id, source_order, source_path, source_file_type, source_hash,
    parsed_text``. Settings are stored locked and with the current splitter version. With ``worlds``
    (``world_id, display_name, description, background_asset_id, font_asset_id``) the catalog rows are
    published too; a blank or taken name stops its world.
    """
    start_corpus(spark, root)
    existing = read_published(spark, root, "splitter_settings").select("world_id").distinct()
    staged_worlds = parsed.select("world_id").distinct()
    wrong = _world_violations(
        staged_worlds.join(existing, "world_id", "left_semi"), "world_exists", "the world is published already"
    ).unionByName(
        _world_violations(
            staged_worlds.join(settings.select("world_id").distinct(), "world_id", "left_anti"),
            "settings_missing",
            "the world has no splitter settings",
        )
    )
    if known_violations is not None:
        wrong = wrong.unionByName(known_violations)
    if worlds is not None:
        worlds = worlds.withColumn("display_name_key", text.name_key(F.col("display_name")))
        wrong = wrong.unionByName(_catalog_violations(staged_worlds, worlds, read_published(spark, root, "worlds")))
    return _publish(spark, root, batch_id, parsed, settings, committed_at, on_duplicate, wrong, True, worlds)


def publish_append(
    spark: SparkSession,
    root: str,
    batch_id: str,
    parsed: DataFrame,
    committed_at: datetime.datetime,
    on_duplicate: str = "block",
    known_violations: DataFrame | None = None,
) -> DataFrame:
    """Append a batch to published worlds, cut with their locked settings and numbered after their last book.

    The time of last use is a separate later step (``catalog.mark_used``); its failure undoes nothing.
    """
    settings = read_published(spark, root, "splitter_settings")
    wrong = _world_violations(
        parsed.select("world_id").distinct().join(settings.select("world_id"), "world_id", "left_anti"),
        "world_missing",
        "the world is not published",
    )
    if known_violations is not None:
        wrong = wrong.unionByName(known_violations)
    mine = settings.join(parsed.select("world_id").distinct(), "world_id", "left_semi")
    return _publish(spark, root, batch_id, parsed, mine, committed_at, on_duplicate, wrong, False)
