"""Validation: every broken rule becomes one row of the violations table, for the whole table at once.

The publish step blocks a world's batch when any row exists for it. Rows carry ids and rule names only,
never texts or paths.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpuspipe.functions import names, text

MAX_UPLOAD_BYTES = 3 * 1024 * 1024  # fixed value


def _broken(rule: str, message: str, bad: Column) -> Column:
    return F.when(
        F.coalesce(bad, F.lit(True)),
        F.struct(F.lit(rule).alias("rule"), F.lit(message).alias("message")),
    )


def violations(
    df: DataFrame, entity: str, key: Column, rules: list[tuple[str, str, Column]], world: Column
) -> DataFrame:
    """One pass over ``df``; a rule whose condition is null counts as broken."""
    found = F.array_compact(F.array(*[_broken(*rule) for rule in rules]))
    return df.select(
        world.cast("string").alias("world_id"),
        F.lit(entity).alias("entity"),
        key.cast("string").alias("entity_key"),
        F.inline(found),
    )


def _blank(name: str) -> Column:
    return ~text.is_usable(F.col(name))


def _blank_rule(name: str, rule: str | None = None) -> tuple[str, str, Column]:
    return (rule or f"{name}_blank", f"{name} must not be blank", _blank(name))


def type_violations(staged: DataFrame) -> DataFrame:
    kind = text.normalize_type(F.col("source_file_type"))
    return violations(
        staged,
        "source",
        F.col("staging_entry_id"),
        [("unsupported_type", "source type must be txt, epub or pdf", ~kind.isin(*names.SUPPORTED_TYPES))],
        F.col("world_id"),
    )


SETTING_RULES = (
    ("chunk_size_minimum", "chunk_size must be at least 1", lambda: F.col("chunk_size") < 1),
    ("lookback_minimum", "max_lookback_size must not be negative", lambda: F.col("max_lookback_size") < 0),
    (
        "lookback_below_chunk_size",
        "max_lookback_size must be less than chunk_size",
        lambda: F.col("max_lookback_size") >= F.col("chunk_size"),
    ),
    ("overlap_minimum", "overlap_size must not be negative", lambda: F.col("overlap_size") < 0),
    ("version_blank", "splitter_version must not be blank", lambda: _blank("splitter_version")),
)


def settings_violations(settings: DataFrame) -> DataFrame:
    """Range rules per row, and exactly one row with a lock flag per world."""
    rules = [(rule, message, bad()) for rule, message, bad in SETTING_RULES]
    rules.append(("lock_missing", "is_locked must be set", F.col("is_locked").isNull()))
    per_row = violations(settings, "settings", F.col("world_id"), rules, F.col("world_id"))
    repeated = settings.groupBy("world_id").agg(F.count(F.lit(1)).alias("_rows"))
    per_world = violations(
        repeated,
        "settings",
        F.col("world_id"),
        [("one_row_per_world", "a world must have exactly one settings row", F.col("_rows") > 1)],
        F.col("world_id"),
    )
    return per_row.unionByName(per_world)


def chunk_violations(chunks: DataFrame) -> DataFrame:
    start, end = F.col("character_start_offset"), F.col("character_end_offset")
    unset = F.lit(False)
    return violations(
        chunks,
        "chunk",
        F.col("chunk_id"),
        [
            _blank_rule("chunk_id"),
            _blank_rule("source_id"),
            ("book_number_minimum", "book_number must be at least 1", F.col("book_number") < 1),
            ("chunk_number_minimum", "chunk_number must be at least 1", F.col("chunk_number") < 1),
            _blank_rule("chunk_text"),
            ("overlap_null", "overlap_text must be set", F.col("overlap_text").isNull()),
            ("start_negative", "character_start_offset must not be negative", F.coalesce(start < 0, unset)),
            ("end_negative", "character_end_offset must not be negative", F.coalesce(end < 0, unset)),
            ("end_before_start", "character_end_offset must not precede the start", F.coalesce(end < start, unset)),
        ],
        F.col("world_id"),
    )


def source_violations(sources: DataFrame) -> DataFrame:
    return violations(
        sources,
        "source",
        F.col("source_id"),
        [
            _blank_rule("source_id"),
            _blank_rule("original_filename"),
            _blank_rule("stored_path"),
            _blank_rule("source_file_type"),
            _blank_rule("source_hash"),
            ("book_number_minimum", "book_number must be at least 1", F.col("book_number") < 1),
            ("committed_at_missing", "committed_at must be set", F.col("committed_at").isNull()),
        ],
        F.col("world_id"),
    )


def staged_id_violations(staged: DataFrame) -> DataFrame:
    """Staged ids must be non-blank and unique in their world."""
    blank = violations(
        staged,
        "staged",
        F.col("staging_entry_id"),
        [_blank_rule("staging_entry_id")],
        F.col("world_id"),
    )
    repeated = (
        staged.where(text.is_usable(F.col("staging_entry_id")))
        .groupBy("world_id", "staging_entry_id")
        .agg(F.count(F.lit(1)).alias("_rows"))
    )
    return blank.unionByName(
        violations(
            repeated,
            "staged",
            F.col("staging_entry_id"),
            [("staging_entry_id_repeated", "staging_entry_id must be unique", F.col("_rows") > 1)],
            F.col("world_id"),
        )
    )


def destination_violations(records: DataFrame, sources: DataFrame) -> DataFrame:
    """A stored path must be unique in the batch and not taken by a published source."""
    paths = records.groupBy("world_id", "stored_path").agg(F.count(F.lit(1)).alias("_rows"))
    taken = (
        sources.groupBy("world_id", "stored_path").agg(F.lit(True).alias("_taken"))
    )
    return violations(
        paths.join(taken, ["world_id", "stored_path"], "left"),
        "destination",
        F.sha2("stored_path", 256),
        [
            ("destination_repeated", "stored path must be unique in the batch", F.col("_rows") > 1),
            ("destination_exists", "stored path is already taken", F.coalesce("_taken", F.lit(False))),
        ],
        F.col("world_id"),
    )


def world_violations(worlds: DataFrame) -> DataFrame:
    return violations(
        worlds,
        "world",
        F.col("world_id"),
        [_blank_rule("display_name"), _blank_rule("background_asset_id"), _blank_rule("font_asset_id")],
        F.col("world_id"),
    )


def asset_violations(assets: DataFrame) -> DataFrame:
    """The id may be null (one is made then), but not blank."""
    return violations(
        assets,
        "asset",
        F.col("asset_id"),
        [
            ("asset_type_unknown", "asset_type must be image or font", ~F.col("asset_type").isin("image", "font")),
            _blank_rule("display_name"),
            _blank_rule("stored_path"),
            ("asset_id_blank", "asset_id must not be blank", F.col("asset_id").isNotNull() & _blank("asset_id")),
            (
                "file_hash_missing",
                "an uploaded asset needs a file hash",
                ~F.col("is_built_in") & _blank("file_hash"),
            ),
        ],
        F.lit(None),
    )


def normalize_world_id(value: Column) -> Column:
    """Canonical lower-case UUID, or null. Braces, ``urn:uuid:`` (in lower case) and missing dashes are accepted."""
    digits = value
    for part in ("urn:", "uuid:"):
        digits = F.replace(digits, F.lit(part), F.lit(""))
    digits = F.lower(F.replace(F.regexp_replace(digits, r"\A[{}]+|[{}]+\z", ""), F.lit("-"), F.lit("")))
    pieces = [F.substring(digits, start, length) for start, length in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.when(digits.rlike(r"\A[0-9a-f]{32}\z"), F.concat_ws("-", *pieces))


def is_unsafe_path(path: Column) -> Column:
    """Absolute, or with a part that leaves its folder."""
    return F.startswith(path, F.lit("/")) | F.array_contains(F.split(path, "/"), "..")


def upload_violations(files: DataFrame) -> DataFrame:
    """Suffix, size and leading bytes of uploaded files (``asset_type, original_filename, length, content``)."""
    kind = names.suffix(F.col("original_filename"))
    image = F.col("asset_type") == "image"
    lead = F.hex(F.substring(F.col("content"), 1, 12))
    # Allowed suffixes and the leading bytes of their formats.
    signatures = {
        ".jpg": "^FFD8FF",
        ".jpeg": "^FFD8FF",
        ".png": "^89504E470D0A1A0A",
        ".webp": "^52494646.{8}57454250",
        ".otf": "^(4F54544F|00010000|74727565)",
        ".ttf": "^(00010000|74727565|4F54544F)",
        ".woff": "^774F4646",
        ".woff2": "^774F4632",
    }
    matches = reduce(
        lambda found, item: found.when(kind == item[0], lead.rlike(item[1])),
        list(signatures.items())[1:],
        F.when(kind == ".jpg", lead.rlike(signatures[".jpg"])),
    ).otherwise(False)
    allowed = F.when(image, kind.isin(".jpg", ".jpeg", ".png", ".webp")).otherwise(
        kind.isin(".otf", ".ttf", ".woff", ".woff2")
    )
    return violations(
        files,
        "upload",
        F.col("upload_id"),
        [
            ("suffix_not_allowed", "file suffix is not allowed for this asset type", ~allowed),
            ("too_large", "file is larger than 3 MiB", F.col("length") > MAX_UPLOAD_BYTES),
            ("content_mismatch", "file content does not match its suffix", allowed & ~matches),
        ],
        F.lit(None),
    )


def batch_startable(staged: DataFrame) -> DataFrame:
    """Per world: may the batch start (every source valid), and how many are valid or not."""
    return staged.groupBy("world_id").agg(
        F.bool_and("is_valid").alias("can_start"),
        F.count(F.lit(1)).alias("source_count"),
        F.count_if(~F.col("is_valid")).alias("invalid_count"),
    )


def batch_duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Key values that occur more than once."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count")).where(F.col("row_count") > 1)


def chunk_coverage_check(chunks: DataFrame, sources: DataFrame) -> DataFrame:
    """Sources whose chunks do not start at 0, touch each other and end at the text's end.

    The window holds the chunks of one text, which came out of one row.
    """
    by_number = Window.partitionBy("world_id", "source_id").orderBy("chunk_number")
    steps = chunks.select(
        "world_id",
        "source_id",
        "chunk_number",
        "character_start_offset",
        "character_end_offset",
        F.coalesce(F.lag("character_end_offset").over(by_number), F.lit(0)).alias("_expected"),
        F.row_number().over(by_number).alias("_place"),
    )
    checked = steps.groupBy("world_id", "source_id").agg(
        F.count_if(F.col("character_start_offset") != F.col("_expected")).alias("broken_joins"),
        F.count_if(F.col("chunk_number") != F.col("_place")).alias("number_gaps"),
        F.count_if(F.col("character_end_offset") <= F.col("character_start_offset")).alias("empty_chunks"),
        F.max("character_end_offset").alias("covered"),
    )
    expected = sources.select("world_id", "source_id", F.col("text_length").cast("int").alias("text_length"))
    return (
        expected.join(checked, ["world_id", "source_id"], "left")
        .select(
            "world_id",
            "source_id",
            "text_length",
            F.coalesce("covered", F.lit(0)).cast("int").alias("covered"),
            F.coalesce("broken_joins", F.lit(0)).alias("broken_joins"),
            F.coalesce("number_gaps", F.lit(0)).alias("number_gaps"),
            F.coalesce("empty_chunks", F.lit(0)).alias("empty_chunks"),
        )
        .withColumn(
            "is_exact",
            (F.col("covered") == F.col("text_length"))
            & (F.col("broken_joins") == 0)
            & (F.col("number_gaps") == 0)
            & (F.col("empty_chunks") == 0),
        )
    )
