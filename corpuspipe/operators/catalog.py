"""The catalog: worlds, splitter settings and shared assets.

Parquet has no row-level update, so every changing operator returns the new state of its table. Joins
carry no hints (the adaptive planner broadcasts a side once its real size is known) unless a side was
counted first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpuspipe import schemas
from corpuspipe.functions import names, text
from corpuspipe.operators.chunking import (
    DEFAULT_CHUNK_SIZE,
    DEFAULT_MAX_LOOKBACK,
    DEFAULT_OVERLAP,
    SPLITTER_VERSION,
)
from corpuspipe.operators.scale import sized

# Ids of the default background and font, the default time of last use (the epoch), and the
# built-in assets.
DEFAULT_BACKGROUND_ID = "builtin-image-main-world"
DEFAULT_FONT_ID = "builtin-font-inter"
DEFAULT_LAST_USED = "1970-01-01 00:00:00"
BUILT_IN_IMAGES = (
    ("builtin-image-dark-academy", "Dark Academy"),
    ("builtin-image-desert-ruins", "Desert Ruins"),
    ("builtin-image-fantasy-valley", "Fantasy Valley"),
    ("builtin-image-main-world", "Main World Image"),
    ("builtin-image-moonlit-shrine", "Moonlit Shrine"),
    ("builtin-image-neon-city", "Neon City"),
    ("builtin-image-ruined-battlefield", "Ruined Battlefield"),
    ("builtin-image-sky-islands", "Sky Islands"),
    ("builtin-image-snowfield-aurora", "Snowfield Aurora"),
)
BUILT_IN_IMAGE_PATH = "app/assets/images/{name}.png"
BUILT_IN_FONTS = (
    ("builtin-font-almendra-bold", "Almendra Bold", "app/assets/fonts/Almendra/Almendra-Bold.ttf"),
    ("builtin-font-cinzel-bold", "Cinzel Bold", "app/assets/fonts/Cinzel/Cinzel-Bold.ttf"),
    (
        "builtin-font-im-fell-english-sc-regular",
        "IM Fell English SC Regular",
        "app/assets/fonts/IM_Fell_English_SC/IMFellEnglishSC-Regular.ttf",
    ),
    ("builtin-font-inter", "Inter", "app/assets/fonts/Inter/Inter-VariableFont_opsz,wght.ttf"),
    ("builtin-font-orbitron-bold", "Orbitron Bold", "app/assets/fonts/Orbitron/Orbitron-Bold.ttf"),
)

# Columns of the listing orders; each ends with a unique key.
WORLD_ORDER = ("display_name_key", "world_id")
SOURCE_ORDER = ("book_number", "source_id")
CHUNK_ORDER = ("book_number", "chunk_number", "chunk_id")
SPLIT_CHUNK_ORDER = ("source_order", "chunk_number")


def built_in_assets(spark: SparkSession) -> DataFrame:
    rows = [
        (asset_id, "image", name, BUILT_IN_IMAGE_PATH.format(name=name), None, True, None, None)
        for asset_id, name in BUILT_IN_IMAGES
    ] + [
        (asset_id, "font", name, path, None, True, name, None) for asset_id, name, path in BUILT_IN_FONTS
    ]
    return spark.createDataFrame(rows, schemas.ASSETS)


# Listings


def recent_order() -> list[Column]:
    return [F.desc("last_used_at"), F.asc("display_name_key"), F.asc("world_id")]


def asset_order() -> list[Column]:
    return [text.ascii_lower(F.col("display_name")), F.col("asset_id")]


def list_worlds(worlds: DataFrame) -> DataFrame:
    return worlds.orderBy(*WORLD_ORDER)


def recent_worlds(worlds: DataFrame) -> DataFrame:
    return worlds.orderBy(*recent_order())


def latest_world(worlds: DataFrame) -> DataFrame:
    """The world used last; a top-1 that keeps one candidate per task, not a full sort."""
    return recent_worlds(worlds).limit(1)


def list_assets(assets: DataFrame) -> DataFrame:
    return assets.orderBy(*asset_order())


def list_sources(sources: DataFrame) -> DataFrame:
    return sources.orderBy("world_id", *SOURCE_ORDER)


def list_chunks(chunks: DataFrame) -> DataFrame:
    return chunks.orderBy("world_id", *CHUNK_ORDER)


def lookup(table: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Rows of ``table`` whose key is wanted; unknown keys give no row."""
    return table.join(wanted.select(key).distinct(), key, "left_semi")


def default_asset(assets: DataFrame, asset_id: str, asset_type: str) -> DataFrame:
    """The built-in default, only if it is built in and of the expected type."""
    return assets.where(
        (F.col("asset_id") == asset_id) & F.col("is_built_in") & (F.col("asset_type") == asset_type)
    )


def world_cards(worlds: DataFrame) -> DataFrame:
    return worlds.select(
        "world_id",
        "display_name",
        "description",
        names.asset_url(F.col("background_asset_id")).alias("background_url"),
        names.asset_url(F.col("font_asset_id")).alias("font_url"),
        names.utc_text(F.col("last_used_at")).alias("last_used_at"),
    )


def world_detail(worlds: DataFrame, settings: DataFrame, sources: DataFrame) -> DataFrame:
    """World, settings and sources, one row per source (a world of any size stays many rows).

    ``is_readable`` tells whether settings exist and are locked; a world without sources has one row.
    """
    head = worlds.select("world_id", "display_name", "background_asset_id", "font_asset_id").join(
        settings, "world_id", "left"
    )
    listed = sources.select("world_id", "source_id", "original_filename", "source_file_type", "book_number")
    filled = listed.join(head, "world_id")
    empty = head.join(listed.select("world_id").distinct(), "world_id", "left_anti")
    return filled.unionByName(empty, allowMissingColumns=True).withColumn(
        "is_readable", F.coalesce("is_locked", F.lit(False))
    )


# Worlds


def name_conflicts(worlds: DataFrame, wanted: DataFrame) -> DataFrame:
    """Wanted names (``world_id, display_name_key``) that another world holds."""
    holders = worlds.groupBy("display_name_key").agg(
        F.min("world_id").alias("_low"), F.max("world_id").alias("_high")
    )
    holder = F.when(F.col("_low") != F.col("world_id"), F.col("_low")).otherwise(F.col("_high"))
    return (
        wanted.join(holders, "display_name_key")
        .withColumn("holder_id", holder)
        .where(F.col("holder_id") != F.col("world_id"))
        .drop("_low", "_high")
    )


def _valid_world() -> Column:
    return (
        text.is_usable(F.col("display_name"))
        & text.is_usable(F.col("background_asset_id"))
        & text.is_usable(F.col("font_asset_id"))
    )


def create_outcomes(worlds: DataFrame, requests: DataFrame) -> DataFrame:
    """What becomes of every request for a new world: its columns, ``display_name_key`` and ``outcome``.

    ``invalid``: a name or asset is blank. ``world_exists``: the id is taken, by a world or by an earlier valid
    request. ``name_taken``: a world has the name, or an earlier valid request asked for it. Else ``created``.
    Earlier is by ``request_order``, then id. First requests come from aggregates, so equal ids and names are
    reduced before the shuffle however often they occur.
    """
    asked = requests.withColumn("display_name_key", text.name_key(F.col("display_name")))
    place = F.struct("request_order", "world_id")
    valid = asked.where(_valid_world())
    by_id = valid.groupBy("world_id").agg(F.min("request_order").alias("_first_order"))
    known = worlds.select("world_id").distinct().withColumn("_known", F.lit(True))
    names_held = worlds.select("display_name_key").distinct().withColumn("_held", F.lit(True))
    fresh = (
        valid.join(known, "world_id", "left_anti")
        .join(by_id, "world_id")
        .where(F.col("request_order") == F.col("_first_order"))
        .groupBy("display_name_key")
        .agg(F.min(place).alias("_first"))
    )
    outcome = (
        F.when(~_valid_world(), "invalid")
        .when(F.col("_known") | (F.col("request_order") > F.col("_first_order")), "world_exists")
        .when(F.col("_held") | (place != F.col("_first")), "name_taken")
        .otherwise("created")
    )
    return (
        asked.join(known, "world_id", "left")
        .join(by_id, "world_id", "left")
        .join(names_held, "display_name_key", "left")
        .join(fresh, "display_name_key", "left")
        .withColumn("outcome", outcome)
        .select(*requests.columns, "display_name_key", "outcome")
    )


def create_worlds(worlds: DataFrame, requests: DataFrame, now: Column) -> DataFrame:
    """Add the requested worlds whose outcome (``create_outcomes``) is ``created``."""
    accepted = create_outcomes(worlds, requests).where(F.col("outcome") == "created").withColumn("last_used_at", now)
    return worlds.unionByName(accepted.select(*worlds.columns))


def update_worlds(worlds: DataFrame, requests: DataFrame, now: Column) -> DataFrame:
    """Set every mutable field of existing worlds; adds ``outcome``.

    An unknown world is ignored. A name held by another world, or asked for by an earlier request,
    refuses the update. The own name is allowed and a null description clears the stored one.
    """
    mutable = ["display_name", "display_name_key", "description", "background_asset_id", "font_asset_id"]
    asked = (
        requests.join(worlds.select("world_id"), "world_id", "left_semi")
        .withColumn("display_name_key", text.name_key(F.col("display_name")))
        .withColumn("_valid", _valid_world())
    )
    holders = worlds.groupBy("display_name_key").agg(F.min("world_id").alias("_holder"))
    first = (
        asked.where("_valid")
        .groupBy("display_name_key")
        .agg(F.min(F.struct("request_order", "world_id")).alias("_first"))
    )
    keys = holders.join(first, "display_name_key", "full")
    decided = asked.join(keys, "display_name_key", "left").select(
        "world_id",
        F.struct(*mutable).alias("_new"),
        F.when(~F.col("_valid"), "invalid")
        .when(F.coalesce(F.col("_holder") != F.col("world_id"), F.lit(False)), "name_taken")
        .when(F.col("_first.world_id") != F.col("world_id"), "name_taken")
        .otherwise("updated")
        .alias("outcome"),
    )
    done = F.col("outcome") == "updated"
    return worlds.join(decided, "world_id", "left").select(
        "world_id",
        *[
            F.when(done, F.col(f"_new.{name}")).otherwise(F.col(name)).alias(name)
            for name in mutable
        ],
        F.when(done, now).otherwise(F.col("last_used_at")).alias("last_used_at"),
        F.coalesce("outcome", F.lit("unchanged")).alias("outcome"),
    )


def mark_used(worlds: DataFrame, usage: DataFrame) -> DataFrame:
    """Set the last time of use from a usage table (``world_id, used_at``)."""
    last = usage.groupBy("world_id").agg(F.max("used_at").alias("_used"))
    return (
        worlds.join(last, "world_id", "left")
        .withColumn("last_used_at", F.coalesce("_used", "last_used_at"))
        .drop("_used")
    )


def default_last_used() -> Column:
    return F.timestamp_seconds(F.lit(0))


def backfill_last_used(worlds: DataFrame) -> DataFrame:
    return worlds.withColumn(
        "last_used_at", F.coalesce("last_used_at", default_last_used())
    )


# Splitter settings


def effective_settings(worlds: DataFrame, settings: DataFrame) -> DataFrame:
    """Settings of every world; defaults where it has none."""
    return worlds.select("world_id").join(settings, "world_id", "left").select(
        "world_id",
        F.coalesce("chunk_size", F.lit(DEFAULT_CHUNK_SIZE)).alias("chunk_size"),
        F.coalesce("max_lookback_size", F.lit(DEFAULT_MAX_LOOKBACK)).alias("max_lookback_size"),
        F.coalesce("overlap_size", F.lit(DEFAULT_OVERLAP)).alias("overlap_size"),
        F.coalesce("splitter_version", F.lit(SPLITTER_VERSION)).alias("splitter_version"),
        F.coalesce("is_locked", F.lit(False)).alias("is_locked"),
    )


def save_settings(settings: DataFrame, requests: DataFrame) -> DataFrame:
    """Insert, update or refuse; adds ``outcome``.

    A new row takes the current version, an update keeps the stored one, a locked row never changes.
    """
    numbers = ["chunk_size", "max_lookback_size", "overlap_size"]
    asked = requests.select("world_id", F.struct(*numbers).alias("_asked"))
    joined = settings.join(asked, "world_id", "full")
    stored = F.struct(*numbers)
    outcome = (
        F.when(F.col("_asked").isNull(), "untouched")
        .when(F.col("is_locked").isNull(), "inserted")
        .when(~F.col("is_locked"), "updated")
        .when(stored == F.col("_asked"), "locked_equal")
        .otherwise("locked_refused")
    )
    written = F.col("outcome").isin("inserted", "updated")
    return joined.withColumn("outcome", outcome).select(
        "world_id",
        *[F.when(written, F.col(f"_asked.{n}")).otherwise(F.col(n)).alias(n) for n in numbers],
        F.coalesce("splitter_version", F.lit(SPLITTER_VERSION)).alias("splitter_version"),
        F.coalesce("is_locked", F.lit(False)).alias("is_locked"),
        "outcome",
    )


def lock_settings(settings: DataFrame, worlds: DataFrame) -> DataFrame:
    wanted = worlds.select("world_id").distinct().withColumn("_lock", F.lit(True))
    return (
        settings.join(wanted, "world_id", "left")
        .withColumn("is_locked", F.col("is_locked") | F.coalesce("_lock", F.lit(False)))
        .drop("_lock")
    )


# Assets


def upsert_assets(assets: DataFrame, seeds: DataFrame) -> DataFrame:
    """Insert seeds or replace every field but ``original_filename``."""
    fields = [name for name in assets.columns if name not in ("asset_id", "original_filename")]
    incoming = seeds.select("asset_id", F.struct(*fields, "original_filename").alias("_seed"))
    seeded = F.col("_seed").isNotNull()
    return assets.join(incoming, "asset_id", "full").select(
        "asset_id",
        *[F.when(seeded, F.col(f"_seed.{n}")).otherwise(F.col(n)).alias(n) for n in fields],
        F.when(F.col("is_built_in").isNull(), F.col("_seed.original_filename"))
        .otherwise(F.col("original_filename"))
        .alias("original_filename"),
    )


def uploaded_assets(uploads: DataFrame) -> DataFrame:
    """The rows uploaded files get (``upload_id, asset_type, original_filename, file_hash, full_font_name``)."""
    folder = F.when(F.col("asset_type") == "image", "images").otherwise("fonts")
    return uploads.select(
        F.col("upload_id").alias("asset_id"),
        "asset_type",
        names.default_display_name(F.col("asset_type"), F.col("original_filename")).alias("display_name"),
        F.concat(
            folder, F.lit("/"), F.col("upload_id"), names.safe_suffix(F.col("original_filename"))
        ).alias("stored_path"),
        "file_hash",
        F.lit(False).alias("is_built_in"),
        "full_font_name",
        "original_filename",
    )


def register_assets(assets: DataFrame, uploads: DataFrame) -> DataFrame:
    """Add uploaded files whose id is new; ``uploads.upload_outcomes`` is the gate before it and names the others."""
    return assets.unionByName(uploaded_assets(uploads).join(assets.select("asset_id"), "asset_id", "left_anti"))


def fallback_asset(asset_type: Column) -> Column:
    return F.when(asset_type == "image", DEFAULT_BACKGROUND_ID).when(asset_type == "font", DEFAULT_FONT_ID)


def asset_references(worlds: DataFrame) -> DataFrame:
    """Every world once per asset it uses, as background or as font."""
    used = F.array_distinct(F.array("background_asset_id", "font_asset_id"))
    return worlds.select(
        F.explode(used).alias("asset_id"), "world_id", "display_name", "display_name_key"
    )


def _referenced(worlds: DataFrame) -> DataFrame:
    """Asset ids in use, reduced before the shuffle."""
    return asset_references(worlds).select("asset_id").distinct()


def deletable_assets(assets: DataFrame, worlds: DataFrame) -> DataFrame:
    """Uploaded assets that no world uses."""
    return assets.where(~F.col("is_built_in")).join(_referenced(worlds), "asset_id", "left_anti")


def delete_unused_assets(assets: DataFrame, requests: DataFrame, worlds: DataFrame) -> DataFrame:
    removed = lookup(deletable_assets(assets, worlds), requests, "asset_id").select("asset_id")
    return assets.join(removed, "asset_id", "left_anti")


def stale_confirmations(worlds: DataFrame, confirmed: DataFrame) -> DataFrame:
    """(asset, world) pairs that are confirmed but not affected, or affected but not confirmed.

    Only assets somebody asked to delete are compared; ``confirmed`` may hold a row with a null world
    for an asset whose confirmed set is empty.
    """
    asked = confirmed.select("asset_id").distinct()
    affected = asset_references(worlds).join(asked, "asset_id", "left_semi").select(
        "asset_id", "world_id", F.lit(True).alias("_affected")
    )
    named = (
        confirmed.where(F.col("world_id").isNotNull())
        .select("asset_id", "world_id")
        .distinct()
        .withColumn("_confirmed", F.lit(True))
    )
    return (
        affected.join(named, ["asset_id", "world_id"], "full")
        .where(F.col("_affected").isNull() | F.col("_confirmed").isNull())
        .select(
            "asset_id",
            "world_id",
            F.when(F.col("_affected").isNull(), "not_affected").otherwise("not_confirmed").alias("reason"),
        )
    )


def replace_references(worlds: DataFrame, removed: DataFrame) -> DataFrame:
    """Give worlds that use a removed asset the fallback of its type; adds ``is_changed``.

    An image is only replaced as background and a font only as font. The removed assets come from a
    request, so the worlds stay where they are, however many use one asset.
    """
    removed = sized(removed.select("asset_id", "asset_type"))
    images = removed.where(F.col("asset_type") == "image").select(
        F.col("asset_id").alias("background_asset_id"), F.lit(DEFAULT_BACKGROUND_ID).alias("_background")
    )
    fonts = removed.where(F.col("asset_type") == "font").select(
        F.col("asset_id").alias("font_asset_id"), F.lit(DEFAULT_FONT_ID).alias("_font")
    )
    return (
        worlds.join(images, "background_asset_id", "left")
        .join(fonts, "font_asset_id", "left")
        .withColumn("is_changed", F.col("_background").isNotNull() | F.col("_font").isNotNull())
        .withColumn("background_asset_id", F.coalesce("_background", "background_asset_id"))
        .withColumn("font_asset_id", F.coalesce("_font", "font_asset_id"))
        .select(*worlds.columns, "is_changed")
    )


def delete_with_fallback(
    assets: DataFrame, worlds: DataFrame, confirmed: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Delete uploaded assets whose affected worlds were all confirmed; returns (assets, worlds).

    One stale pair leaves its asset and all its references as they are.
    """
    stale = stale_confirmations(worlds, confirmed).select("asset_id").distinct()
    removed = (
        lookup(assets.where(~F.col("is_built_in")), confirmed, "asset_id")
        .join(stale, "asset_id", "left_anti")
        .select("asset_id", "asset_type")
    )
    return assets.join(removed, "asset_id", "left_anti"), replace_references(worlds, removed)
