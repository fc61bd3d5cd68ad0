"""File names, paths, hashes, urls and times as column expressions."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, functions as F

from corpuspipe.functions.text import strip_blanks

# Supported source types, hash prefix, suffix pattern and fallback names.
SUPPORTED_TYPES = ("txt", "epub", "pdf")
MISSING_TYPE = "missing"
HASH_PREFIX = "sha256:"
HASH_LOG_LENGTH = 19
SAFE_SUFFIX = r"\A\.[A-Za-z0-9]{1,16}\z"
SOURCES_FOLDER = "sources"
FALLBACK_DISPLAY_NAMES = {"image": "Uploaded image", "font": "Uploaded font"}
TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"


def base_name(path: Column) -> Column:
    """Last component of a path with either kind of slash."""
    return F.regexp_extract(path, r"([^/\\]*)[/\\]*\z", 1)


def raw_suffix(filename: Column) -> Column:
    """``.txt`` of ``a.txt``; empty for names that start with their only dot or end with a dot."""
    return F.regexp_extract(filename, r"(?s)\A.+(\.[^.]+)\z", 1)


def suffix(path: Column) -> Column:
    return F.lower(raw_suffix(base_name(path)))


def source_type(path: Column) -> Column:
    """Supported type, else the suffix without its dot, else ``missing``."""
    ending = suffix(path)
    return F.when(ending == "", F.lit(MISSING_TYPE)).otherwise(F.substring(ending, 2, 2_000_000_000))


def source_hash(content: Column) -> Column:
    return F.concat(F.lit(HASH_PREFIX), F.sha2(content, 256))


def hash_log_prefix(value: Column) -> Column:
    return F.substring(value, 1, HASH_LOG_LENGTH)


def safe_suffix(filename: Column) -> Column:
    ending = raw_suffix(base_name(filename))
    return F.when(ending.rlike(SAFE_SUFFIX), F.lower(ending)).otherwise(F.lit(""))


def stored_path(owner_id: Column, filename: Column, folder: str = SOURCES_FOLDER) -> Column:
    return F.concat(F.lit(folder + "/"), owner_id, safe_suffix(filename))


def default_display_name(asset_type: Column, filename: Column) -> Column:
    """Stem of the file name, else a fixed name for the type."""
    name = base_name(filename)
    stem = strip_blanks(F.left(name, F.length(name) - F.length(raw_suffix(name))))
    fallback = F.when(asset_type == "image", FALLBACK_DISPLAY_NAMES["image"]).otherwise(
        FALLBACK_DISPLAY_NAMES["font"]
    )
    return F.when(stem.isin("", ".", ".."), fallback).otherwise(stem)


def asset_url(asset_id: Column) -> Column:
    """``/assets/<id>/file`` with the id percent-encoded as one path part."""
    part = F.url_encode(asset_id)
    for encoded, wanted in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        part = F.replace(part, F.lit(encoded), F.lit(wanted))
    return F.concat(F.lit("/assets/"), part, F.lit("/file"))


def utc_moment(value: datetime.datetime) -> Column:
    """A point in time as a literal; a value without zone is taken as UTC, whatever the session's zone."""
    if value.tzinfo is None:
        value = value.replace(tzinfo=datetime.timezone.utc)
    return F.timestamp_micros(F.lit(round(value.timestamp() * 1_000_000)))


def utc_text(moment: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` in UTC, whatever the session's zone."""
    return F.date_format(F.to_utc_timestamp(moment, F.current_timezone()), TIME_FORMAT)


def relative_age(last_used: Column, as_of: Column) -> Column:
    """Age of a UTC ``yyyy-MM-dd HH:mm:ss`` text; a text of another shape is returned as it is."""
    well_formed = last_used.rlike(r"\A\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\z")
    local = F.try_to_timestamp(F.when(well_formed, last_used), F.lit(TIME_FORMAT))
    moment = F.from_utc_timestamp(local, F.current_timezone())
    seconds = F.greatest(F.lit(0), F.unix_timestamp(as_of) - F.unix_timestamp(moment))

    def spoken(size: int, unit: str) -> Column:
        count = F.floor(seconds / size)
        return F.concat(
            count.cast("string"), F.lit(f" {unit}"), F.when(count == 1, "").otherwise("s"), F.lit(" ago")
        )

    return (
        F.when(moment.isNull(), last_used)
        .when(seconds < 60, F.lit("Just now"))
        .when(seconds < 3600, spoken(60, "minute"))
        .when(seconds < 86400, spoken(3600, "hour"))
        .otherwise(spoken(86400, "day"))
    )
