"""Uploaded images and fonts: are the files whole, and what becomes of each upload.

Pictures and outlines are not decoded; what is walked is the frame of the format: chunks, segments, table directories and
the lengths that a file states of itself. All of it is column expressions on the bytes, so a cut or glued file is refused
where its row lies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corpuspipe.functions import names
from corpuspipe.operators import catalog, validation


def _number(content: Column, place: Column | int, size: int) -> Column:
    """Big-endian number of ``size`` bytes from ``place`` (0-based); null behind the end."""
    found = content.substr(F.lit(place) + 1, F.lit(size))
    return F.when(F.octet_length(found) == size, F.conv(F.hex(found), 16, 10).cast("long"))


def _little(content: Column, place: int) -> Column:
    return sum(_number(content, place + k, 1) * F.lit(1 << (8 * k)) for k in range(4))


def _walk(content: Column, begin: int, least: int, size: Column | None, follow) -> Column:
    """The place after following ``follow(place)`` from ``begin`` until it gives null.

    A step passes ``least`` bytes or more, which bounds the steps; ``size`` gives their number where a file states it.
    """
    steps = size if size is not None else F.octet_length(content) / least
    return F.aggregate(
        F.sequence(F.lit(0), F.greatest(F.lit(0), steps.cast("int"))),
        F.lit(begin).cast("long"),
        lambda place, _: F.coalesce(follow(place), place),
    )


def _whole_png(content: Column) -> Column:
    """A header chunk of 13 bytes, chunks that touch each other, and the end chunk as the last bytes."""
    length = F.octet_length(content)
    end = F.hex(F.substring(content, -12, 12)) == "0000000049454E44AE426082"
    header = F.hex(F.substring(content, 9, 8)) == "0000000D49484452"

    def after(place: Column) -> Column:
        following = place + 12 + _number(content, place, 4)
        return F.when(following <= length, following)

    return header & end & (_walk(content, 8, 12, None, after) == length)


def _whole_jpeg(content: Column) -> Column:
    """Segments with their stated lengths up to the start of the scan, and the end mark as the last bytes."""

    def after(place: Column) -> Column:
        mark = _number(content, place, 2)
        return F.when((mark >= 0xFFC0) & (mark != 0xFFDA), place + 2 + _number(content, place + 2, 2))

    scan = _walk(content, 2, 4, None, after)
    return (_number(content, scan, 2) == 0xFFDA) & (F.hex(F.substring(content, -2, 2)) == "FFD9")


def _whole_riff(content: Column) -> Column:
    return _little(content, 4) + 8 == F.octet_length(content)


def _tables_inside(content: Column, count: Column, begin: int, entry: int, place: int) -> Column:
    """Every entry of a table directory names bytes of the file; ``place`` is that of its offset, then comes the length."""
    return F.forall(
        F.sequence(F.lit(0), F.coalesce(count, F.lit(1)) - 1),
        lambda k: _number(content, begin + k * entry + place, 4) + _number(content, begin + k * entry + place + 4, 4)
        <= F.octet_length(content),
    )


def _whole_sfnt(content: Column) -> Column:
    count = _number(content, 4, 2)
    return (count > 0) & _tables_inside(content, count, 12, 16, 8)


def _whole_woff(content: Column) -> Column:
    count = _number(content, 12, 2)
    return (count > 0) & (_number(content, 8, 4) == F.octet_length(content)) & _tables_inside(content, count, 44, 20, 4)


def _whole_woff2(content: Column) -> Column:
    return (_number(content, 12, 2) > 0) & (_number(content, 8, 4) == F.octet_length(content))


def is_whole(kind: Column, content: Column) -> Column:
    """Is the frame of the file whole? ``kind`` is its suffix; false for kinds that are not known and for null contents."""

    def judged(data: Column) -> Column:
        return (
            F.when(kind == ".png", _whole_png(data))
            .when(kind.isin(".jpg", ".jpeg"), _whole_jpeg(data))
            .when(kind == ".webp", _whole_riff(data))
            .when(kind.isin(".otf", ".ttf"), _whole_sfnt(data))
            .when(kind == ".woff", _whole_woff(data))
            .when(kind == ".woff2", _whole_woff2(data))
        )

    # As a variable of a function the bytes are taken from their row once; a column would be copied at each step of a walk.
    return F.coalesce(F.get(F.transform(F.array(content), judged), 0), F.lit(False))


def upload_outcomes(assets: DataFrame, uploads: DataFrame) -> DataFrame:
    """What becomes of each upload: ``upload_id, outcome, rules``.

    ``uploads`` has ``upload_id, asset_type, original_filename, file_hash, full_font_name, content``. The outcome is
    ``registered``, or ``refused`` with the broken rules, sorted and joined by commas. Files that fail suffix, size or leading
    bytes are not walked. An id that is taken, or stands more than once in ``uploads``, is refused. Contents are not shuffled.
    """
    files = uploads.withColumn("length", F.octet_length("content"))
    kind = names.suffix(F.col("original_filename"))
    found = validation.upload_violations(files).select("entity_key", "rule")
    small = F.col("length") <= validation.MAX_UPLOAD_BYTES
    # Files that are too large are told as such; they are not walked.
    broken = validation.violations(
        files,
        "upload",
        F.col("upload_id"),
        [("file_not_whole", "file is cut or damaged", small & ~is_whole(kind, F.col("content")))],
        F.lit(None),
    ).select("entity_key", "rule")
    rows = catalog.uploaded_assets(uploads)
    metadata = validation.asset_violations(rows).select("entity_key", "rule")
    taken = rows.join(assets.select("asset_id"), "asset_id", "left_semi").select(
        F.col("asset_id").cast("string").alias("entity_key"), F.lit("id_taken").alias("rule")
    )
    known = uploads.groupBy("upload_id").agg(F.count(F.lit(1)).alias("_times"))
    repeated = known.where("_times > 1").select(F.col("upload_id").cast("string").alias("entity_key"), F.lit("id_repeated").alias("rule"))
    rules = found.unionByName(broken).unionByName(metadata).unionByName(taken).unionByName(repeated)
    told = rules.groupBy(F.col("entity_key").alias("_key")).agg(F.array_sort(F.collect_set("rule")).alias("_rules"))
    listed = F.array_except(
        "_rules",
        F.when(
            F.arrays_overlap("_rules", F.array(F.lit("suffix_not_allowed"), F.lit("content_mismatch"))),
            F.array(F.lit("file_not_whole")),
        ).otherwise(F.array().cast("array<string>")),
    )
    return known.join(told, F.col("upload_id").cast("string").eqNullSafe(F.col("_key")), "left").select(
        "upload_id",
        F.when(F.col("_rules").isNull(), "registered").otherwise("refused").alias("outcome"),
        F.coalesce(F.array_join(listed, ","), F.lit("")).alias("rules"),
    )


def register_uploads(assets: DataFrame, uploads: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The assets with the uploads that ``outcomes`` (see ``upload_outcomes``) lets in."""
    fine = outcomes.where(F.col("outcome") == "registered").select("upload_id")
    return catalog.register_assets(assets, uploads.drop("content").join(fine, "upload_id", "left_semi"))
