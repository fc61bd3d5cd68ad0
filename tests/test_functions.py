import pathlib
import sys
from urllib.parse import quote

import pytest
from pyspark.sql import functions as F

from corpuspipe.functions import names, text
from corpuspipe.operators.validation import is_unsafe_path, normalize_world_id


def apply(spark, values, function):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [row[0] for row in frame.orderBy("i").select(function(F.col("v"))).collect()]


EVERY_BLANK = [chr(c) for c in range(sys.maxunicode + 1) if chr(c).isspace()]
SAMPLES = [
    "", " ", "a", " \xa0\n", " a b ", "\x1c\x1d x\x85y　", "a​b", "\t\r\n one\n\n two  three\x0b",
    "x\r\ny\rz\n", "  lead", "trail  ",
] + EVERY_BLANK


def test_usable_text_equals_strip(spark):
    assert apply(spark, SAMPLES, text.is_usable) == [bool(s.strip()) for s in SAMPLES]
    assert apply(spark, [None], text.is_usable) == [False]


def test_strip_collapse_and_preformatted(spark):
    assert apply(spark, SAMPLES, text.strip_blanks) == [s.strip() for s in SAMPLES]
    assert apply(spark, SAMPLES, text.collapse_blanks) == [" ".join(s.split()) for s in SAMPLES]
    expected = ["\n".join(line.rstrip() for line in s.splitlines() if line.strip()) for s in SAMPLES]
    assert apply(spark, SAMPLES, text.tidy_preformatted) == expected


def test_name_key_is_casefold(spark):
    values = ["Lighthouse", "LIGHTHOUSE", "Straße", "STRASSE", "İstanbul", "ﬁ", "Σίσυφος"]
    assert apply(spark, values, text.name_key) == [v.casefold() for v in values]


PATHS = [
    "notes.txt", "book.epub", "manual.PDF", "outline.docx", "outline", ".txt", "a.b.epub", "a.", "..txt", "x/.hid",
    "dir.d/file", "a b.Txt", ".a.b",
]


def test_suffix_equals_pathlib(spark):
    expected = [pathlib.PurePosixPath(p).suffix.lower() for p in PATHS]
    assert apply(spark, PATHS, names.suffix) == expected
    assert apply(spark, ["notes.txt", "outline.docx", "outline", "m.PDF"], names.source_type) == [
        "txt", "docx", "missing", "pdf",
    ]


def test_stored_names(spark):
    values = ["a.TXT", "a.b c", "a." + "x" * 17, "noext", "unsafe\\Portrait.PNG"]
    assert apply(spark, values, names.safe_suffix) == [".txt", "", "", "", ".png"]
    shown = apply(spark, ["unsafe\\Portrait.PNG", " .ttf", "..", "a/b/c.otf"], lambda v: names.default_display_name(F.lit("font"), v))
    assert shown == ["Portrait", "Uploaded font", "Uploaded font", "c"]


def test_asset_url_equals_quote(spark):
    values = ["image asset/one", "a+b*c~d", "ü&=?#", "plain"]
    assert apply(spark, values, names.asset_url) == [f"/assets/{quote(v, safe='')}/file" for v in values]


@pytest.mark.parametrize(
    "moment,age",
    [
        ("2026-01-01 12:00:00", "Just now"),
        ("2026-01-02 00:00:00", "Just now"),
        ("2026-01-01 11:58:59", "1 minute ago"),
        ("2026-01-01 11:00:01", "59 minutes ago"),
        ("2026-01-01 11:00:00", "1 hour ago"),
        ("2025-12-31 12:00:01", "23 hours ago"),
        ("2025-12-31 12:00:00", "1 day ago"),
        ("2025-12-01 12:00:00", "31 days ago"),
        ("yesterday", "yesterday"),
    ],
)
def test_relative_age(spark, moment, age):
    as_of = F.to_timestamp(F.lit("2026-01-01 12:00:30"))
    if moment == "2026-01-01 12:00:00":
        as_of = F.to_timestamp(F.lit("2026-01-01 12:00:59"))
    else:
        as_of = F.to_timestamp(F.lit("2026-01-01 12:00:00"))
    assert apply(spark, [moment], lambda v: names.relative_age(v, as_of)) == [age]


def test_world_ids(spark):
    dashed = "12345678-9abc-def0-1234-56789abcdef0"
    values = [dashed, dashed.upper(), "{" + dashed + "}", "urn:uuid:" + dashed, dashed.replace("-", ""), "Lighthouse", "", "URN:UUID:" + dashed]
    assert apply(spark, values, normalize_world_id) == [dashed] * 5 + [None] * 3


def test_unsafe_paths(spark):
    assert apply(spark, ["/a", "a/../b", "a..b", "..", "a/b"], is_unsafe_path) == [True, True, False, True, False]


def test_hash(spark):
    import hashlib

    expected = "sha256:" + hashlib.sha256("é".encode()).hexdigest()
    assert apply(spark, ["é"], lambda v: names.source_hash(F.encode(v, "UTF-8"))) == [expected]
    assert apply(spark, [expected], names.hash_log_prefix) == [expected[:19]]


def test_times_are_utc_in_any_session_zone(spark):
    import datetime

    zone = datetime.timezone(datetime.timedelta(hours=5))
    aware = datetime.datetime(2026, 1, 1, 5, 0, 0, tzinfo=zone)
    for session_zone in ("America/New_York", "UTC"):
        spark.conf.set("spark.sql.session.timeZone", session_zone)
        row = spark.range(1).select(
            names.utc_text(names.utc_moment(aware)),
            names.utc_text(names.utc_moment(datetime.datetime(2026, 1, 1, 1, 2, 3))),
            names.relative_age(F.lit("2026-01-01 00:00:00"), names.utc_moment(datetime.datetime(2026, 1, 1, 2, 0, 0))),
        ).first()
        assert tuple(row) == ("2026-01-01 00:00:00", "2026-01-01 01:02:03", "2 hours ago")
