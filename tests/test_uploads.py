"""Whole and broken image and font files, and the outcomes of uploads."""

import struct
import zlib

from pyspark.sql import functions as F

from corpuspipe import schemas
from corpuspipe.operators import uploads

SCHEMA = "upload_id string, asset_type string, original_filename string, file_hash string, full_font_name string, content binary"


def chunk(kind, data=b""):
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def png(pieces=3):
    header = struct.pack(">IIBBBBB", 2, 2, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", header) + b"".join(chunk(b"IDAT", b"d" * k) for k in range(pieces)) + chunk(b"IEND")


def jpeg():
    return b"\xff\xd8\xff\xe0\x00\x10JFIF" + b"\0" * 10 + b"\xff\xdb\x00\x05abc" + b"\xff\xda\x00\x04xyscan data" + b"\xff\xd9"


def webp():
    return b"RIFF" + struct.pack("<I", 4 + 8 + 10) + b"WEBPVP8 " + struct.pack("<I", 10) + b"0123456789"


def sfnt(lead=b"\x00\x01\x00\x00"):
    return lead + struct.pack(">HHHH", 2, 0, 0, 0) + b"".join(
        name + struct.pack(">III", 0, 44 + 4 * k, 4) for k, name in enumerate((b"cmap", b"head"))
    ) + b"datadata"


def woff():
    return b"wOFF\x00\x01\x00\x00" + struct.pack(">IHH", 44 + 20 + 4, 1, 0) + b"\0" * 28 + b"cmap" + struct.pack(">IIII", 64, 4, 4, 0) + b"data"


def woff2():
    return b"wOF2\x00\x01\x00\x00" + struct.pack(">IHH", 60, 1, 0) + b"\0" * 44


FILES = {".png": png(), ".jpg": jpeg(), ".jpeg": jpeg(), ".webp": webp(), ".ttf": sfnt(), ".otf": sfnt(b"OTTO"), ".woff": woff(), ".woff2": woff2()}


def judged(spark, rows):
    frame = spark.createDataFrame(rows, "kind string, content binary")
    return [r.whole for r in frame.coalesce(1).withColumn("whole", uploads.is_whole(F.col("kind"), F.col("content"))).collect()]


def test_whole_files_and_every_cut(spark):
    assert judged(spark, list(FILES.items())) == [True] * len(FILES)
    cuts = [(kind, content[:at]) for kind, content in FILES.items() for at in range(len(content))]
    assert judged(spark, cuts) == [False] * len(cuts)
    odd = [(None, b""), (".png", None), (".gif", png()), (".png", jpeg()), (".jpg", png()), (".png", png() + b"x"), (".webp", webp() + b"xx")]
    assert judged(spark, odd) == [False] * len(odd)
    wild = FILES[".png"][:8] + chunk(b"IHDR", b"\0" * 13) + b"\xff\xff\xff\xffIDAT" + FILES[".png"][-12:]
    assert judged(spark, [(".png", wild), (".png", png(2_000))]) == [False, True]


def test_outcomes_and_registration(spark):
    rows = [
        ("a", "image", "One.PNG", "h1", None, png()),
        ("b", "image", "two.png", "h2", None, png()[:-1]),
        ("c", "image", "three.png", "h3", None, jpeg()),
        ("d", "font", "four.pdf", "h4", None, b"%PDF"),
        ("e", "font", "five.ttf", None, "Five", sfnt()),
        ("f", "image", "six.jpg", "h6", None, jpeg()),
        ("g", "image", "seven.jpg", "h7", None, jpeg()),
        ("g", "image", "seven.jpg", "h7", None, jpeg()),
        ("h", "font", "big.ttf", "h8", None, sfnt() + b"\0" * (3 << 20)),
        ("i", "image", "none.png", "h9", None, None),
    ]
    assets = spark.createDataFrame([("f", "image", "f", "images/f", "h0", False, None, "x.jpg")], schemas.ASSETS)
    table = spark.createDataFrame(rows, SCHEMA)
    outcomes = uploads.upload_outcomes(assets, table)
    assert {r.upload_id: (r.outcome, r.rules) for r in outcomes.collect()} == {
        "a": ("registered", ""),
        "b": ("refused", "file_not_whole"),
        "c": ("refused", "content_mismatch"),
        "d": ("refused", "suffix_not_allowed"),
        "e": ("refused", "file_hash_missing"),
        "f": ("refused", "id_taken"),
        "g": ("refused", "id_repeated"),
        "h": ("refused", "too_large"),
        "i": ("refused", "content_mismatch,too_large"),
    }
    state = {r.asset_id: r.original_filename for r in uploads.register_uploads(assets, table, outcomes).collect()}
    assert state == {"f": "x.jpg", "a": "One.PNG"}
    assert uploads.upload_outcomes(assets, table.limit(0)).count() == 0
