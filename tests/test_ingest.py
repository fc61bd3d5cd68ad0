import datetime

from pyspark.sql import functions as F

from corpuspipe import ship
from corpuspipe.plans.ingest import ingest_files, read_picked
from corpuspipe.plans.publish import read_published
from test_readers import epub

NOW = datetime.datetime(2026, 1, 2, 3, 4, 5)
PICKS = "world_id string, staging_entry_id string, source_order int, source_path string"
SETTINGS = "world_id string, chunk_size int, max_lookback_size int, overlap_size int, splitter_version string, is_locked boolean"


def test_files_to_chunks(spark, tmp_path):
    ship(spark)
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    (inbox / "b.txt").write_bytes("First text.\r\nMore of it.".encode("utf-16"))
    (inbox / "a.EPUB").write_bytes(bytes(epub({"x": "<h1>Title</h1><p>Body one.</p>", "y": "<p>Two.</p>"}, ["y", "x"])))
    (inbox / "bad.txt").write_bytes(b"\xff\xff\xff")
    (inbox / "c.docx").write_bytes(b"whatever")

    def picks(*rows):
        return spark.createDataFrame([(w, e, i, f"file:{inbox}/{n}") for w, e, i, n in rows], PICKS)

    first = picks(
        ("good", "e1", 0, "b.txt"), ("good", "e2", 1, "a.EPUB"), ("missing", "e3", 0, "gone.txt"),
        ("missing", "e4", 1, "b.txt"), ("bad", "e5", 0, "bad.txt"), ("type", "e6", 0, "c.docx"),
    )
    settings = spark.createDataFrame([(w, 12, 8, 4, "1", False) for w in ("good", "missing", "bad", "type")], SETTINGS)
    ingest_files(spark, str(tmp_path / "corpus"), "b1", first, str(inbox), NOW, settings)
    root = str(tmp_path / "corpus")
    texts = {
        r.source_id: r.text
        for r in read_published(spark, root, "chunks")
        .groupBy("source_id")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_number", "chunk_text"))), lambda c: c["chunk_text"]), "").alias("text"))
        .collect()
    }
    sources = {r.original_filename: r for r in read_published(spark, root, "sources").collect()}
    assert {n: (r.world_id, r.book_number, texts[r.source_id]) for n, r in sources.items()} == {
        "b.txt": ("good", 1, "First text.\r\nMore of it."),
        "a.EPUB": ("good", 2, "Two.\n\nTitle\nBody one."),
    }
    found = spark.read.parquet(f"{root}/violations/batch_id=b1").collect()
    assert {(r.world_id, r.entity_key, r.rule) for r in found} == {
        ("missing", "e3", "unavailable"), ("bad", "e5", "text_unusable"), ("type", "e6", "unsupported_type"), ("type", "e6", "text_unusable"),
    }
    assert not any("inbox" in str(v) for r in found for v in r)


def test_picked_files_are_hashed_by_content(spark, tmp_path):
    import hashlib

    (tmp_path / "x.txt").write_bytes(b"\xef\xbb\xbfabc")
    picks = spark.createDataFrame([("w", "e", 0, f"file:{tmp_path}/x.txt")], PICKS)
    row = read_picked(spark, picks, str(tmp_path))[0].first()
    assert row.source_hash == "sha256:" + hashlib.sha256(b"\xef\xbb\xbfabc").hexdigest() and row.parsed_text == "abc"


def test_registered_parsers_read_their_files(spark, tmp_path, monkeypatch):
    from corpuspipe.sources import staging

    ship(spark)
    monkeypatch.setattr(staging, "_PARSERS", {})
    staging.register_parser("pdf", lambda df: df.withColumn("parsed_text", F.concat(F.lit("page "), F.substring(F.col("content").cast("string"), 6, 3))))
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    (inbox / "a.pdf").write_bytes(b"%PDF-one")
    (inbox / "b.txt").write_bytes(b"two")
    rows = [("w", "e1", 0, f"file:{inbox}/a.pdf"), ("w", "e2", 1, f"file:{inbox}/b.txt")]
    picks = spark.createDataFrame(rows, PICKS)
    assert {(r.staging_entry_id, r.parsed_text) for r in read_picked(spark, picks, str(inbox))[0].collect()} == {("e1", "page one"), ("e2", "two")}
    settings = spark.createDataFrame([("w", 12, 8, 4, "1", False)], SETTINGS)
    ingest_files(spark, str(tmp_path / "corpus"), "b1", picks, str(inbox), NOW, settings)
    assert {r.original_filename for r in read_published(spark, str(tmp_path / "corpus"), "sources").collect()} == {"a.pdf", "b.txt"}
