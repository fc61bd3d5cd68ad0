import datetime
import hashlib

import pytest
from pyspark.sql import functions as F

from corpuspipe.plans import publish
from corpuspipe.plans.publish import BatchRefused, publish_append, publish_new_worlds, read_published
from corpuspipe.streaming.ingest import ingest_stream

NOW = datetime.datetime(2026, 1, 2, 3, 4, 5)
PARSED = (
    "world_id string, staging_entry_id string, source_order int, source_path string, source_file_type string, "
    "source_hash string, parsed_text string"
)
SETTINGS = (
    "world_id string, chunk_size int, max_lookback_size int, overlap_size int, splitter_version string, is_locked boolean"
)


def source(world, entry, order, content, kind="txt"):
    digest = "sha256:" + hashlib.sha256(content.encode()).hexdigest()
    return (world, entry, order, f"in/{entry}.{kind}", kind, digest, content)


def frame(spark, rows):
    return spark.createDataFrame(rows, PARSED)


def settings(spark, *worlds):
    return spark.createDataFrame([(w, 5, 0, 2, "old", False) for w in worlds], SETTINGS)


FIRST = [source("w", "entry-1", 0, "abcdefghij"), source("w", "entry-2", 1, "klmnop", "pdf")]


def chunks_of(spark, root):
    rows = read_published(spark, root, "chunks").orderBy("world_id", "book_number", "chunk_number").collect()
    return [(r.world_id, r.book_number, r.chunk_number, r.chunk_text, r.overlap_text) for r in rows]


def numbers_of(spark, root):
    return {(r.world_id, r.original_filename): r.book_number for r in read_published(spark, root, "sources").collect()}


def test_new_world_then_append_and_rerun(spark, tmp_path):
    root = str(tmp_path)
    summary = publish_new_worlds(spark, root, "b1", frame(spark, FIRST), settings(spark, "w"), NOW)
    assert [tuple(r) for r in summary.select("world_id", "source_count", "chunk_count").collect()] == [("w", 2, 4)]
    expected = [
        ("w", 1, 1, "abcde", ""), ("w", 1, 2, "fghij", "de"), ("w", 2, 1, "klmno", ""), ("w", 2, 2, "p", "no"),
    ]
    assert chunks_of(spark, root) == expected
    stored = read_published(spark, root, "splitter_settings").first()
    assert stored.is_locked and stored.splitter_version == "1" and stored.chunk_size == 5
    record = read_published(spark, root, "sources").where("book_number = 2").first()
    assert record.stored_path == f"sources/{record.source_id}.pdf" and record.original_filename == "entry-2.pdf"

    more = [source("w", "entry-3", 0, "qrstuv"), source("w", "entry-4", 1, "wxyz")]
    publish_append(spark, root, "b2", frame(spark, more), NOW)
    assert sorted(numbers_of(spark, root).values()) == [1, 2, 3, 4]
    before = chunks_of(spark, root)
    publish_append(spark, root, "b2", frame(spark, more), NOW)  # the same batch again
    assert chunks_of(spark, root) == before


def test_duplicates_block_or_are_skipped(spark, tmp_path):
    root = str(tmp_path)
    publish_new_worlds(spark, root, "b1", frame(spark, FIRST), settings(spark, "w"), NOW)
    batch = [source("w", "entry-8", 0, "abcdefghij"), source("w", "entry-9", 1, "new"), source("w", "entry-10", 2, "new")]
    with pytest.raises(BatchRefused):
        publish_append(spark, root, "b2", frame(spark, batch), NOW)
    assert len(numbers_of(spark, root)) == 2
    publish_append(spark, root, "b3", frame(spark, batch), NOW, on_duplicate="skip")
    assert numbers_of(spark, root)[("w", "entry-9.txt")] == 3 and len(numbers_of(spark, root)) == 3


def test_same_content_in_another_world_is_allowed(spark, tmp_path):
    root = str(tmp_path)
    rows = [source("w", "e1", 0, "same"), source("v", "e1", 0, "same")]
    publish_new_worlds(spark, root, "b1", frame(spark, rows), settings(spark, "w", "v"), NOW)
    assert len(numbers_of(spark, root)) == 2


def test_a_bad_world_does_not_stop_the_others(spark, tmp_path):
    root = str(tmp_path)
    rows = [
        *FIRST,
        source("type", "e1", 0, "text", "docx"),
        source("type", "e2", 1, "fine"),
        source("blank", "e1", 0, " \n"),
        source("late", "e1", 0, "abcde     fghij"),  # its second chunk is blank
        source("none", "e1", 0, "no settings"),
    ]
    publish_new_worlds(spark, root, "b1", frame(spark, rows), settings(spark, "w", "type", "blank", "late"), NOW)
    assert {r[0] for r in chunks_of(spark, root)} == {"w"}
    broken = {
        ("type", "unsupported_type"), ("blank", "text_unusable"), ("late", "chunk_text_blank"), ("none", "settings_missing"),
    }
    for found in (publish.read_violations(spark, root), read_published(spark, root, "violations")):
        assert {(r.world_id, r.rule) for r in found.collect()} == broken
    assert {r.world_id for r in read_published(spark, root, "sources").collect()} == {"w"}
    assert not (tmp_path / "staging" / "batch_id=b1").exists()
    assert {r.world_id for r in read_published(spark, root, "splitter_settings").collect()} == {"w"}


def test_skipped_duplicates_and_refused_batches_are_told(spark, tmp_path):
    root = str(tmp_path)
    assert publish.read_violations(spark, root).count() == 0
    publish_new_worlds(spark, root, "b1", frame(spark, FIRST), settings(spark, "w"), NOW)
    again = [source("w", "e8", 8, "wholly new"), *(source("w", f"again-{row[1]}", 9 + k, row[-1]) for k, row in enumerate(FIRST))]
    publish_append(spark, root, "b2", frame(spark, again), NOW, on_duplicate="skip")
    told = {(r.batch_id, r.entity_key, r.rule) for r in publish.read_violations(spark, root).collect()}
    assert told == {("b2", f"again-{row[1]}", "duplicate_skipped") for row in FIRST}
    with pytest.raises(BatchRefused):
        publish_append(spark, root, "b3", frame(spark, again[1:]), NOW)
    refused = publish.read_violations(spark, root).where("batch_id = 'b3'")
    assert {r.rule for r in refused.collect()} == {"duplicate_source"}


def test_taken_numbers_fail_loudly_before_texts_are_cut(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    publish_new_worlds(spark, root, "b1", frame(spark, FIRST), settings(spark, "w"), NOW)
    plan = publish.plan_sources
    monkeypatch.setattr(publish, "plan_sources", lambda *a: plan(*a).withColumn("book_number", F.lit(1)))
    with pytest.raises(publish.BatchConflict):
        publish_append(spark, root, "b2", frame(spark, [source("w", "e7", 7, "something else")]), NOW)
    assert not (tmp_path / "chunks" / "batch_id=b2").exists()


def test_worlds_must_be_new_or_exist(spark, tmp_path):
    root = str(tmp_path)
    publish_new_worlds(spark, root, "b1", frame(spark, FIRST), settings(spark, "w"), NOW)
    other = [source("w", "e5", 0, "other text")]
    with pytest.raises(BatchRefused):
        publish_new_worlds(spark, root, "b2", frame(spark, other), settings(spark, "w"), NOW)
    with pytest.raises(BatchRefused):
        publish_append(spark, root, "b3", frame(spark, [source("x", "e1", 0, "text")]), NOW)


def test_nothing_is_visible_before_the_manifest(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    publish_new_worlds(spark, root, "b0", frame(spark, [source("o", "e", 0, "old")]), settings(spark, "o"), NOW)
    write, manifest = publish._write, publish._write_manifest

    for dies_at in ("sources", "chunks", "splitter_settings", "manifest"):

        def failing_write(df, root, table, *rest, **more):
            if table == dies_at:
                raise RuntimeError("lost")
            return write(df, root, table, *rest, **more)

        def failing_manifest(*arguments):
            if dies_at == "manifest":
                raise RuntimeError("lost")
            return manifest(*arguments)

        monkeypatch.setattr(publish, "_write", failing_write)
        monkeypatch.setattr(publish, "_write_manifest", failing_manifest)
        with pytest.raises(RuntimeError):
            publish_new_worlds(spark, root, "b1", frame(spark, FIRST), settings(spark, "w"), NOW)
        for table in ("sources", "chunks", "splitter_settings"):
            assert {r.world_id for r in read_published(spark, root, table).collect()} == {"o"}
    monkeypatch.undo()
    publish_new_worlds(spark, root, "b1", frame(spark, FIRST), settings(spark, "w"), NOW)
    assert len(chunks_of(spark, root)) == 5


def test_streamed_batches_append_once(spark, tmp_path):
    root, inbox = str(tmp_path / "corpus"), str(tmp_path / "inbox")
    publish_new_worlds(spark, root, "b1", frame(spark, FIRST), settings(spark, "w"), NOW)
    for rows in ([source("w", "s1", 0, "stream one"), source("w", "s2", 1, "abcdefghij")], [source("w", "s3", 0, "stream two")]):
        frame(spark, rows).coalesce(1).write.mode("append").parquet(inbox)
    for _ in range(2):  # the second run finds nothing new
        stream = spark.readStream.schema(frame(spark, FIRST).schema).option("maxFilesPerTrigger", 1).parquet(inbox)
        ingest_stream(stream, root, str(tmp_path / "cp"), "arrivals").awaitTermination()
        numbers = numbers_of(spark, root)
        assert sorted(numbers.values()) == [1, 2, 3, 4] and ("w", "s2.txt") not in numbers


def test_reads_prune_other_worlds_and_text(spark, tmp_path):
    root = str(tmp_path)
    rows = [*FIRST, source("v", "e1", 0, "other")]
    publish_new_worlds(spark, root, "b1", frame(spark, rows), settings(spark, "w", "v"), NOW)
    wanted = read_published(spark, root, "chunks").where(F.col("world_id") == "w").select("chunk_id")
    plan = wanted._jdf.queryExecution().executedPlan().toString()
    assert "chunk_text" not in plan and "(world_id" in plan.split("PartitionFilters")[1][:120]


WORLD = "world_id string, display_name string, description string, background_asset_id string, font_asset_id string"


def test_catalog_rows_are_published_with_the_world(spark, tmp_path):
    root = str(tmp_path)
    rows = [*FIRST, source("v", "e1", 0, "other"), source("u", "e1", 0, "more"), source("t", "e1", 0, "last")]
    names_ = [("w", "Lighthouse", None, "bg", "f"), ("v", "LIGHTHOUSE", None, "bg", "f"), ("u", " ", None, "bg", "f")]
    publish_new_worlds(
        spark, root, "b1", frame(spark, rows), settings(spark, "w", "v", "u", "t"), NOW,
        worlds=spark.createDataFrame(names_, WORLD),
    )
    found = spark.read.parquet(f"{root}/violations/batch_id=b1").collect()
    assert {(r.world_id, r.rule) for r in found} == {
        ("w", "name_taken"), ("u", "display_name_blank"), ("t", "world_row_missing"),
    }
    assert [(r.world_id, r.last_used_at) for r in publish.current_worlds(spark, root).collect()] == [("v", NOW)]
    later = NOW + datetime.timedelta(days=1)
    publish_append(spark, root, "b2", frame(spark, [source("v", "e2", 0, "again")]), later)
    assert [r.last_used_at for r in publish.current_worlds(spark, root).collect()] == [later]
    with pytest.raises(BatchRefused):
        publish_new_worlds(
            spark, root, "b3", frame(spark, FIRST), settings(spark, "w"), NOW,
            worlds=spark.createDataFrame([("w", "lighthouse", None, "bg", "f")], WORLD),
        )
