from pyspark.sql import functions as F

from corpuspipe.operators import records, validation
from corpuspipe.sources import staging

STAGED = "world_id string, staging_entry_id string, source_order int, source_path string"


def ids(frame, *columns):
    return sorted(tuple(r[c] for c in columns) for r in frame.collect())


def test_stage_keeps_unsupported_rows(spark):
    paths = ["notes.txt", "book.epub", "manual.PDF", "outline.docx", "outline"]
    frame = spark.createDataFrame([("w", f"e{i}", i, p) for i, p in enumerate(paths)], STAGED)
    rows = {r.source_path: r for r in staging.stage_sources(frame).collect()}
    assert [(rows[p].source_file_type, rows[p].is_valid) for p in paths] == [
        ("txt", True), ("epub", True), ("pdf", True), ("docx", False), ("missing", False),
    ]
    assert rows["outline"].error_message and rows["notes.txt"].error_message is None
    startable = validation.batch_startable(staging.stage_sources(frame)).first()
    assert (startable.can_start, startable.source_count, startable.invalid_count) == (False, 5, 2)
    listing = spark.createDataFrame([("notes.txt",), ("book.epub",)], "path string")
    missing = staging.unavailable_sources(frame, listing)
    assert ids(missing, "source_path") == [("manual.PDF",), ("outline",), ("outline.docx",)]


def test_registered_parsers_run_per_type(spark):
    staging.register_parser(" TXT ", lambda df: df.withColumn("parsed_text", F.lit("text")))
    staging.register_parser("pdf", lambda df: df.withColumn("parsed_text", F.lit("pages")))
    frame = spark.createDataFrame(
        [("w", "a", " Txt"), ("w", "b", "PDF"), ("bad", "c", "txt"), ("bad", "d", "docx")],
        "world_id string, staging_entry_id string, source_file_type string",
    )
    routed = staging.route_sources(frame)
    assert ids(routed, "staging_entry_id", "batch_routable") == [("a", True), ("b", True), ("c", False), ("d", False)]
    assert ids(staging.parse_routed(routed), "staging_entry_id", "parsed_text") == [("a", "text"), ("b", "pages")]


def test_parsed_outputs(spark):
    frame = spark.createDataFrame(
        [("w", "a", 0, "txt", "ok"), ("w", "b", 1, "txt", " \n")],
        "world_id string, staging_entry_id string, source_order int, source_file_type string, parsed_text string",
    )
    good, bad = staging.prepare_parsed(frame, F.lit("attempt"))
    assert ids(good, "attempt_id", "staging_entry_id") == [("attempt", "a")]
    assert ids(bad, "entity_key", "rule") == [("b", "text_unusable")]


def test_append_remove_replace(spark):
    schema = "world_id string, staging_entry_id string, source_order int"
    entries = spark.createDataFrame([("w", "a", 0), ("w", "b", 1)], schema)
    added = spark.createDataFrame([("w", "c", 7), ("w", "d", 3), ("v", "e", 9)], schema)
    both = staging.stage_append(entries, added)
    assert ids(both, "world_id", "source_order", "staging_entry_id") == [
        ("v", 0, "e"), ("w", 0, "a"), ("w", 1, "b"), ("w", 2, "d"), ("w", 3, "c"),
    ]
    asked = spark.createDataFrame(
        [("w", "staged", "a"), ("w", "committed", "b"), ("w", "staged", "zz")],
        "world_id string, source_kind string, source_id string",
    )
    assert ids(staging.stage_remove(entries, asked), "staging_entry_id") == [("b",)]
    worlds = spark.createDataFrame([("w",)], "world_id string")
    assert ids(staging.stage_replace(both, worlds), "staging_entry_id") == [("e",)]
    fresh = spark.createDataFrame([("w", "n", 0)], schema)
    assert ids(staging.stage_replace(both, worlds, fresh), "staging_entry_id") == [("e",), ("n",)]


ITEMS = "world_id string, position int, source_kind string, source_id string"


def order(*items):
    return [("w", i, kind, name) for i, (kind, name) in enumerate(items)]


def test_reorder(spark):
    sources = spark.createDataFrame(
        [("w", "source-1", 1), ("w", "source-2", 4)], "world_id string, source_id string, book_number int"
    )
    entries = spark.createDataFrame(
        [("w", "entry-1", 0), ("w", "entry-2", 1)], "world_id string, staging_entry_id string, source_order int"
    )
    c, s = "committed", "staged"

    def rules(*items):
        frame = spark.createDataFrame(order(*items), ITEMS)
        return {(r.rule, r.entity_key) for r in staging.reorder_violations(sources, entries, frame).collect()}

    good = [(c, "source-1"), (c, "source-2"), (s, "entry-2"), (s, "entry-1")]
    assert rules(*good) == set()
    assert ids(staging.reordered(entries, spark.createDataFrame(order(*good), ITEMS)), "source_order", "staging_entry_id") == [
        (0, "entry-2"), (1, "entry-1"),
    ]
    swapped = rules((c, "source-2"), (c, "source-1"), (s, "entry-1"), (s, "entry-2"))
    assert swapped == {("committed_prefix_changed", "source-1"), ("committed_prefix_changed", "source-2")}
    assert ("committed_prefix_changed", "source-2") in rules((c, "source-1"), (s, "entry-1"), (c, "source-2"), (s, "entry-2"))
    assert rules(*good[:3]) == {("source_missing", "entry-1")}
    assert rules(*good, (s, "entry-1")) == {("source_repeated", "entry-1")}
    assert rules(*good, (s, "zz")) == {("source_unknown", "zz")}
    assert rules(*good, ("other", "entry-1")) == {("kind_invalid", "entry-1")}


CHUNK = (
    "world_id string, chunk_id string, source_id string, book_number int, chunk_number int, chunk_text string, "
    "overlap_text string, character_start_offset int, character_end_offset int"
)


def test_chunk_rules(spark):
    good = ("w", "c", "s", 1, 1, "text", "", 0, 4)
    changes = {
        "chunk_id_blank": (1, " "), "source_id_blank": (2, ""), "book_number_minimum": (3, 0),
        "chunk_number_minimum": (4, 0), "chunk_text_blank": (5, "　"), "overlap_null": (6, None),
        "start_negative": (7, -1), "end_before_start": (8, -1),
    }
    for rule, (place, value) in changes.items():
        row = [*good]
        row[place] = value
        found = {r.rule for r in validation.chunk_violations(spark.createDataFrame([tuple(row)], CHUNK)).collect()}
        assert rule in found and found <= {rule, "end_negative"}
    fine = [good, good[:7] + (None, None), good[:7] + (None, 3)]
    assert validation.chunk_violations(spark.createDataFrame(fine, CHUNK)).isEmpty()


def test_settings_rules(spark):
    schema = "world_id string, chunk_size int, max_lookback_size int, overlap_size int, splitter_version string, is_locked boolean"

    def rules(*row):
        frame = spark.createDataFrame([("w", *row, False)], schema)
        return {r.rule for r in validation.settings_violations(frame).collect()}

    assert rules(1, 0, 0, "1") == set() and rules(2, 1, 9, "1") == set()
    assert "chunk_size_minimum" in rules(0, -1, 0, "1")
    assert rules(5, -1, 0, "1") == {"lookback_minimum"}
    assert rules(5, 5, 0, "1") == rules(5, 6, 0, "1") == {"lookback_below_chunk_size"}
    assert rules(5, 1, -1, "1") == {"overlap_minimum"}
    assert rules(5, 1, 1, " ") == rules(5, 1, 1, None) == {"version_blank"}
    twice = spark.createDataFrame([("w", 5, 1, 1, "1", True)] * 2, schema)
    assert {r.rule for r in validation.settings_violations(twice).collect()} == {"one_row_per_world"}


def test_gate_names_both_kinds_of_missing_partner(spark):
    prepared = spark.createDataFrame([("w", "a"), ("w", "b"), ("v", "c"), ("u", "d")], "world_id string, staging_entry_id string")
    chunks = spark.createDataFrame(
        [("w", "a", 1), ("w", "zz", 1), ("v", "c", 1), ("v", "c", 2)],
        "world_id string, staging_entry_id string, chunk_number int",
    )
    gate = records.commit_gate(prepared, chunks)
    assert ids(gate, "world_id", "source_count", "chunk_count", "orphan_count", "chunkless_count", "may_commit") == [
        ("u", 1, 0, 0, 1, False), ("v", 1, 2, 0, 0, True), ("w", 2, 2, 1, 1, False),
    ]
    assert ids(records.gate_violations(gate), "world_id", "rule") == [
        ("u", "no_chunk"), ("u", "sources_without_chunks"), ("w", "orphan_chunks"), ("w", "sources_without_chunks"),
    ]
