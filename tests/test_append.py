"""Appending with all gates: rules of rows and keys against the batch and the table; whole worlds are refused."""

import collections
import datetime

import pytest

from corpuspipe import schemas
from corpuspipe.operators import append

NOW = datetime.datetime(2026, 1, 2, 3, 4, 5)


def sources(spark, *rows):
    return spark.createDataFrame(rows, schemas.SOURCES)


def source(world, name, number, path=None, filename="a.txt"):
    return (world, name, filename, path or f"sources/{name}.txt", "txt", f"sha256:{name}", number, NOW)


def chunks(spark, *rows):
    return spark.createDataFrame(rows, schemas.CHUNKS)


def chunk(world, name, owner, book, number, text="text", overlap="", start=0, end=4):
    return (world, name, owner, book, number, text, overlap, start, end)


def rules(appended):
    return collections.Counter((r.world_id, r.entity, r.rule) for r in appended.violations.collect())


def test_sources_are_appended_world_by_world(spark):
    table = sources(spark, source("ids", "s1", 1), source("numbers", "s1", 7), source("paths", "s1", 1), source("free", "s1", 1))
    new = sources(
        spark,
        source("ids", "s1", 2, "sources/x"), source("ids", "s9", 3),
        source("numbers", "s2", 7),
        source("paths", "s2", 2, "sources/s1.txt"),
        source("twice", "s1", 1, "sources/1"), source("twice", "s1", 2, "sources/2"),
        source("places", "s1", 1), source("places", "s2", 1),
        source("blank", "s1", 1, filename=" "), source("low", "s1", 0),
        source("free", "s2", 2), source("new", "s1", 1), source(None, "s1", 1),
    )
    done = append.append_sources(new, table)
    assert rules(done) == collections.Counter(
        [
            ("ids", "source", "source_id_taken"), ("numbers", "source", "book_number_taken"),
            ("paths", "destination", "stored_path_taken"), ("twice", "source", "source_id_repeated"),
            ("places", "source", "book_number_repeated"), ("blank", "source", "original_filename_blank"),
            ("low", "source", "book_number_minimum"), (None, "source", "world_id_missing"),
        ]
    )
    assert {(r.world_id, r.source_id) for r in done.accepted.collect()} == {("free", "s2"), ("new", "s1")}
    assert done.rows.count() == table.count() + 2


@pytest.mark.parametrize(
    "broken,rule",
    [
        (dict(name=" "), "chunk_id_blank"), (dict(owner="　"), "source_id_blank"), (dict(book=0), "book_number_minimum"),
        (dict(number=0), "chunk_number_minimum"), (dict(text=""), "chunk_text_blank"), (dict(overlap=None), "overlap_null"),
        (dict(start=-1), "start_negative"), (dict(start=5), "end_before_start"),
    ],
)
def test_a_broken_chunk_refuses_its_world(spark, broken, rule):
    row = dict(name="c1", owner="s", book=1, number=1) | broken
    done = append.append_chunks(chunks(spark, chunk("w", **row), chunk("w", "c2", "s", 1, 2), chunk("v", "c2", "s", 1, 2)), chunks(spark))
    assert rules(done)["w", "chunk", rule] == 1
    assert [r.world_id for r in done.rows.collect()] == ["v"]


def test_chunks_keys(spark):
    table = chunks(spark, chunk("w", "c1", "s", 1, 1), chunk("v", "c1", "s", 1, 1))
    new = chunks(
        spark,
        chunk("w", "c1", "s", 2, 1), chunk("v", "c2", "s", 1, 1),
        chunk("u", "c1", "s", 1, 1), chunk("u", "c1", "s", 1, 2), chunk("t", "c1", "s", 1, 1), chunk("t", "c2", "s", 1, 1),
        chunk("free", "c1", "s", 1, 1, start=None, end=None), chunk("free", "c2", "s", 1, 2),
    )
    done = append.append_chunks(new, table)
    assert rules(done) == collections.Counter(
        [("w", "chunk", "chunk_id_taken"), ("v", "chunk", "chunk_place_taken"), ("u", "chunk", "chunk_id_repeated"), ("t", "chunk", "chunk_place_repeated")]
    )
    assert done.accepted.count() == 2 and done.rows.count() == 4


def test_batch_needs_partners(spark):
    new_sources = sources(spark, source("w", "s1", 1), source("w", "s2", 2), source("v", "s1", 1), source("ok", "s1", 1))
    new_chunks = chunks(
        spark, chunk("w", "c1", "s1", 1, 1), chunk("v", "c1", "s1", 1, 1), chunk("v", "c2", "lost", 1, 2), chunk("ok", "c1", "s1", 1, 1)
    )
    of_sources, of_chunks = append.append_batch(new_sources, new_chunks, sources(spark), chunks(spark))
    assert rules(of_sources) == collections.Counter([("w", "batch", "source_without_chunks"), ("v", "batch", "orphan_chunks")])
    assert [r.world_id for r in of_sources.rows.collect()] == [r.world_id for r in of_chunks.rows.collect()] == ["ok"]


def test_empty_batch_changes_nothing(spark):
    table = sources(spark, source("w", "s1", 1))
    done = append.append_sources(sources(spark), table)
    assert done.rows.count() == 1 and done.violations.isEmpty()
