"""Chunks of sources in parts are those of the whole text."""

import random

import pytest

from corpuspipe.operators import part_chunking
from corpuspipe.operators.chunking import Settings, split_texts

FIELDS = ("chunk_number", "chunk_text", "overlap_text", "character_start_offset", "character_end_offset")


def texts(seed):
    rnd = random.Random(seed)
    mixed = "".join(rnd.choice("abcdé😀  .!?\n") for _ in range(900))
    plain = "".join(rnd.choice("xyz") for _ in range(700))
    return {"mixed": mixed, "plain": plain, "breaks": "a\n\n" * 200, "short": "ab", "empty": "", "one": "word " * 120, None: "no key at all. " * 30}


@pytest.mark.parametrize(
    "settings,segment,fan",
    [(Settings(20, 8, 5), 21, 2), (Settings(7, 0, 0), 30, 3), (Settings(50, 49, 120), 130, 64), (Settings(1, 0, 3), 10, 4), (Settings(4000, 1000, 400), 10, 64)],
)
def test_equal_to_the_whole_text(spark, monkeypatch, settings, segment, fan):
    monkeypatch.setattr(part_chunking, "FAN", fan)
    rnd = random.Random(5)
    rows, whole = [], []
    for joiner_size, (name, text) in enumerate(texts(1).items()):
        pieces, at = [], 0
        while at < len(text) or not pieces:
            size = rnd.choice((0, 1, 3, 40, 300))
            pieces.append(text[at : at + size])
            at += size
        rows += [(name, number * 10, piece or None) for number, piece in enumerate(pieces)]
        whole.append((name, "\n\n".join(pieces)))
    parts = spark.createDataFrame(rows, "source string, part long, parsed_text string").repartition(5)
    found = part_chunking.chunks_of_parts(parts, ["source"], settings, joiner="\n\n", segment_chars=segment).collect()
    plain = split_texts(spark.createDataFrame(whole, "source string, parsed_text string"), settings).collect()
    key = lambda r: (r["source"] or "", r["chunk_number"])
    assert sorted(((r["source"], *(r[f] for f in FIELDS)) for r in found), key=lambda r: (r[0] or "", r[1])) == [
        (r["source"], *(r[f] for f in FIELDS)) for r in sorted(plain, key=key)
    ]


def test_no_parts(spark):
    assert part_chunking.chunks_of_parts(spark.createDataFrame([], "s string, part long, parsed_text string"), ["s"], Settings(5, 0, 2)).count() == 0


def every_entry(text, after, entries, settings):
    """The map of a segment, each entry followed alone."""
    out = []
    for place in range(entries):
        count = 0
        while place < len(text):
            place, count = part_chunking.chunk_end(text + after, place, settings), count + 1
        out.append((place - len(text), count))
    return out


@pytest.mark.parametrize("settings", [Settings(20, 8, 5), Settings(7, 0, 0), Settings(50, 49, 9), Settings(1, 0, 3), Settings(12, 30, 2)])
def test_maps_have_an_entry_for_each_stretch(settings):
    for text in texts(3).values():
        for size in (3, 130, len(text)):
            own, after = text[:size], text[size : size + settings.chunk_size + 1]
            for entries in (1, settings.chunk_size):
                firsts, ends, counts = part_chunking.exits(own, after, entries, settings)
                sizes = [b - a for a, b in zip(firsts, [*firsts[1:], entries])]
                spread = [(end, count) for end, count, size in zip(ends, counts, sizes) for _ in range(size)]
                assert spread == every_entry(own, after, entries, settings)


def test_maps_are_small():
    """Lists of one number for each entry were 600 long, six times the text of a segment of 1,500 characters."""
    rnd = random.Random(2)
    text = " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 9))) + rnd.choice(["", "", ".", ","]) for _ in range(900))
    firsts, _, _ = part_chunking.exits(text[:1800], text[1800:2401], 600, Settings(600, 200, 50))
    assert len(firsts) < 40


def test_equal_first_parts_with_a_joiner(spark):
    rows = [("s", 1, "ab"), ("s", 1, "ab"), ("s", 2, "c")]
    parts = spark.createDataFrame(rows, "s string, part long, parsed_text string").repartition(3)
    found = part_chunking.chunks_of_parts(parts, ["s"], Settings(50, 0, 0), joiner="--", segment_chars=51).collect()
    assert [row["chunk_text"] for row in found] == ["ab--ab--c"]
