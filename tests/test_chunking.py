import random
import time

import pytest
from pyspark.sql import functions as F

from corpuspipe.operators import chunking
from corpuspipe.operators.chunking import Settings, chunk_counts, next_split_index, split_texts

FIELDS = ["chunk_text", "overlap_text", "character_start_offset", "character_end_offset"]


def brute_force(text, size, lookback, overlap):
    """Scan each window from its end, one delimiter after the other."""
    rows, start = [], 0
    while start < len(text):
        end = start + size
        if end >= len(text):
            end = len(text)
        else:
            low = start + max(0, size - lookback)
            for mark in ("\n\n", "\n", ".", "!", "?", " "):
                spots = [p for p in range(low, end - len(mark) + 1) if text.startswith(mark, p)]
                if spots:
                    end = spots[-1] + len(mark)
                    break
        rows.append((text[start:end], text[max(0, start - overlap) : start], start, end))
        start = end
    return rows


def cut(spark, texts, settings):
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, parsed_text string")
    rows = split_texts(frame, settings).orderBy("id", "chunk_number").collect()
    result = [[] for _ in texts]
    for row in rows:
        result[row.id].append(tuple(row[f] for f in FIELDS))
        assert row.chunk_number == len(result[row.id])
    return result


SPLIT_CASES = [
    ("Rain.", 40, 10, "Rain."),
    ("Nine chars", 10, 3, "Nine chars"),
    ("The ferry left.\n\nNobody waved. It rained", 30, 22, "The ferry left.\n\n"),
    ("Salt, rope\nand tar. A gull cried over it", 26, 24, "Salt, rope\n"),
    ("We counted oars. Nine were missing today", 28, 26, "We counted oars."),
    ("Row! The tide will not wait for us", 18, 18, "Row!"),
    ("Who tied this knot? It slips again and again", 32, 32, "Who tied this knot?"),
    ("north-west wind tomorrow", 14, 9, "north-west "),
    ("0123456789abcdefghij", 7, 3, "0123456"),
    ("low tide at seven-thirty", 15, 3, "low tide at sev"),
    ("Up. Down. And up it goes again", 13, 40, "Up. Down."),
    ("", 6, 2, ""),
]


@pytest.mark.parametrize("text,size,lookback,left", SPLIT_CASES)
def test_split_points(spark, text, size, lookback, left):
    frame = spark.createDataFrame([(text,)], "t string")
    found = frame.select(next_split_index(F.col("t"), Settings(size, lookback, 0))).first()[0]
    assert text[:found] == left


CHUNK_CASES = [
    ("Lanterns swing.\n\nThe harbour sleeps. So does the watchman.", 22, 18, 0),
    ("0123456789abcdefghijklm", 9, 4, 0),
    ("  Wet boards. Cold hands.   ", 15, 9, 4),
    ("\n \n\n  ", 2, 1, 0),
    ("", 8, 4, 0),
]


@pytest.mark.parametrize("text,size,lookback,overlap", CHUNK_CASES)
def test_chunk_offsets(spark, text, size, lookback, overlap):
    assert cut(spark, [text], Settings(size, lookback, overlap))[0] == brute_force(text, size, lookback, overlap)


def test_overlaps(spark):
    rows = cut(spark, ["0123456789ABCDEFGHIJ"], Settings(4, 0, 2))[0]
    assert [row[1] for row in rows] == ["", "23", "67", "AB", "EF"]
    rows = cut(spark, ["0123456789ABCDEFGHIJ"], Settings(4, 0, 9))[0]
    assert [row[1] for row in rows][:4] == ["", "0123", "01234567", "3456789AB"]
    first, second = cut(spark, ["01234567", "ABCDEFGH"], Settings(4, 0, 4))
    assert [row[1] for row in first + second] == ["", "0123", "", "ABCD"]


SETTINGS = [(1, 0, 0), (2, 1, 3), (7, 6, 20), (10, 10, 4), (20, 5, 50), (50, 30, 10), (40, 80, 7)]


def random_texts(alphabet, count, longest, seed):
    pick = random.Random(seed)
    return ["".join(pick.choice(alphabet) for _ in range(pick.randrange(longest))) for _ in range(count)]


@pytest.mark.parametrize("size,lookback,overlap", SETTINGS)
def test_random_texts_equal_brute_force(spark, size, lookback, overlap):
    texts = random_texts("ab \n.!?\r\té😀é", 120, 200, size * 31 + lookback)
    assert cut(spark, texts, Settings(size, lookback, overlap)) == [
        brute_force(t, size, lookback, overlap) for t in texts
    ]


def test_settings_columns_equal_brute_force(spark):
    texts = random_texts("abc \n.!?é😀", 140, 150, 5)
    rows = [(i, t, *SETTINGS[i % len(SETTINGS)]) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(
        rows, "id int, parsed_text string, chunk_size int, max_lookback_size int, overlap_size int"
    )
    got = {}
    for row in split_texts(frame).orderBy("id", "chunk_number").collect():
        got.setdefault(row.id, []).append(tuple(row[f] for f in FIELDS))
    for i, text, *numbers in rows:
        assert got.get(i, []) == brute_force(text, *numbers)


def test_wide_window_over_mixed_characters(spark, monkeypatch):
    """Thousands of changes between one- and two-unit characters under a wide window."""
    mixed = "".join("a😀" for _ in range(30_000))
    sparse = "".join("b😀c." if i % 5000 == 0 else "x" for i in range(40_000))
    settings = Settings(9000, 8999, 100)
    assert cut(spark, [mixed, sparse], settings) == [
        brute_force(t, 9000, 8999, 100) for t in (mixed, sparse)
    ]


def test_masked_measuring_equals_pattern(spark, monkeypatch):
    monkeypatch.setattr(chunking, "_DEEP_WINDOW", -1)
    texts = random_texts("ab \n.!?😀🎉", 100, 200, 11)
    assert cut(spark, texts, Settings(12, 8, 5)) == [brute_force(t, 12, 8, 5) for t in texts]


def test_long_text_is_cut_in_linear_time(spark):
    """Four times the text takes about four times as long; a quadratic step would take sixteen times."""

    def seconds(repeats):
        frame = spark.range(1).select(F.expr(f"repeat('word and. ', {repeats})").alias("parsed_text"))
        started = time.perf_counter()
        counted = split_texts(frame, Settings(100, 50, 20)).agg(F.count("*"), F.max("character_end_offset")).first()
        assert tuple(counted) == (-(-repeats // 10) + 1, 10 * repeats)
        return time.perf_counter() - started

    seconds(100_000)
    assert min(seconds(800_000) for _ in range(2)) < 9 * min(seconds(200_000) for _ in range(2))


def test_counts_and_pushdown(spark, tmp_path):
    texts = random_texts("ab .\n", 50, 300, 3)
    frame = spark.createDataFrame([(i, t, "unused") for i, t in enumerate(texts)], "id int, parsed_text string, x string")
    frame.write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t")).select("id", "parsed_text")
    counted = {r.id: r.chunk_count for r in chunk_counts(stored, Settings(20, 10, 5)).collect()}
    assert counted == {i: len(brute_force(t, 20, 10, 5)) for i, t in enumerate(texts)}
    plan = split_texts(stored, Settings(20, 10, 5))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "x#" not in plan.split("ReadSchema")[-1]
    assert plan.count("regexp_extract_all") == 1
