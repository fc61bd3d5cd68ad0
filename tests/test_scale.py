"""Hot keys: the same results when every threshold is so low that each of its branches runs."""

import random

import pytest
from pyspark.sql import functions as F

from corpuspipe.operators import dedup, scale
from corpuspipe.operators.numbering import assign_book_numbers
from corpuspipe.operators.scale import in_ranges, join_counted, number_in_order, with_position
from corpuspipe.sources import staging


def skewed(spark, count=2000, seed=1):
    pick = random.Random(seed)
    orders = list(range(count))
    pick.shuffle(orders)
    rows = [
        ("hot" if pick.random() < 0.4 else f"w{pick.randrange(20)}", f"e{o}", o, f"h{pick.choice([0, 0, 0, o])}")
        for o in orders
    ]
    return rows, spark.createDataFrame(rows, "world_id string, staging_entry_id string, source_order int, source_hash string")


@pytest.fixture
def many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_number_in_order_over_ranges(spark, many_ranges):
    rows, frame = skewed(spark)
    got = {r.staging_entry_id: r.n for r in number_in_order(frame, ["world_id"], "source_order", "n").collect()}
    expected, seen = {}, {}
    for world, entry, _, _ in sorted(rows, key=lambda r: r[2]):
        seen[world] = seen.get(world, 0) + 1
        expected[entry] = seen[world]
    assert got == expected


def test_numbers_beyond_32_bits_and_equal_orders(spark, many_ranges):
    rows = [("far", f"e{k:05d}", (1 << 40) - k * (1 << 22)) for k in range(900)] + [("same", f"e{k:05d}", 5) for k in range(3_000)]
    frame = spark.createDataFrame(rows, "world_id string, staging_entry_id string, source_order long").repartition(6)
    old = spark.createDataFrame([("far", (1 << 33))], "world_id string, book_number long")
    got = {(r.world_id, r.staging_entry_id): r.book_number for r in assign_book_numbers(frame, old).collect()}
    assert got == {
        **{("far", f"e{k:05d}"): (1 << 33) + 900 - k for k in range(900)},
        **{("same", f"e{k:05d}"): k + 1 for k in range(3_000)},
    }
    added = staging.stage_append(frame.where("world_id = 'far'").limit(0), frame).collect()
    assert {r.source_order for r in added if r.world_id == "same"} == set(range(3_000))


def test_positions_follow_the_total_order(spark):
    rows, frame = skewed(spark)
    got = {r.staging_entry_id: r.position for r in with_position(frame, F.desc("world_id"), "source_order").collect()}
    ordered = sorted(rows, key=lambda r: r[2])
    ordered.sort(key=lambda r: r[0], reverse=True)
    assert got == {r[1]: i + 1 for i, r in enumerate(ordered)}


def test_ranges_split_a_hot_key(spark):
    frame = spark.range(200_000).select(F.lit("one").alias("k"), "id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = in_ranges(frame, "k", "id")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r[1] for r in placed.groupBy("_range").count().collect()]
    assert len(sizes) > 1 and sum(sizes) == 200_000 and max(sizes) < 100_000


def test_join_counted_both_ways(spark, monkeypatch):
    rows, frame = skewed(spark)
    lookup = frame.groupBy("world_id").agg(F.count("*").alias("n"), F.min("source_order").alias("low"))
    plain = sorted(map(tuple, frame.join(lookup, "world_id").collect()))
    for threshold in (1, 100, 10_000):
        monkeypatch.setattr(scale, "HOT_ROWS", threshold)
        got = join_counted(frame, lookup, ["world_id"], "n").select("world_id", *frame.columns[1:], "n", "low")
        assert sorted(map(tuple, got.collect())) == plain


def test_duplicates_with_hot_groups(spark, monkeypatch):
    rows, frame = skewed(spark)
    first = {}
    for world, entry, order, value in sorted(rows, key=lambda r: r[2]):
        first.setdefault((world, value), entry)
    expected = {(r[0], r[1], first[(r[0], r[3])]) for r in rows if first[(r[0], r[3])] != r[1]}
    committed = spark.createDataFrame(
        [("hot", "h0", 7, "s7"), ("hot", "h0", 3, "s3"), ("w1", "h1", 1, "s1")],
        "world_id string, source_hash string, book_number int, source_id string",
    )
    for threshold in (1, 50, 10_000):
        monkeypatch.setattr(scale, "HOT_ROWS", threshold)
        got = dedup.duplicates_in_batch(frame).collect()
        assert {(r.world_id, r.staging_entry_id, r.first_staging_entry_id) for r in got} == expected
        assert len(got) == len(expected)
        matched = dedup.duplicates_of_committed(frame, committed).collect()
        hot = [r for r in rows if r[0] == "hot" and r[3] == "h0"]
        assert {r.staging_entry_id for r in matched if r.world_id == "hot"} == {r[1] for r in hot}
        assert {(r.committed_book_number, r.committed_source_id) for r in matched if r.world_id == "hot"} == {(3, "s3")}
    kept = {r.staging_entry_id for r in dedup.without_duplicates(frame, committed).collect()}
    assert kept == {e for (w, h), e in first.items() if (w, h) not in {("hot", "h0"), ("w1", "h1")}}


def test_book_numbers(spark):
    sources = spark.createDataFrame([("a", 1), ("a", 3)], "world_id string, book_number int")
    staged = spark.createDataFrame(
        [("a", "entry-3", 0), ("a", "entry-1", 1), ("b", "entry-2", 5), ("b", "entry-9", 2)],
        "world_id string, staging_entry_id string, source_order int",
    )
    got = {(r.world_id, r.staging_entry_id): r.book_number for r in assign_book_numbers(staged, sources).collect()}
    assert got == {("a", "entry-3"): 4, ("a", "entry-1"): 5, ("b", "entry-9"): 1, ("b", "entry-2"): 2}


def test_sized_sides(spark, monkeypatch):
    big = spark.range(5000).select((F.col("id") % 7).alias("k"), "id")
    small = spark.range(7).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        checked = big.join(scale.sized(small), "k")
        assert "BroadcastHashJoin" in checked._jdf.queryExecution().executedPlan().toString()
        monkeypatch.setattr(scale, "BROADCAST_ROWS", 3)
        beyond = big.join(scale.sized(small), "k")
        assert "BroadcastHashJoin" not in beyond._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, checked.collect())) == sorted(map(tuple, beyond.collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
