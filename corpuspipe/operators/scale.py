"""Building blocks for groups of any size: pinned ranges, positions, numbering and hot-key joins.

One key may hold a third of all rows here, so none of these puts a whole group into one task.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

# Keys with at least this many rows are joined by broadcast. There can be at most
# total rows / HOT_ROWS such keys (10,000 keys for ten billion rows), which bounds the broadcast.
HOT_ROWS = 1_000_000


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``; set here only for local runs."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not context.master.startswith("local"):
            raise ValueError("Set spark.checkpoint.dir to a folder all executors share.")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="corpuspipe-checkpoint-"))
    return context.getCheckpointDir()


def pinned(df: DataFrame) -> DataFrame:
    """Write the rows out and read them back, so that a lost executor cannot change their layout."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


# A side of at most so many short rows is broadcast.
BROADCAST_ROWS = 1_000_000


def sized(small: DataFrame) -> DataFrame:
    """A side expected to be small (one short row per world, or a request), broadcast after a check of its size.

    It is stored first, so that counting does not work it out twice. Beyond the limit it stays an
    ordinary side, and the adaptive planner splits the hot keys of the other one.
    """
    stored = pinned(small)
    if stored.count() <= BROADCAST_ROWS:
        return F.broadcast(stored)
    return stored


def in_ranges(df: DataFrame, *order: Column | str) -> DataFrame:
    """Rows sorted over all partitions and pinned there.

    Adds ``_range`` (number of the partition; later ranges sort after earlier ones) and ``_row`` (0-based
    place inside it). A hot key simply spans several ranges.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return pinned(
        ranged.withColumn("_range", F.spark_partition_id()).withColumn(
            "_row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
        )
    )


def with_position(df: DataFrame, *order: Column | str, into: str = "position") -> DataFrame:
    """1-based place of every row in the total order, without one task seeing all rows.

    The order must be total (end it with a unique key). The offsets hold one row per range.
    """
    placed = in_ranges(df, *order)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_range")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select("_range", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    )
    return (
        placed.join(F.broadcast(offsets), "_range")
        .withColumn(into, F.col("_offset") + F.col("_row") + 1)
        .drop("_range", "_row", "_offset")
    )


def number_in_order(
    df: DataFrame, keys: list[str], order: str, into: str, tie: str | None = None
) -> DataFrame:
    """1-based number of every row inside its key, by an order column of any type; LONG.

    Same result as ``row_number`` over the key, but the rows are sorted into ranges over all keys, and a key that
    goes on in further ranges starts there after its rows in the ones before. So neither a hot key nor many equal
    orders (told apart by ``tie``) come to lie in one task.
    """
    placed = in_ranges(df, *keys, order, *([tie] if tie else []))
    before = (
        Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    )
    # One row for each key and range that meet: as many as there are keys and ranges together.
    offsets = (
        placed.groupBy(*keys, "_range")
        .agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_rows"))
        .withColumn("_offset", F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first"))
        .drop("_first", "_rows")
    )
    return (
        placed.join(offsets, [*keys, "_range"])
        .withColumn(into, F.col("_offset") + F.col("_row") + 1)
        .drop("_range", "_row", "_offset")
    )


def join_counted(
    facts: DataFrame, lookup: DataFrame, keys: list[str], weight: str, how: str = "inner"
) -> DataFrame:
    """Join ``facts`` with a table of one row per key that knows how many facts each key has.

    Hot keys (few, see HOT_ROWS) are joined where the facts lie; only the cold keys are shuffled, and
    each of them is small by definition.
    """
    hot = lookup.where(F.col(weight) >= HOT_ROWS)
    cold = lookup.where((F.col(weight) < HOT_ROWS) | F.col(weight).isNull())
    hot_rows = facts.join(F.broadcast(hot), keys, "inner")
    cold_rows = facts.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys, how)
    return hot_rows.unionByName(cold_rows)
