"""Stored steps in the shared folder, and helpers that several operators use."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corpuspipe.operators.scale import checkpoint_folder

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else, whatever the locale."""
    return F.translate(text, UPPER, LOWER)


def new_folder(spark: SparkSession, label: str) -> str:
    """An unused folder below the shared checkpoint folder."""
    return f"{checkpoint_folder(spark)}/{label}-{uuid.uuid4().hex}"


def store(df: DataFrame, label: str) -> DataFrame:
    """Write the rows to the shared folder and read them back.

    Cuts the lineage: only rows of committed tasks are seen, and a lost executor loses none of them.
    """
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored._stored_path = path
    return stored


# Rows of a batch of texts: one of ten thousand takes tens of megabytes, on both sides and again while it grows.
TEXT_ROWS = 1_000


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Steps that are stored inside exchange batches of at most so many rows with Python."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def discard(*stored: DataFrame) -> None:
    """Delete stored steps that no later step reads."""
    for df in stored:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._stored_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def keep_columns(docs: DataFrame, **wanted: str) -> DataFrame:
    """Only the named columns, cast to the named types, so that other columns cannot clash with ours."""
    return docs.select(*(F.col(name).cast(kind).alias(name) for name, kind in wanted.items()))


def own(name: str) -> Column:
    """The column of this very name, whatever signs it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def boxed(docs: DataFrame, **more: Column) -> DataFrame:
    """Whole rows as the one column ``box``, so that no name of theirs can clash with the columns ``more``."""
    return docs.select(F.struct(*(own(name) for name in docs.columns)).alias("box"), *(value.alias(name) for name, value in more.items()))


def unboxed(rows: DataFrame, *more: Column) -> DataFrame:
    """The rows as they were put into the box, and the columns ``more``."""
    return rows.select("box.*", *more)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# Keys with at least 1 / HOT_SHARE of all rows are hot: there are at most HOT_SHARE of them, whatever the input.
HOT_SHARE = 1_000


def join_hot(facts: DataFrame, lookup: DataFrame, keys: list[str], rows: str, how: str = "inner") -> DataFrame:
    """Join ``facts`` with a stored table of one row per key, whose column ``rows`` counts the facts of the key.

    The at most HOT_SHARE hot keys meet their facts where these lie, as a broadcast of that many rows; a key of the
    rest has less than 1 / HOT_SHARE of all facts. ``rows`` is not part of the result.
    """
    total = lookup.agg(F.sum(rows)).first()[0] or 0
    least = max(2, -(-total // HOT_SHARE))
    hot, cold = lookup.where(F.col(rows) >= least).drop(rows), lookup.where(F.col(rows) < least).drop(rows)
    if not hot.limit(1).count():
        return facts.join(cold, keys, how)
    near = facts.join(F.broadcast(hot), keys)
    far = facts.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys, how)
    return near.unionByName(far)
