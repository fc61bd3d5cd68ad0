"""Reading and placing tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


_SCHEMAS: dict[tuple[str, str], StructType] = {}


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Scan ``<folder>/<name>.parquet``; timestamps are read and written as UTC.

    The schema of a table is taken from its footers once per application, so that further scans of a
    table list files but open none before the job runs.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    path = os.path.join(folder, f"{name}.parquet")
    key = (spark.sparkContext.applicationId, path)
    if key not in _SCHEMAS:
        _SCHEMAS[key] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[key]).parquet(path)


def stream_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The same table as a stream of its files, be it one file or a folder of parts.

    The pattern fits only the table itself: a stream takes a plain path for a folder, and a filter of names would
    look at the names of the parts.
    """
    schema = read_table(spark, folder, name).schema
    return spark.readStream.schema(schema).parquet(os.path.join(folder, f"{name}.parque[t]"))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Use all cores when a table comes in fewer splits than there are cores.

    A table of many splits is returned as it is: at scale the scan is already parallel, and moving
    whole texts over the network would be the most costly step of the job.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *keys)
