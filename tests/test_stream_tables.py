"""Streams read a table whether it is one file or a folder of parts."""

import pytest

from corpuspipe.plans.stream_queries import attempt_lifecycle, attempt_lifecycle_stream, incremental_ingest
from corpuspipe.sources.tables import read_table, stream_table

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def parted(spark, tmp_path_factory):
    """The tables of SMALL, each as a folder of three parts."""
    folder = tmp_path_factory.mktemp("parted")
    for name in ("documents", "events"):
        read_table(spark, SMALL, name).repartition(3).write.parquet(str(folder / f"{name}.parquet"))
    return str(folder)


def test_one_file_or_parts(spark, parted, tmp_path):
    for number, folder in enumerate((SMALL, parted)):
        out = str(tmp_path / f"out{number}")
        writer = stream_table(spark, folder, "events").writeStream.format("parquet").option("checkpointLocation", f"{out}-state")
        writer.trigger(availableNow=True).start(out).awaitTermination()
        assert spark.read.parquet(out).exceptAll(read_table(spark, SMALL, "events")).count() == 0
        assert spark.read.parquet(out).count() == read_table(spark, SMALL, "events").count()


def test_queries_over_parts(spark, parted):
    assert attempt_lifecycle_stream(spark, parted).exceptAll(attempt_lifecycle(spark, SMALL)).count() == 0
    assert attempt_lifecycle_stream(spark, parted).count() == read_table(spark, SMALL, "events").count()
    texts = read_table(spark, SMALL, "documents").select("lang", "text").distinct()
    assert incremental_ingest(spark, parted).count() == texts.count()
