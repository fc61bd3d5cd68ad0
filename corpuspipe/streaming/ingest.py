"""Incremental ingestion: arriving sources are appended to their worlds batch by batch."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from corpuspipe.plans.publish import BatchRefused, publish_append


def ingest_stream(
    parsed: DataFrame,
    root: str,
    checkpoint: str,
    name: str,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Append every micro-batch of a streaming frame of parsed sources to the published worlds.

    The publish id is made from the stream name and Spark's batch id, so a batch that is run again after
    a failure publishes once. A stream must not stop for one duplicate, so duplicates are left out instead of
    refusing the batch. What is left out, and why a batch was refused, is in ``publish.read_violations``.
    One stream may write to a world at a time; if numbers were taken by another writer after all, the stream
    fails (``BatchConflict``), and starting it again publishes the batch.
    """

    def append(batch: DataFrame, batch_number: int) -> None:
        try:
            publish_append(
                batch.sparkSession,
                root,
                f"{name}-{batch_number}",
                batch,
                datetime.datetime.now(datetime.timezone.utc).replace(tzinfo=None, microsecond=0),
                on_duplicate="skip",
            )
        except BatchRefused:
            # Nothing of this batch could be published; read_violations names each row and its rule.
            return

    return (
        parsed.writeStream.foreachBatch(append)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
