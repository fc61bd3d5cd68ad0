"""Exact de-duplication by an extendible-hash index on shared files. DataFrame operations only.

Every text has a 64-bit key. The index holds one entry per distinct (key, SHA-256); copies are counted
into their entry before anything is shuffled, so a group of any size is one entry. The directory starts
with one bucket and doubles, one hash bit at a time, while a bucket holds more than ``capacity`` entries;
only overfull buckets are split, the others keep their local depth and are pointed to by several slots.
The directory places the entries file, bucket by bucket, and nothing else: entries with more than one row are joined with
their texts by (key, SHA-256), and texts are grouped by Spark's hash of (bucket, key, SHA-256, bytes). Hashes only
propose: equality is decided on the bytes.

Defined results: a null text counts as empty; empty texts are equal to each other; of repeated rows with the
largest ``doc_id`` exactly one stays; null ``doc_id`` sorts lowest. An empty table gives an empty result, and
other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from corpuspipe.llm.common import ascii_lower, boxed, keep_columns, new_folder, shuffle_partitions, store, unboxed

# Entries of one bucket: an owner task holds few such buckets, and a bucket is a few MB of keys.
CAPACITY = 65_536

# The histogram from which the directory is doubled has at most 2 ** MAX_DEPTH rows.
MAX_DEPTH = 20


@dataclass
class Index:
    """Stored tables: ``keys`` (a row per document), ``directory`` (slot -> bucket) and ``entries``."""

    keys: DataFrame
    directory: DataFrame
    entries: DataFrame
    depth: int


def _slot(depth: int):
    """The leading ``depth`` bits of the key, as a number."""
    return F.shiftrightunsigned("key", 64 - depth).cast("long") if depth else F.lit(0).cast("long")


def normalised(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``body`` (normalised text), ``key`` and ``sha`` of every document."""
    return (
        keep_columns(docs, doc_id="long", text="string")
        .select("doc_id", ascii_lower(F.coalesce("text", F.lit(""))).alias("body"))
        .select("doc_id", "body", F.xxhash64("body").alias("key"), F.sha2(F.col("body").cast("binary"), 256).alias("sha"))
    )


def doubled_directory(entries: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, int]:
    """The directory of the entries' keys: ``slot`` (at the global depth) -> ``bucket`` and its local depth.

    Works on a histogram of the leading bits. Every round doubles the directory and splits the buckets that
    are still overfull; the driver only learns whether there are any.
    """
    spark = entries.sparkSession
    histogram = store(
        entries.groupBy(_slot(MAX_DEPTH).alias("fine")).agg(F.count(F.lit(1)).alias("n")), "dedup-histogram"
    )

    def at(depth: int) -> DataFrame:
        return histogram.groupBy(F.shiftright("fine", MAX_DEPTH - depth).alias("prefix")).agg(F.sum("n").alias("n"))

    depth = 0
    while depth < MAX_DEPTH and at(depth).where(F.col("n") > capacity).limit(1).count():
        depth += 1
    slots = spark.range(1 << depth).select(F.col("id").alias("slot"))
    # A slot's bucket is its shortest prefix that is not overfull: splitting stopped there.
    directory = slots.withColumn("local_depth", F.lit(depth))
    for shallow in range(depth - 1, -1, -1):
        full = at(shallow).where(F.col("n") > capacity).select(F.col("prefix").alias("full_prefix"))
        directory = directory.join(
            full, F.shiftright("slot", depth - shallow) == F.col("full_prefix"), "left"
        ).select(
            "slot",
            F.when(F.col("full_prefix").isNull(), F.lit(shallow)).otherwise(F.col("local_depth")).alias("local_depth"),
        )
    directory = directory.select(
        "slot",
        "local_depth",
        F.expr(f"(shiftright(slot, {depth} - local_depth) << ({depth} - local_depth))").alias("bucket"),
    )
    return store(directory, "dedup-directory"), depth


def build_index(docs: DataFrame, capacity: int = CAPACITY) -> Index:
    """Write keys, directory and bucketed entries of all documents to the shared folder."""
    spark = docs.sparkSession
    keys = store(
        normalised(docs).select("doc_id", "key", "sha").withColumn("row", F.monotonically_increasing_id()), "dedup-keys"
    )
    counted = store(
        keys.groupBy("key", "sha").agg(
            F.count(F.lit(1)).alias("rows"),
            F.max("doc_id").alias("last_id"),
        ),
        "dedup-counted",
    )
    directory, depth = doubled_directory(counted, capacity)
    path = new_folder(spark, "dedup-entries")
    placed = counted.withColumn("slot", _slot(depth)).join(directory, "slot")
    (
        placed.select("bucket", "key", "sha", "rows", "last_id")
        .repartition(shuffle_partitions(spark), "bucket")
        .sortWithinPartitions("bucket", "key")
        .write.parquet(path)
    )
    entries = spark.read.parquet(path)
    return Index(keys, directory, entries, depth)


def byte_classes(docs: DataFrame, index: Index) -> DataFrame:
    """Texts of entries with more than one row, grouped by their bytes: ``keep_id``, ``group_size`` and the
    place of the class in the chain of its key."""
    shared = index.entries.where(F.col("rows") > 1).select("bucket", "key", "sha")
    return (
        normalised(docs)
        .join(shared, ["key", "sha"])
        .groupBy("bucket", "key", "sha", "body")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    )


def exact_dedup(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    index = build_index(docs, capacity)
    found = store(byte_classes(docs, index), "dedup-classes")
    # Two texts with equal key and SHA-256 but other bytes: chained, and told apart by their bytes.
    chained = found.groupBy("key", "sha").agg(F.count(F.lit(1)).alias("links")).where(F.col("links") > 1)
    single = found.join(chained, ["key", "sha"], "left_anti") if (split := chained.limit(1).count()) else found
    classes = single.select("key", "sha", "keep_id", "group_size")
    members = index.keys
    if split:
        members = members.join(chained, ["key", "sha"], "left_anti")
    decided = members.join(classes, ["key", "sha"], "left").select(
        "doc_id",
        "row",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.col("sha").alias("text_sha256"),
    )
    if split:
        chain = found.join(chained, ["key", "sha"], "left_semi").drop("bucket")
        decided = decided.unionByName(
            normalised(docs)
            .join(chain, ["key", "sha", "body"])
            .select("doc_id", F.monotonically_increasing_id().alias("row"), "keep_id", "group_size", F.col("sha").alias("text_sha256"))
        )
    return _one_row_stays(decided)


def _one_row_stays(decided: DataFrame) -> DataFrame:
    """Mark the row that stays; among repeated rows of the largest id, the one read last."""
    repeated = (
        decided.where(F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("group_size") > 1))
        .groupBy("text_sha256", "keep_id")
        .agg(F.max("row").alias("last_row"), F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > 1)
        .select("text_sha256", "keep_id", "last_row")
    )
    is_kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    columns = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    stored = store(repeated, "dedup-repeated")
    if not stored.limit(1).count():
        return decided.withColumn("kept", is_kept).select(*columns)
    last = stored.select(
        F.col("text_sha256").alias("of_sha"), F.col("keep_id").alias("of_id"), "last_row"
    )
    return (
        decided.join(last, (F.col("text_sha256") == F.col("of_sha")) & F.col("keep_id").eqNullSafe(F.col("of_id")), "left")
        .withColumn("kept", is_kept & (F.col("last_row").isNull() | (F.col("row") == F.col("last_row"))))
        .select(*columns)
    )


def without_copies(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    The dropped ids are the smaller side, so they are what the texts are joined with. Repeated rows (same id
    and text) are rare; where there are any, those rows alone are reduced to one.
    """
    decided = store(exact_dedup(docs, capacity), "dedup-decided")
    sha = F.sha2(ascii_lower(F.coalesce(F.col("text").cast("string"), F.lit(""))).cast("binary"), 256)
    rows = boxed(docs, id=F.col("doc_id").cast("long"), sha=sha)
    same = F.col("id").eqNullSafe(F.col("of_id")) & (F.col("sha") == F.col("of_sha"))
    of = (F.col("doc_id").alias("of_id"), F.col("text_sha256").alias("of_sha"))
    stay = rows.join(decided.where(~F.col("doc_id").eqNullSafe(F.col("keep_id"))).select(*of), same, "left_anti")
    twice = decided.where(F.col("doc_id").eqNullSafe(F.col("keep_id")) & ~F.col("kept")).select(*of).distinct()
    if twice.limit(1).count():
        once = stay.join(twice, same, "left_semi").dropDuplicates(["id", "sha"])
        stay = stay.join(twice, same, "left_anti").unionByName(once)
    return unboxed(stay)
