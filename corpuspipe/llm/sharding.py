"""Sharding by fixed virtual slots. DataFrame operations only.

Every record is hashed into one of SLOTS virtual slots. Bytes are added up slot by slot, and a map says which shard each
slot lies in. The map is a table of versions in a folder: version 0 deals the slots out evenly by number, and each edit
writes the next version, moving whole slots only. ``rebalanced`` moves slots from shards above the mean to shards below
it until bytes are nearly equal (law ``bytes``); ``grown`` gives a new shard a share of the others' slots and moves
nothing between them. A row's shard is its slot's in the latest version, so rows never keep a list of their own.

The hash is SHA-256 of id and text, so texts that are copies of each other are spread. Rows that are equal in id and text
are told apart by their place among all such rows, so a group of any size is spread over the slots as well. Equal texts
make no groups in this method. Inside a shard rows have gapless places, counted slot by slot.

Defined results: a null text has no bytes (size 1) and the checksum of nothing. A null id is hashed as an empty one. An
empty table gives an empty result and a map with every slot. Other columns are ignored. Bytes are as equal as whole
documents allow: a document larger than a shard's mean leaves its shard above the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from corpuspipe.llm.common import join_hot, keep_columns, new_folder, store
from corpuspipe.operators.scale import with_position

# Virtual slots; a power of 16, since a slot is the leading digits of a hash.
SLOT_DIGITS = 3
SLOTS = 16**SLOT_DIGITS

LAW = "bytes"


def _slot_of(*parts: Column) -> Column:
    """The slot that the parts, joined by colons, are hashed into."""
    hashed = F.sha2(F.concat_ws(":", *parts).cast("binary"), 256)
    return F.conv(F.substring(hashed, 1, SLOT_DIGITS), 16, 10).cast("long")


def slotted(docs: DataFrame) -> DataFrame:
    """``doc_id, size, text_crc32, text_sha256, row, virtual_slot`` of every row; texts are read once. A stored table."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    read = store(
        keep_columns(docs, doc_id="long", text="string").select(
            "doc_id",
            (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.sha2(text, 256).alias("text_sha256"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "shard-rows",
    ).withColumn("record", F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text_sha256"))
    repeated = store(read.groupBy("record").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1), "shard-repeated")
    single = read.withColumn("virtual_slot", _slot_of(F.col("record")))
    if repeated.limit(1).count():
        again = join_hot(read, repeated, ["record"], "rows").select(*read.columns)
        placed = with_position(again, "record", "row", into="place")
        spread = placed.withColumn("virtual_slot", _slot_of(F.col("record"), F.col("place").cast("string"))).drop("place")
        spread = store(spread, "shard-spread")
        # The rows that were spread are the smaller side.
        single = single.join(spread.select("row"), "row", "left_anti").unionByName(spread)
    return store(single.drop("record"), "shard-slotted")


def slot_bytes(rows: DataFrame) -> DataFrame:
    """``slot, bytes, rows`` of all SLOTS slots, empty ones included; a stored table."""
    filled = rows.groupBy(F.col("virtual_slot").alias("slot")).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    every = rows.sparkSession.range(SLOTS).select(F.col("id").alias("slot"))
    none = F.lit(0).cast("long")
    return store(
        every.join(filled, "slot", "left").select("slot", F.coalesce("bytes", none).alias("bytes"), F.coalesce("rows", none).alias("rows")),
        "shard-bytes",
    )


class SlotMap:
    """Versions of the map of slots to shards, a folder each. A version is never changed once it is written."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def versions(self) -> list[int]:
        """Versions that are complete; an edit that was broken off is not one."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        files = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(folder):
            return []
        done = files.globStatus(self.spark._jvm.org.apache.hadoop.fs.Path(self.path, "version=*/_SUCCESS"))
        return sorted(int(status.getPath().getParent().getName().split("=")[1]) for status in done)

    def read(self, version: int | None = None) -> DataFrame:
        """``slot, shard`` of a version, the latest by default."""
        version = self.versions()[-1] if version is None else version
        return self.spark.read.schema("slot long, shard int").parquet(f"{self.path}/version={version}")

    def write(self, edited: DataFrame) -> int:
        """Add a version; what a broken-off edit left there is overwritten."""
        version = len(self.versions())
        edited.select("slot", "shard").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/version={version}")
        return version

    def start(self, shards: int) -> int:
        """Version 0: equal ranges of slots."""
        slots = self.spark.range(SLOTS).select(F.col("id").alias("slot"))
        return self.write(slots.withColumn("shard", F.floor(F.col("slot") * shards / SLOTS).cast("int")))


def _dealt(pool: DataFrame, loads: DataFrame) -> DataFrame:
    """``slot, shard`` of the slots of ``pool``: the largest first, each to the shard that has least so far.

    Both sides have a row for each slot or shard at most, so the fold is one short expression.
    """
    slot = F.struct((-F.col("bytes")).alias("less"), "slot")
    load = F.struct("shard", "load")
    both = pool.select(slot.alias("slot"), F.lit(None).cast("struct<shard:int,load:bigint>").alias("load")).unionByName(
        loads.select(F.lit(None).cast("struct<less:bigint,slot:bigint>").alias("slot"), load.alias("load"))
    )
    folded = both.agg(F.array_sort(F.collect_list("slot")).alias("slots"), F.array_sort(F.collect_list("load")).alias("loads"))
    start = F.struct(F.transform("loads", lambda x: x["load"]).alias("loads"), F.array().cast("array<int>").alias("picked"))

    def deal(state: Column, slot: Column) -> Column:
        least = F.array_position(state["loads"], F.array_min(state["loads"])).cast("int") - 1
        return F.struct(
            F.transform(state["loads"], lambda load, k: F.when(k == least, load - slot["less"]).otherwise(load)).alias("loads"),
            F.concat(state["picked"], F.array(least)).alias("picked"),
        )

    picked = folded.select("slots", "loads", F.aggregate("slots", start, deal, lambda state: state["picked"]).alias("picked"))
    one = picked.select("loads", "picked", F.posexplode("slots").alias("k", "at"))
    return one.select(F.col("at.slot").alias("slot"), F.get("loads", F.get("picked", F.col("k")))["shard"].alias("shard"))


def rebalanced(current: DataFrame, sizes: DataFrame) -> DataFrame:
    """The map with bytes nearly equal: shards keep their largest slots up to the mean, the others are dealt anew."""
    so_far = Window.partitionBy("shard").orderBy(F.desc("bytes"), "slot").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy()  # a row for each of SLOTS slots
    within = F.sum("bytes").over(so_far) * F.size(F.collect_set("shard").over(whole)) <= F.sum("bytes").over(whole)
    placed = store(current.join(sizes, "slot").select("slot", "shard", "bytes", within.alias("stays")), "shard-placed")
    kept = F.sum(F.when(F.col("stays"), F.col("bytes")).otherwise(0)).alias("load")
    dealt = _dealt(placed.where("not stays"), placed.groupBy("shard").agg(kept))
    return placed.where("stays").select("slot", "shard").unionByName(dealt)


def grown(current: DataFrame, shard: int) -> DataFrame:
    """The map with one more shard, which takes an equal share of the slots of each other one; no other slot moves."""
    of_shard = Window.partitionBy("shard")
    place = F.row_number().over(of_shard.orderBy(F.sha2(F.col("slot").cast("string").cast("binary"), 256), "slot"))
    shards = F.size(F.collect_set("shard").over(Window.partitionBy()))
    ranked = current.withColumns({"place": place, "all": F.count(F.lit(1)).over(of_shard), "shards": shards})
    taken = F.col("place") * (F.col("shards") + 1) <= F.col("all")
    return ranked.select("slot", F.when(taken, F.lit(shard)).otherwise(F.col("shard")).cast("int").alias("shard"))


def placed_rows(rows: DataFrame, sizes: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Every row with its shard and its place there."""
    before = Window.partitionBy("shard").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = slot_map.join(sizes, "slot").select(
        F.col("slot").alias("virtual_slot"), "shard", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start")
    )
    inside = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_sha256", "row"))
    # One short row for each of SLOTS slots.
    return (
        rows.withColumn("inside", inside)
        .join(F.broadcast(starts), "virtual_slot")
        .withColumn("slot", F.col("start") + F.col("inside") - 1)
        .drop("inside", "start", "row", "text_sha256")
    )


def shard_documents(docs: DataFrame, shards: int = 8, path: str | None = None) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, map_version`` of every row.

    ``path`` is the folder of the map; its latest version is edited, or started where there is none. ``slot`` is the
    row's place in its shard.
    """
    spark = docs.sparkSession
    rows = slotted(docs)
    sizes = slot_bytes(rows)
    versions = SlotMap(spark, path or new_folder(spark, "shard-map"))
    if not versions.versions():
        versions.start(shards)
    version = versions.write(rebalanced(versions.read(), sizes))
    return placed_rows(rows, sizes, versions.read(version)).select(
        "doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.lit(version).alias("map_version"),
    )
