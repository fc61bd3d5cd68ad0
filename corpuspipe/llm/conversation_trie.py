"""Prefix trie of conversations by whole-sequence collapse.

A prefix of turns is known by its depth and two 64-bit sums over its turns, each of a mix of the turn's digest and its
place. Sums of consecutive rows can be worked out range by range, so a conversation of any length is spread over tasks.

1. Identical rebuilt conversations become one weighted sequence, named by the smallest id, with the list of its ends.
2. Only the sequences' own prefixes go on. Each distinct prefix is a node; the one without its last turn is its parent.
3. Sequences that are the parent of a node are proper prefixes; without them (anti-join) the leaves remain.
4. The prefixes of the weighted sequences are added up node by node.

Sums over subtrees need no walk. With ``W`` the words up to a place, the members' words below a node are a sum over its
sequences of ``weight * (W(end) - W(before))``. For the words of distinct nodes, each node counts with the member that
names it: those nodes are the last ones of that sequence, from ``top`` on, so they are ``W(end) - W(before)`` again,
or ``W(end) - W(before top)`` above ``top``.

Lists of ends are packed into rows of many ids by range, and hashed row by row, so none is ever held as a whole.

Defined results: null roles and texts are empty. Rows without a ``conv_id`` are in no conversation. Turns with the same
number are ordered by their digest; repeated rows are repeated turns. An empty table has no node. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from corpuspipe.llm.common import discard, join_hot, keep_columns, store
from corpuspipe.llm.grams import mixed

#: Conversations share their head with the one at the next lower multiple of BASES; heads have up to HEADS - 1 turns.
BASES = 20
HEADS = 4

# Bytes of a packed row of ids.
PACKED_BYTES = 1 << 16

NODE = ["depth", "k1", "k2"]


def read_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, digest, words`` of every turn; texts are read once. A stored table."""
    role, text = (F.coalesce(F.col(name), F.lit("")) for name in ("role", "text"))
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return store(
        keep_columns(conversations, conv_id="long", turn="long", role="string", text="string")
        .where(F.col("conv_id").isNotNull())
        .select(
            "conv_id",
            "turn",
            F.unhex(F.substring(F.sha2(whole.cast("binary"), 256), 1, 32)).alias("digest"),
            F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "trie-turns",
    )


def running(rows: DataFrame, order: list[Column | str], values: Callable[[pa.RecordBatch], np.ndarray], sums: list[str], keep: list[str]) -> DataFrame:
    """``keep`` and, for each of ``sums``, the sum over the row and those before it in its conversation, and the row's own value.

    Rows are sorted over all partitions by ``conv_id`` and ``order``. A range adds up its own rows; a conversation that
    goes on in the next ranges has a row for each of them in the table of carries, so that table is as long as there are
    ranges, and it is broadcast. Sums are modulo 2 ** 64.
    """
    kept = rows.select("conv_id", *keep).schema
    names = [field.name for field in kept]
    owns = [f"{name}_own" for name in sums]
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in kept] + [f"{s} long" for s in (*sums, *owns)] + ["part int, at long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        last, carry = None, np.zeros(len(sums), dtype=np.uint64)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(batch.schema.get_field_index("conv_id")).to_numpy()
            own = values(batch)
            total = np.cumsum(own, axis=0, dtype=np.uint64)
            first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
            before = np.vstack([np.zeros((1, len(sums)), dtype=np.uint64), total[first[1:] - 1]])
            if last is not None and ids[0] == last:
                before[0] -= carry
            total = total - np.repeat(before, np.diff(np.append(first, len(ids))), axis=0)
            last, carry = ids[-1], total[-1].copy()
            columns = [batch.column(batch.schema.get_field_index(name)) for name in names]
            columns += [pa.array(np.ascontiguousarray(column).view(np.int64)) for column in (*total.T, *own.T)]
            columns += [pa.array(np.full(len(ids), part, dtype=np.int32)), pa.array(np.arange(at, at + len(ids)))]
            at += len(ids)
            yield pa.RecordBatch.from_arrays(columns, names=[*names, *sums, *owns, "part", "at"])

    ranged = rows.repartitionByRange("conv_id", *order).sortWithinPartitions("conv_id", *order)
    local = store(ranged.mapInArrow(run, schema), "trie-local")
    spans = local.groupBy("conv_id").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high")
    spans = store(spans.select("conv_id"), "trie-spans")
    if not spans.limit(1).count():
        return local.drop("part", "at")
    # Two ranges that follow each other share one conversation at most, so neither table is longer than the ranges are many.
    ends = local.join(F.broadcast(spans), "conv_id").groupBy("conv_id", "part").agg(F.max_by(F.struct(*sums), "at").alias("end"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carries = store(ends.select("conv_id", "part", *(_sum_over(F.col(f"end.{s}"), before).alias(f"{s}_carry") for s in sums)), "trie-carries")
    added = {s: F.when(F.col(f"{s}_carry").isNull(), F.col(s)).otherwise(_plus(F.col(s), F.col(f"{s}_carry"))) for s in sums}
    joined = local.join(F.broadcast(carries), ["conv_id", "part"], "left").withColumns(added)
    return joined.select(*names, *sums, *owns)


def _sum_over(value: Column, window) -> Column:
    """Sum modulo 2 ** 64; null for no row."""
    whole = F.pmod(F.sum(value.cast("decimal(38,0)")).over(window), F.lit(Decimal(1 << 64)))
    return F.when(whole >= F.lit(Decimal(1 << 63)), whole - F.lit(Decimal(1 << 64))).otherwise(whole).cast("long")


def _plus(a: Column, b: Column) -> Column:
    """Sum modulo 2 ** 64."""
    half = F.lit(0xFFFFFFFF)
    low = a.bitwiseAND(half) + b.bitwiseAND(half)
    high = F.shiftrightunsigned(a, 32) + F.shiftrightunsigned(b, 32) + F.shiftrightunsigned(low, 32)
    return F.shiftleft(high, 32).bitwiseOR(low.bitwiseAND(half))


def _minus(a: Column, b: Column) -> Column:
    """Difference modulo 2 ** 64."""
    return _plus(_plus(a, F.bitwise_not(b)), F.lit(1).cast("long"))


def numbered_turns(turns: DataFrame) -> DataFrame:
    """``conv_id, digest, words, place``, counted from 1 in each conversation; a stored table."""
    one = lambda batch: np.ones((batch.num_rows, 1), dtype=np.uint64)
    numbered = running(turns, [F.asc_nulls_first("turn"), "digest", "row"], one, ["place"], ["digest", "words"])
    return store(numbered.drop("place_own"), "trie-numbered")


def rebuilt(numbered: DataFrame, lengths: DataFrame) -> DataFrame:
    """``conv_id, place, digest, words`` of the turns of all rebuilt conversations."""
    head = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(HEADS))
    base = F.col("conv_id") - F.col("conv_id") % BASES
    plan = lengths.select("conv_id", base.alias("base"), head.cast("long").alias("head"))
    base_length = lengths.select(F.col("conv_id").alias("base"), F.col("turns").alias("base_turns"))
    plan = store(
        plan.join(base_length, "base", "left").select(
            "conv_id", "base", F.least("head", F.coalesce("base_turns", F.lit(0).cast("long"))).alias("taken"), "head"
        ),
        "trie-plan",
    )
    heads = numbered.where(F.col("place") < HEADS).withColumnRenamed("conv_id", "base")
    # A base has at most 2 * BASES - 1 conversations (around 0) and HEADS - 1 turns in heads.
    shared = plan.where("taken > 0").join(heads, "base").where("place <= taken").select("conv_id", "place", "digest", "words")
    moved = lengths.join(plan.select("conv_id", "taken", "head"), "conv_id").withColumnRenamed("turns", "rows")
    own = join_hot(numbered, store(moved, "trie-moved"), ["conv_id"], "rows").where("place > head")
    own = own.select("conv_id", (F.col("place") - F.col("head") + F.col("taken")).alias("place"), "digest", "words")
    return shared.unionByName(own)


def prefixes(turns: DataFrame) -> DataFrame:
    """``conv_id, depth, k1, k2, upto`` of every prefix of a turn or more, and the same before the turn: ``p1, p2, before``.

    ``upto`` counts words. A stored table.
    """

    def values(batch: pa.RecordBatch) -> np.ndarray:
        place, words, digest = batch.column(1), batch.column(2), batch.column(3)
        digests = np.frombuffer(b"".join(digest.to_pylist()), dtype=np.uint64).reshape(-1, 2)
        at = mixed(place.to_numpy().astype(np.uint64))
        return np.column_stack([words.to_numpy().astype(np.uint64), mixed(digests[:, 0] ^ at), mixed(digests[:, 1] + at)])

    summed = running(turns.select("conv_id", "place", "words", "digest"), ["place"], values, ["upto", "k1", "k2"], ["place"])
    before = {"p1": _minus(F.col("k1"), F.col("k1_own")), "p2": _minus(F.col("k2"), F.col("k2_own")), "before": F.col("upto") - F.col("upto_own")}
    return store(summed.withColumns(before).select("conv_id", F.col("place").alias("depth"), "k1", "k2", "upto", *before), "trie-prefixes")


def ends_hashed(ends: DataFrame) -> DataFrame:
    """Of every sequence (``depth, k1, k2``) the SHA-256 of the decimal ids that end there, in order; a stored table."""
    packed_schema = "depth long, k1 long, k2 long, part int, at long, ids string"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        key, held, size = None, [], 0
        for batch in batches:
            out = []
            for *here, conv_id in zip(*(column.to_pylist() for column in batch.columns)):
                if held and (here != key or size >= PACKED_BYTES):
                    out.append((*key, part, at, ",".join(held)))
                    held, size, at = [], 0, at + 1
                key = here
                held.append(str(conv_id))
                size += len(held[-1]) + 1
            yield rows_of(out, packed_schema)
        if held:
            yield rows_of([(*key, part, at, ",".join(held))], packed_schema)

    hashed_schema = "depth long, k1 long, k2 long, ends_sha256 string"

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            out = []
            for *here, ids in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2, 5))):
                if here != key:
                    if state is not None:
                        out.append((*key, state.hexdigest()))
                    key, state = here, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
            yield rows_of(out, hashed_schema)
        if state is not None:
            yield rows_of([(*key, state.hexdigest())], hashed_schema)

    ranged = ends.select(*NODE, "conv_id").repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id")
    packed = store(ranged.mapInArrow(pack, packed_schema), "trie-ends")
    whole = packed.repartition(*NODE).sortWithinPartitions(*NODE, "part", "at")
    return store(whole.mapInArrow(digest, hashed_schema), "trie-hashed")


def rows_of(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    fields = [field.split() for field in schema.split(", ")]
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], names=[n for n, _ in fields])


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256`` of every node."""
    turns = read_turns(conversations)
    numbered = numbered_turns(turns)
    lengths = store(numbered.groupBy("conv_id").agg(F.max("place").alias("turns")), "trie-lengths")
    steps = prefixes(rebuilt(numbered, lengths))
    discard(turns)

    # 1. Whole sequences, weighted.
    zero = F.lit(0).cast("long")
    last = steps.groupBy("conv_id").agg(F.max_by(F.struct("depth", "k1", "k2", "upto"), "depth").alias("end"))
    ends = store(
        lengths.select("conv_id").join(last, "conv_id", "left")
        .select("conv_id", *(F.coalesce(f"end.{name}", zero).alias(name) for name in (*NODE, "upto"))),
        "trie-sequences",
    )
    sequences = store(
        ends.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("weight"), F.max("upto").alias("whole")),
        "trie-weighted",
    )
    end_lists = ends_hashed(ends)

    # 2. Their prefixes.
    own = sequences.select("conv_id", F.col("depth").alias("rows"))
    own_steps = join_hot(steps, own.where("rows > 0"), ["conv_id"], "rows")
    root = sequences.select("conv_id", *(zero.alias(name) for name in (*NODE, "p1", "p2", "before")))
    paths = store(own_steps.select(*root.columns).unionByName(root), "trie-paths")
    nodes = store(paths.groupBy(*NODE).agg(*(F.min(name).alias(name) for name in ("conv_id", "p1", "p2", "before"))), "trie-nodes")

    # 3. Nodes that are no parent are leaves.
    children = store(
        nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2"))
        .agg(F.count(F.lit(1)).alias("n_children")),
        "trie-children",
    )
    leaves = sequences.join(children, NODE, "left_anti").select("conv_id", F.lit(1).cast("long").alias("leaf"))

    # 4. Weighted prefixes, node by node.
    tops = nodes.groupBy("conv_id").agg(F.min(F.struct("depth", "before")).alias("top"))
    told = store(
        sequences.select("conv_id", "weight", "whole", (F.col("depth") + 1).alias("rows"))
        .join(leaves, "conv_id", "left").join(tops, "conv_id", "left")
        .select("conv_id", "rows", "weight", "whole", F.coalesce("leaf", zero).alias("leaf"), F.col("top.depth").alias("top"), F.col("top.before").alias("top_before")),
        "trie-told",
    )
    named = F.when(F.col("top").isNull(), zero).otherwise(F.col("whole") - F.when(F.col("depth") >= F.col("top"), F.col("before")).otherwise(F.col("top_before")))
    sums = store(
        join_hot(paths, told, ["conv_id"], "rows").groupBy(*NODE).agg(
            F.sum("weight").alias("n_convs"),
            F.sum("leaf").alias("n_leaves"),
            F.sum(F.col("weight") * (F.col("whole") - F.col("before")) - named).alias("saved_tokens"),
        ),
        "trie-sums",
    )
    parents = store(
        children.withColumnRenamed("n_children", "rows")
        .join(nodes.select(*NODE, F.col("conv_id").alias("parent_conv_id")), NODE)
        .select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), "parent_conv_id", "rows"),
        "trie-parents",
    )
    below = join_hot(nodes.where("depth > 0"), parents, ["depth", "p1", "p2"], "rows").select(*NODE, "conv_id", "parent_conv_id")
    above = nodes.where("depth = 0").select(*NODE, "conv_id", F.lit(None).cast("long").alias("parent_conv_id"))
    return (
        below.unionByName(above).join(sums, NODE).join(children, NODE, "left").join(end_lists, NODE, "left")
        .select(
            "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"), "n_leaves", "saved_tokens",
            F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
        )
    )
