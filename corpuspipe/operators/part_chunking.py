"""Chunks of sources that are stored as several parts, equal to those of their whole text.

Where a chunk ends depends on the characters after its start only, so a part can be cut without the parts before it once
the place of its first chunk is known. That place is one of the first ``chunk_size`` characters. Each segment of text
therefore tells, for every such entry, where the first chunk of the next segment would start and how many chunks that
makes: a short map, since chains from different entries soon meet. Maps are composed in a tree with a fixed fan, the
entries are handed down the same tree, and then all segments are cut at once. No task holds more than a segment.

Defined results: empty parts add nothing, and a source without characters has no chunk. A null text is an empty part.
Parts with the same number are taken in the order of their texts. Keys that are null name one source.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from corpuspipe.operators.chunking import DELIMITERS, Settings, split_texts
from corpuspipe.operators.scale import pinned

# Characters of a segment: what one row of the map and of the cut holds (a longer part is a longer segment).
SEGMENT_CHARS = 16 << 20

# Segments that one node of the tree joins.
FAN = 64


def chunk_end(text: str, start: int, settings: Settings) -> int:
    """Where the chunk that starts at ``start`` ends, by the rule of ``chunking``."""
    if len(text) - start <= settings.chunk_size:
        return len(text)
    for mark in DELIMITERS:
        found = text.rfind(mark, start + settings.head, start + settings.chunk_size)
        if found >= 0:
            return found + len(mark)
    return start + settings.chunk_size


def _same_end(text: str, low: int, high: int, settings: Settings) -> Iterator[tuple[int, int]]:
    """Stretches of starts from ``low`` to ``high`` whose chunks end at one place: first start and that place.

    A later start never has an earlier end: what it could end at lies in the earlier start's window too, or behind that.
    So a stretch is found by doubling steps and halving the last one.
    """
    while low < high:
        reached, inside, beyond, step = chunk_end(text, low, settings), low, high, 1
        while inside + step < high:
            if chunk_end(text, inside + step, settings) != reached:
                beyond = inside + step
                break
            inside, step = inside + step, 2 * step
        while beyond - inside > 1:
            middle = (inside + beyond) // 2
            if chunk_end(text, middle, settings) == reached:
                inside = middle
            else:
                beyond = middle
        yield low, reached
        low = beyond


def exits(text: str, after: str, entries: int, settings: Settings) -> tuple[list[int], list[int], list[int]]:
    """For the entries 0, 1, ... into a segment the entry into the next one, and the chunks that start on the way.

    Entries in a row with the same answer are one: its first entry, the exit and the count. Chains of chunks that meet
    go on as one, so there are few.
    """
    whole = text + after
    inner = min(entries, len(text))
    stretches = list(_same_end(whole, 0, inner, settings))
    known: dict[int, tuple[int, int]] = {}  # place -> exit from there, and the chunks that start on the way
    firsts, ends, counts = [], [], []
    for first, place in stretches:
        way = []
        while place < len(text) and place not in known:
            way.append(place)
            place = chunk_end(whole, place, settings)
        end, count = known[place] if place < len(text) else (place - len(text), 0)
        for passed in reversed(way):
            count += 1
            known[passed] = end, count
        if not firsts or (ends[-1], counts[-1]) != (end, count + 1):
            firsts.append(first)
            ends.append(end)
            counts.append(count + 1)
    # A short segment is passed over by the entries behind it.
    for entry in range(inner, entries):
        firsts.append(entry)
        ends.append(entry - len(text))
        counts.append(0)
    return firsts, ends, counts


def _segments(parts: DataFrame, keys: list[str], part: str, text_column: str, joiner: str, size: int, settings: Settings) -> DataFrame:
    """Consecutive parts joined to segments of about ``size`` characters, ``k`` = 0, 1, ... of ``n`` in each source; stored.

    Each has the characters that its chunks look at, some ``after`` it and some before it (``tail``). Of any two segments that
    follow each other, one and the next together are longer than that, so a part gives them to two segments on either side.
    """
    own = F.coalesce(F.col(text_column), F.lit(""))
    held = parts.select(*keys, part, own.alias("text"))
    held = held.select("*", F.xxhash64("text").alias("hash"), F.char_length("text").cast("long").alias("chars"))
    held = pinned(held.withColumn("row", F.monotonically_increasing_id()))
    # One short row for each part.
    in_order = Window.partitionBy(*keys).orderBy(part, "hash", "row")
    sizes = held.select(*keys, part, "hash", "row", "chars").withColumn("first", F.row_number().over(in_order) == 1)
    sizes = sizes.withColumn("chars", F.col("chars") + F.when(F.col("first"), 0).otherwise(len(joiner)))
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    placed = sizes.withColumn("start", F.coalesce(F.sum("chars").over(before), F.lit(0)))
    placed = placed.withColumn("block", F.floor(F.col("start") / size))
    blocks = Window.partitionBy(*keys).orderBy("block")
    placed = placed.withColumn("k", (F.dense_rank().over(blocks) - 1).cast("long"))
    source, numbered = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("k")
    here = numbered.rangeBetween(0, 0)
    end = F.col("start") + F.col("chars")
    placed = placed.select(
        "row", "first", "start", end.alias("end"), "k",
        (F.max("k").over(source) + 1).alias("n"),
        F.min("start").over(here).alias("low"),
        F.min("start").over(numbered.rangeBetween(-1, -1)).alias("low_before"),
        F.max(end).over(here).alias("high"),
        F.max(end).over(numbered.rangeBetween(1, 1)).alias("high_after"),
    )
    whole = F.concat(F.when(F.col("first"), "").otherwise(joiner), F.col("text"))
    joined = held.select(*keys, "row", "text").join(placed, "row").withColumn("text", whole)

    def given(to: Column, kind: int, text: Column) -> Column:
        return F.struct(to.alias("k"), F.lit(kind).alias("kind"), text.alias("text"))

    def head(to: Column, low: Column) -> Column:
        wanted = F.lit(settings.chunk_size + 1) + low - F.col("start")
        return F.when((to >= 0) & (wanted > 0), given(to, 1, F.left("text", wanted.cast("int"))))

    def tail(to: Column, high: Column) -> Column:
        wanted = F.lit(settings.overlap_size) - (high - F.col("end"))
        return F.when((to < F.col("n")) & (wanted > 0), given(to, 2, F.right("text", wanted.cast("int"))))

    k = F.col("k")
    pieces = F.array_compact(
        F.array(
            given(k, 0, F.col("text")),
            head(k - 1, F.col("low")),
            head(k - 2, F.col("low_before")),
            tail(k + 1, F.col("high")),
            tail(k + 2, F.col("high_after")),
        )
    )
    rows = joined.select(*keys, "n", "start", "low", F.explode(pieces).alias("piece")).select(*keys, "n", "start", "low", "piece.*")

    def text(kind: int) -> Column:
        chosen = F.collect_list(F.when(F.col("kind") == kind, F.struct("start", "text")))
        return F.array_join(F.transform(F.array_sort(chosen), lambda one: one["text"]), "")

    made = rows.groupBy(*keys, "k").agg(
        F.max("n").alias("n"),
        F.min(F.when(F.col("kind") == 0, F.col("low"))).alias("start"),
        text(0).alias("text"),
        F.left(text(1), F.lit(settings.chunk_size + 1)).alias("after"),
        F.right(text(2), F.lit(settings.overlap_size)).alias("tail"),
    )
    return pinned(made)


def _rejoined(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Inner join on columns that may be null."""
    other = right.select(*(F.col(name).alias(f"{name}__") if name in on else F.col(name) for name in right.columns))
    same = [F.col(name).eqNullSafe(F.col(f"{name}__")) for name in on]
    joined = left
    condition = same[0]
    for more in same[1:]:
        condition = condition & more
    return joined.join(other, condition).drop(*(f"{name}__" for name in on))


_MAP = ("firsts", "exits", "counts")


def _maps(segments: DataFrame, keys: list[str], settings: Settings) -> DataFrame:
    """``keys, k, n`` and the map (``firsts, exits, counts``) of all segments of sources that have several.

    A first segment is entered at its beginning only, and none asks where a last one is left, so that has no map.
    """
    kept = segments.select(*keys, "k", "n").schema
    width = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [
                exits(text.as_py(), after.as_py(), settings.chunk_size if k.as_py() else 1, settings)
                for k, text, after in zip(batch.column(width - 2), batch.column(width), batch.column(width + 1))
            ]
            columns = [pa.array([one[n] for one in made], pa.list_(pa.int64())) for n in range(len(_MAP))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], *columns], names=[*kept.names, *_MAP])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"{name} array<bigint>" for name in _MAP])
    last = F.col("k") == F.col("n") - 1
    mapped = segments.where(~last).select(*keys, "k", "n", "text", "after").mapInArrow(run, schema)
    none = [F.array().cast("array<bigint>").alias(name) for name in _MAP]
    return mapped.unionByName(segments.where(last & (F.col("n") > 1)).select(*keys, "k", "n", *none))


def _answer(member: Column, entry: Column, name: str) -> Column:
    """What a map says of an entry; nothing where it has no answer."""
    return F.get(member[name], F.size(F.filter(member["firsts"], lambda first: first <= entry)) - 1)


def _composed(members: Column) -> Column:
    """The map of consecutive maps, as triples: the entries that the first one takes as one stay one."""
    first = F.get(members, F.lit(0))
    start = F.transform(
        F.arrays_zip(first["firsts"], first["exits"], first["counts"]),
        lambda run: F.struct(run["firsts"].alias("first"), run["exits"].alias("exit"), run["counts"].alias("n")),
    )

    def follow(so_far: Column, member: Column) -> Column:
        return F.transform(
            so_far,
            lambda at: F.struct(
                at["first"].alias("first"),
                _answer(member, at["exit"], "exits").alias("exit"),
                (at["n"] + _answer(member, at["exit"], "counts")).alias("n"),
            ),
        )

    return F.aggregate(F.slice(members, 2, FAN), start, follow)


def _entries(maps: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, k, entry, before``: where each segment's first chunk starts in it, and how many chunks come before.

    A source goes up the tree until one node holds it, so most are done on the lowest level.
    """
    levels = []
    while True:
        members = F.array_sort(F.collect_list(F.struct("k", *_MAP))).alias("members")
        nodes = F.ceil(F.max("n") / FAN).alias("n")
        level = pinned(maps.groupBy(*keys, F.floor(F.col("k") / FAN).alias("up")).agg(members, nodes))
        levels.append(level)
        if not level.where("n > 1").limit(1).count():
            break
        inner = F.when(F.col("up") < F.col("n") - 1, _composed(F.col("members")))
        both = level.where("n > 1").select(*keys, F.col("up").alias("k"), "n", F.coalesce(inner, F.array()).alias("both"))
        maps = both.select(
            *keys, "k", "n", F.col("both.first").alias("firsts"), F.col("both.exit").alias("exits"), F.col("both.n").alias("counts")
        )
    zero = F.lit(0).cast("long")
    known = None
    for level in reversed(levels):
        first = F.struct(F.col("entry"), F.col("before"), F.array().cast("array<struct<k:bigint,entry:bigint,before:bigint>>").alias("told"))

        def tell(state: Column, member: Column) -> Column:
            return F.struct(
                _answer(member, state["entry"], "exits").alias("entry"),
                (state["before"] + _answer(member, state["entry"], "counts")).alias("before"),
                F.concat(
                    state["told"], F.array(F.struct(member["k"].cast("long").alias("k"), state["entry"].alias("entry"), state["before"].alias("before")))
                ).alias("told"),
            )

        asked = level.where("n = 1").select(*keys, "members", zero.alias("entry"), zero.alias("before"))
        if known is not None:
            deeper = _rejoined(level.where("n > 1").withColumnRenamed("up", "k"), known, [*keys, "k"])
            asked = asked.unionByName(deeper.select(*keys, "members", "entry", "before"))
        known = asked.select(*keys, F.inline(F.aggregate("members", first, tell, lambda state: state["told"])))
    return known


def chunks_of_parts(
    parts: DataFrame,
    keys: list[str],
    settings: Settings,
    part: str = "part",
    text_column: str = "parsed_text",
    joiner: str = "",
    segment_chars: int = SEGMENT_CHARS,
) -> DataFrame:
    """``keys`` and the chunk fields of each source, whose text are its parts in order with ``joiner`` between them.

    Same chunks, overlaps and offsets as ``split_texts`` of the whole text; offsets and numbers are LONG.
    """
    size = max(segment_chars, settings.chunk_size + 1, settings.overlap_size + 1)
    named = parts.select(*keys, part, text_column)
    segments = _segments(named, keys, part, text_column, joiner, size, settings)
    entries = _entries(_maps(segments, keys, settings), keys)
    # A source of one segment is entered at its beginning; its text is not moved again.
    zero = F.lit(0).cast("long")
    placed = _rejoined(segments.where("n > 1"), entries, [*keys, "k"])
    placed = placed.unionByName(segments.where("n = 1").select("*", zero.alias("entry"), zero.alias("before")))
    skipped = F.expr("left(text, cast(entry AS INT))")
    rest = placed.where(F.col("entry") < F.char_length("text")).select(
        *keys,
        (F.col("start") + F.col("entry")).alias("at"),
        "before",
        (F.char_length("text") - F.col("entry")).alias("own"),
        F.right(F.concat("tail", skipped), F.lit(settings.overlap_size)).alias("tail"),
        F.concat(F.expr("substring(text, cast(entry AS INT) + 1)"), "after").alias("text"),
    )
    cut = split_texts(rest, settings, "text").where(F.col("character_start_offset") < F.col("own"))
    inner = F.col("character_start_offset") >= settings.overlap_size
    overlap = F.when(inner, F.col("overlap_text")).otherwise(F.right(F.concat("tail", "overlap_text"), F.lit(settings.overlap_size)))
    return cut.select(
        *keys,
        (F.col("before") + F.col("chunk_number")).alias("chunk_number"),
        "chunk_text",
        overlap.alias("overlap_text"),
        (F.col("at") + F.col("character_start_offset")).alias("character_start_offset"),
        (F.col("at") + F.col("character_end_offset")).alias("character_end_offset"),
    )
