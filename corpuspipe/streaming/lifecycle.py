"""Folding ingestion events into the state of each attempt, in batch and as a stream.

An attempt has one of six states, so a stretch of its events is a function from six states to six
states, and such functions compose. The batch fold uses that: every sorted range works out the functions
of the attempts that reach over its edge, the few edge rows are chained, and then all ranges run at once
from known states. One attempt may hold any share of the events. Functions are rows of six small numbers, and
numpy composes a whole batch of them in as many steps as its length has binary digits.

The stream keeps what has not been applied yet in the state store, in order of arrival, and applies it in order of
time once the watermark has passed it. So events may come out of order, over any number of triggers.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from corpuspipe.operators.scale import in_ranges

# Phases of a running attempt.
PHASES = ("not_started", "preflight", "parsing", "splitting", "atomic_text_commit", "text_committed")

# "closing" is a stopping attempt without staged work left, as closing the application makes it.
STATES = ("idle", "running", "stopping", "closing", "paused", "complete")
_WORK_LEFT = frozenset(("running", "stopping", "paused"))
_RESTING = frozenset(("idle", "complete"))

# (action, state) -> next state. Pairs not listed are refused.
_MOVES = {
    ("start", "idle"): "running",
    ("start", "complete"): "running",
    ("stop", "running"): "stopping",
    ("resume", "paused"): "running",
    ("phase", "running"): "running",
    ("complete", "running"): "complete",
    ("finish_with_work", "stopping"): "paused",
    ("finish_with_work", "closing"): "paused",
    ("finish", "stopping"): "idle",
    ("finish", "closing"): "idle",
    ("close", "running"): "closing",
    ("close", "stopping"): "closing",
    ("close", "closing"): "closing",
    ("close", "paused"): "closing",
}
_IGNORED = frozenset(
    (("stop", "stopping"), ("stop", "closing"), ("close", "idle"), ("close", "complete"))
)
_NAMES_ATTEMPT = frozenset(("phase", "finish", "finish_with_work", "complete"))
_LATE = frozenset(("stopping", "closing", "paused"))


def step(state: str, phase: str, action: str, new_phase: str | None) -> tuple[str, str, str | None]:
    """State, phase and reason of refusal (null when accepted) after one event."""
    moved = _MOVES.get((action, state))
    if moved is None or (action == "phase" and new_phase not in PHASES):
        if (action, state) in _IGNORED:
            return state, phase, "ignored"
        if action in _NAMES_ATTEMPT and state == "idle":
            return state, phase, "stale"
        if action == "complete" and state in _LATE:
            return state, phase, "late"
        return state, phase, "invalid"
    if action == "start":
        return moved, "preflight", None
    if action == "phase":
        return moved, new_phase, None
    return moved, "not_started" if moved in _RESTING else phase, None


_EVENT_COLUMNS = ("attempt_id", "event_time", "event_id", "action", "phase")
_RESULT = (
    "attempt_id string, event_id long, action string, outcome string, "
    "status string, phase string, staged_work_remaining boolean"
)
_RESULT_COLUMNS = [column.split()[0] for column in _RESULT.split(", ")]
_ResultRow = Row(*_RESULT_COLUMNS)

# A state and a phase as one number: place of the state times _WIDTH, plus place of the phase from 1, or 0 where a
# stretch of events leaves the phase alone.
_WIDTH = len(PHASES) + 1
_KEPT = "\0"
_IDENTITY = np.arange(len(STATES), dtype=np.int8) * _WIDTH
_FRESH = STATES.index("idle") * _WIDTH + 1 + PHASES.index("not_started")

_ACTIONS = sorted({action for action, _ in _MOVES})
_REASONS = ("accepted", "ignored", "stale", "late", "invalid")


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Of every kind of event (see ``_kinds``): the code and the reason it gives in each state."""
    kinds = [(action, None) for action in _ACTIONS] + [(None, None)] + [("phase", phase) for phase in PHASES]
    codes = np.zeros((len(kinds), len(STATES)), dtype=np.int8)
    reasons = np.zeros((len(kinds), len(STATES)), dtype=np.int8)
    for kind, (action, new_phase) in enumerate(kinds):
        for place, before in enumerate(STATES):
            state, phase, reason = step(before, _KEPT, action, new_phase)
            codes[kind, place] = STATES.index(state) * _WIDTH + (0 if phase == _KEPT else 1 + PHASES.index(phase))
            reasons[kind, place] = _REASONS.index(reason or "accepted")
    return codes, reasons


_CODES, _WHY = _tables()


def _kinds(actions: pd.Series, phases: pd.Series) -> np.ndarray:
    """Number of every event's kind: its action (unknown ones share a kind), and the phase where that counts."""
    kind = pd.Index(_ACTIONS).get_indexer(actions)
    known = pd.Index(PHASES).get_indexer(phases)
    named = (kind == _ACTIONS.index("phase")) & (known >= 0)
    kind[kind < 0] = len(_ACTIONS)
    return np.where(named, len(_ACTIONS) + 1 + known, kind)


def _then(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Rows of functions: ``first``, and after it ``second``."""
    state, phase = np.divmod(first, _WIDTH)
    code = np.take_along_axis(second, state.astype(np.intp), axis=1)
    return np.where(code % _WIDTH == 0, code + phase, code).astype(np.int8)


def _whole(functions: np.ndarray) -> np.ndarray:
    """All rows one after the other as one function: neighbours are joined until one is left."""
    while len(functions) > 1:
        odd = functions[len(functions) // 2 * 2 :]
        functions = np.concatenate([_then(functions[0:-1:2], functions[1::2]), odd])
    return functions[0]


def _running(functions: np.ndarray) -> np.ndarray:
    """Row i becomes rows 0 to i one after the other; each step doubles the reach."""
    reach = 1
    while reach < len(functions):
        functions = np.concatenate([functions[:reach], _then(functions[:-reach], functions[reach:])])
        reach *= 2
    return functions


def _apply(codes: np.ndarray, entered: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """Code after every event. ``entered`` is the code before each row that ``fresh`` marks; the first row is one.

    The first event of an attempt becomes a constant function, which forgets what came before it.
    """
    functions = codes.copy()
    begin = np.flatnonzero(fresh)
    known = _then(np.repeat(entered[begin, None], len(STATES), axis=1), codes[begin])
    functions[begin] = known
    return _running(functions)[:, 0]


def _outcomes(batch: pd.DataFrame, entered: np.ndarray, fresh: np.ndarray) -> tuple[pd.DataFrame, int]:
    """Result rows of sorted events, and the code after the last one."""
    kinds = _kinds(batch["action"], batch["phase"])
    after = _apply(_CODES[kinds], entered, fresh)
    before = np.where(fresh, entered, np.concatenate([after[:1], after[:-1]]))
    state, phase = np.divmod(after, _WIDTH)
    states, actions = np.array(STATES, dtype=object), batch["action"].to_numpy(dtype=object)
    rows = pd.DataFrame(
        {
            "attempt_id": batch["attempt_id"].to_numpy(dtype=object),
            "event_id": batch["event_id"].to_numpy(),
            "action": np.where(actions == "finish_with_work", "finish", actions),
            "outcome": np.array(_REASONS, dtype=object)[_WHY[kinds, before // _WIDTH]],
            "status": np.where(states[state] == "closing", "stopping", states[state]),
            "phase": np.array(PHASES, dtype=object)[phase - 1],
            "staged_work_remaining": np.array([name in _WORK_LEFT for name in STATES])[state],
        },
        columns=_RESULT_COLUMNS,
    )
    return rows, int(after[-1])


def _changes(attempts: pd.Series, current: str | None) -> np.ndarray:
    """Marks the rows that start another attempt; nulls are one attempt."""
    names = pd.concat([pd.Series([current], dtype=object), attempts.astype(object)], ignore_index=True)
    number = pd.factorize(names)[0]
    return number[1:] != number[:-1]


def _edge_functions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The functions of the first and the last attempt of a sorted range."""
    edges: list[tuple[str, int, np.ndarray]] = []
    for batch in batches:
        if batch.empty:
            continue
        functions = _CODES[_kinds(batch["action"], batch["phase"])]
        starts = np.flatnonzero(_changes(batch["attempt_id"], edges[-1][0] if edges else None))
        if not edges:
            starts = np.union1d(starts, [0])
        if len(starts) == 0 or starts[0] > 0:
            attempt, part, so_far = edges[-1]
            here = _whole(functions[: starts[0] if len(starts) else None])
            edges[-1] = attempt, part, _then(so_far[None], here[None])[0]
        # Attempts that lie inside the range only need no function: the first and the last stay.
        for number, start in enumerate(starts):
            last = number == len(starts) - 1
            if not edges or last:
                stop = None if last else starts[number + 1]
                if len(edges) == 2:
                    edges.pop()
                attempt = batch["attempt_id"].iloc[start]
                edges.append((attempt, int(batch["_range"].iloc[start]), _whole(functions[start:stop])))
    rows = [(attempt, part, [int(code) for code in function]) for attempt, part, function in edges]
    yield pd.DataFrame(rows, columns=["attempt_id", "_range", "codes"])


def _chain(edges: pd.DataFrame) -> pd.DataFrame:
    """The code with which an attempt enters each range it reaches into."""
    ordered = edges.sort_values("_range")
    functions = np.stack(ordered["codes"].to_list()).astype(np.int8)
    fresh = np.arange(len(functions)) == 0
    after = _apply(functions, np.full(len(functions), _FRESH, dtype=np.int8), fresh)
    entered = np.concatenate([[_FRESH], after[:-1]]).astype(np.int32)
    return pd.DataFrame({"attempt_id": ordered["attempt_id"], "_range": ordered["_range"], "_entered": entered})


def _run_ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    current, code, begun = None, _FRESH, False
    for batch in batches:
        if batch.empty:
            continue
        fresh = _changes(batch["attempt_id"], current)
        entered = batch["_entered"].fillna(_FRESH).to_numpy(dtype=np.int8)
        if begun and not fresh[0]:
            entered[0] = code
        fresh[0] = begun = True
        rows, code = _outcomes(batch, entered, fresh)
        current = batch["attempt_id"].iloc[-1]
        yield rows.assign(_no_id=batch["_no_id"].to_numpy())


def fold_attempts(events: DataFrame) -> DataFrame:
    """Every event with its outcome and the state after it.

    ``events`` has ``attempt_id, event_time, event_id, action, phase``; actions are start, stop,
    finish_with_work, finish, resume, phase, complete and close. Any other action, null too, is invalid. Events without an
    attempt count as one attempt's. Events of one time go by their id.
    """
    placed = in_ranges(events.select(*_EVENT_COLUMNS), "attempt_id", "event_time", "event_id")
    edges = placed.mapInPandas(_edge_functions, "attempt_id string, _range int, codes array<int>")
    entries = edges.groupBy("attempt_id").applyInPandas(_chain, "attempt_id string, _range int, _entered int")
    # At most two rows per range, so the table is bounded by the number of shuffle partitions.
    entries = F.broadcast(entries.select(F.col("attempt_id").alias("_attempt"), F.col("_range").alias("_part"), "_entered"))
    same = F.col("attempt_id").eqNullSafe(F.col("_attempt")) & (F.col("_range") == F.col("_part"))
    # Pandas has a column with nulls as doubles, which do not hold every id.
    known = placed.join(entries, same, "left").withColumn("_no_id", F.col("event_id").isNull()).fillna(0, ["event_id"])
    folded = known.mapInPandas(_run_ranges, f"{_RESULT}, _no_id boolean")
    return folded.withColumn("event_id", F.when(~F.col("_no_id"), F.col("event_id"))).drop("_no_id")


LATE_EVENT = "late_event"
_STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _millis(event: tuple) -> int:
    """Time of an event in milliseconds, rounded up: the watermark has to pass all of it."""
    return -(-event[0] // 1000)


def _in_order(event: tuple) -> tuple:
    return event[0], event[1] is not None, event[1] or 0


def _columns(events: list[tuple]) -> tuple[list, ...]:
    return tuple(map(list, zip(*events)))


class _Attempts(StatefulProcessor):
    """One attempt: its code with the time of the last event, and the events that wait for the watermark.

    An element of the list holds the columns of the events that came together. The list is read once for each trigger in
    which the watermark passes an event of the attempt.
    """

    def __init__(self, keep_millis: int | None):
        self.keep_millis = keep_millis

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.code = handle.getValueState("code", "code int, last long")
        self.waiting = handle.getListState(
            "waiting", "micros array<long>, event_ids array<long>, actions array<string>, phases array<string>"
        )

    def _known(self) -> tuple[str, str]:
        code = (self.code.get() or (_FRESH,))[0]
        return STATES[code // _WIDTH], PHASES[code % _WIDTH - 1]

    def _advance(self, attempt: str | None, events: list[tuple]) -> list[Row]:
        # One event after the other: most attempts have few, for which whole columns would cost more.
        (state, phase), rows = self._known(), []
        for _, event, action, new_phase in sorted(events, key=_in_order):
            state, phase, reason = step(state, phase, action, new_phase)
            rows.append(_result_row(attempt, event, action, state, phase, reason or "accepted"))
        last = max(map(_millis, events))
        self.code.update((STATES.index(state) * _WIDTH + 1 + PHASES.index(phase), last))
        if self.keep_millis is not None:
            self.handle.registerTimer(last + self.keep_millis)
        return rows

    def _late(self, attempt: str | None, events: list[tuple]) -> list[Row]:
        state, phase = self._known()
        return [_result_row(attempt, event, action, state, phase, LATE_EVENT) for _, event, action, _ in events]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        passed, early, late = timerValues.getCurrentWatermarkInMs(), [], []
        for row in rows:
            event = row["micros"], row["event_id"], row["action"], row["phase"]
            (late if 0 < passed and _millis(event) <= passed else early).append(event)
        if early:
            self.waiting.appendValue(_columns(early))
            self.handle.registerTimer(min(map(_millis, early)))
        if late:
            yield from self._late(key[0], late)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs()
        events = [event for columns in self.waiting.get() for event in zip(*columns)]
        due = [event for event in events if _millis(event) <= passed]
        left = [event for event in events if _millis(event) > passed]
        if due and left:
            self.waiting.put([_columns(left)])
            self.handle.registerTimer(min(map(_millis, left)))
        elif due:
            self.waiting.clear()
        if due:
            yield from self._advance(key[0], due)
        elif not left and self.keep_millis is not None:
            known = self.code.get()
            if known and known[1] + self.keep_millis <= passed:
                self.code.clear()


def _result_row(attempt: str | None, event: int | None, action: str | None, state: str, phase: str, outcome: str) -> Row:
    status = "stopping" if state == "closing" else state
    shown = "finish" if action == "finish_with_work" else action
    return _ResultRow(attempt, event, shown, outcome, status, phase, state in _WORK_LEFT)


@contextmanager
def state_store(spark: SparkSession):
    """Streams started inside use a state store that can hold lists and timers beside a state."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, _STATE_STORE)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def fold_attempt_stream(
    events: DataFrame, delay: str = "10 minutes", keep: datetime.timedelta | None = None
) -> DataFrame:
    """The same fold over a streaming frame; start the stream inside ``state_store``.

    An event is applied once the watermark, which runs ``delay`` behind the latest time seen, has passed it; until then it
    waits in the state store. So events may come in any order within ``delay``, in one trigger or over many, and the result
    is that of the batch fold. An event that comes when the watermark has passed its time changes nothing: its outcome is
    ``late_event``, with the state it meets. A task holds of one attempt what came within ``delay`` and in one trigger. What
    still waits when a stream ends is applied as soon as a later event moves the watermark. ``keep`` drops the state of an
    attempt that had no event for so long; a further event finds it idle. Events without a time count as of 1970.
    """
    # The watermark stands on a copy of the time, so that late events reach the fold instead of being dropped before it.
    timed = events.select(*_EVENT_COLUMNS, F.col("event_time").alias("_seen")).withWatermark("_seen", delay)
    processor = _Attempts(int(keep.total_seconds() * 1000) if keep is not None else None)
    micros = F.coalesce(F.unix_micros("event_time"), F.lit(0)).alias("micros")
    return (
        timed.select("attempt_id", micros, "event_id", "action", "phase")
        .groupBy("attempt_id")
        .transformWithState(processor, _RESULT, "Append", "EventTime")
    )


def outcome_counts(folded: DataFrame) -> DataFrame:
    """Events per attempt and outcome; counted map-side before the shuffle."""
    return folded.groupBy("attempt_id", "outcome").agg(F.count(F.lit(1)).alias("event_count"))
