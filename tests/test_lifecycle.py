import datetime
import random

import pandas as pd
import pytest

from corpuspipe.streaming import lifecycle
from corpuspipe.streaming.lifecycle import PHASES, STATES, fold_attempt_stream, fold_attempts, step

ACTIONS = ["start", "stop", "resume", "phase", "complete", "finish", "finish_with_work", "close"]
SCHEMA = "attempt_id string, event_time timestamp, event_id long, action string, phase string"

RULES = [
    ("idle", "start", "running", None),
    ("complete", "start", "running", None),
    ("paused", "start", "paused", "invalid"),
    ("running", "stop", "stopping", None),
    ("stopping", "stop", "stopping", "ignored"),
    ("idle", "stop", "idle", "invalid"),
    ("stopping", "finish_with_work", "paused", None),
    ("stopping", "finish", "idle", None),
    ("running", "finish", "running", "invalid"),
    ("idle", "finish", "idle", "stale"),
    ("paused", "resume", "running", None),
    ("closing", "resume", "closing", "invalid"),
    ("running", "complete", "complete", None),
    ("paused", "complete", "paused", "late"),
    ("stopping", "complete", "stopping", "late"),
    ("idle", "complete", "idle", "stale"),
    ("complete", "complete", "complete", "invalid"),
    ("paused", "close", "closing", None),
    ("idle", "close", "idle", "ignored"),
]


@pytest.mark.parametrize("state,action,after,reason", RULES)
def test_rules(state, action, after, reason):
    found = step(state, "parsing", action, None)
    assert (found[0], found[2]) == (after, reason)


def test_phases():
    assert step("running", "preflight", "phase", "parsing") == ("running", "parsing", None)
    assert step("running", "preflight", "phase", "unknown") == ("running", "preflight", "invalid")
    assert step("idle", "not_started", "start", None) == ("running", "preflight", None)
    assert step("running", "splitting", "complete", None) == ("complete", "not_started", None)
    assert step("stopping", "splitting", "finish_with_work", None) == ("paused", "splitting", None)


def events(count, seed, hot=0.6):
    pick = random.Random(seed)
    start = datetime.datetime(2026, 1, 1)
    rows = []
    for i in range(count):
        attempt = "hot" if pick.random() < hot else f"a{pick.randrange(40)}"
        moment = start + datetime.timedelta(seconds=pick.randrange(count))
        rows.append((attempt, moment, i, pick.choice(ACTIONS), pick.choice([*PHASES, "unknown"])))
    return rows


def one_by_one(rows):
    current, result = {}, {}
    for attempt, _, event, action, phase in sorted(rows, key=lambda r: (r[1], r[2])):
        state, kept = current.get(attempt, ("idle", "not_started"))
        state, kept, reason = step(state, kept, action, phase)
        current[attempt] = (state, kept)
        result[event] = (attempt, reason or "accepted", "stopping" if state == "closing" else state, kept)
    return result


def outcome(frame):
    return {r.event_id: (r.attempt_id, r.outcome, r.status, r.phase) for r in frame.collect()}


def test_fold_with_a_hot_attempt_over_many_ranges(spark):
    rows = events(6000, 3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        folded = fold_attempts(spark.createDataFrame(rows, SCHEMA).repartition(5))
        assert outcome(folded) == one_by_one(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_edges_chain_over_ranges():
    """The functions of two stretches give the state in which the third is entered."""
    first = pd.DataFrame([("a", 0, "start", None), ("a", 0, "phase", "parsing")], columns=["attempt_id", "_range", "action", "phase"])
    second = pd.DataFrame([("a", 1, "stop", None), ("b", 1, "start", None)], columns=first.columns)
    edges = pd.concat([*lifecycle._edge_functions(iter([first])), *lifecycle._edge_functions(iter([second]))])
    chained = lifecycle._chain(edges[edges["attempt_id"] == "a"])
    running = lifecycle.STATES.index("running") * lifecycle._WIDTH + 1 + PHASES.index("parsing")
    assert chained.values.tolist() == [["a", 0, lifecycle._FRESH], ["a", 1, running]]


def test_edges_do_not_depend_on_batches():
    """One range in batches of any size has the same edges: those of its first and its last attempt."""
    rows = [("a", 0, action, phase) for _, _, _, action, phase in events(7, 1)]
    rows += [(f"b{i}", 0, "start", None) for i in range(5)]
    rows += [("c", 0, action, phase) for _, _, _, action, phase in events(9, 2)]
    whole = pd.DataFrame(rows, columns=["attempt_id", "_range", "action", "phase"])
    for number in (len(rows), 1, 2, 5):
        batches = [whole[at : at + number] for at in range(0, len(rows), number)]
        (edges,) = lifecycle._edge_functions(iter(batches))
        assert edges["attempt_id"].tolist() == ["a", "c"]
        for name, codes in zip(edges["attempt_id"], edges["codes"]):
            for place, before in enumerate(STATES):
                state, phase = before, "\0"
                for _, _, action, new_phase in (row for row in rows if row[0] == name):
                    state, phase, _ = step(state, phase, action, new_phase)
                wanted = STATES.index(state) * lifecycle._WIDTH + (0 if phase == "\0" else 1 + PHASES.index(phase))
                assert codes[place] == wanted


def test_odd_events(spark):
    """Unknown and null actions are invalid, a null attempt is one attempt, an empty table stays empty."""
    start = datetime.datetime(2026, 1, 1)
    rows = [(None, start, 1, "start", None), (None, start, 2, None, None), (None, start, 3, "dance", "parsing"),
            ("a", start, 4, "phase", None), (None, start, 5, "phase", "parsing")]
    found = outcome(fold_attempts(spark.createDataFrame(rows, SCHEMA)))
    assert {event: row[1] for event, row in found.items()} == {
        1: "accepted", 2: "invalid", 3: "invalid", 4: "stale", 5: "accepted"
    }
    assert found[5][2:] == ("running", "parsing")
    assert fold_attempts(spark.createDataFrame([], SCHEMA)).count() == 0


def run_stream(spark, folder, pieces, **options):
    """The pieces as one file and one trigger each; a far event at the end moves the watermark."""
    far = [("end", datetime.datetime(2100, 1, 1), -1, "start", None)]
    for number, piece in enumerate([*pieces, far]):
        frame = spark.createDataFrame(piece, SCHEMA).coalesce(1)
        frame.write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{folder}/in")
        with lifecycle.state_store(spark):
            (
                fold_attempt_stream(stream, **options)
                .writeStream.format("parquet")
                .option("path", f"{folder}/out")
                .option("checkpointLocation", f"{folder}/cp")
                .trigger(availableNow=True)
                .start()
                .awaitTermination()
            )
    return spark.read.parquet(f"{folder}/out")


def test_stream_out_of_order_equals_batch(spark, tmp_path):
    """Events come in any order over three triggers; none is later than the delay."""
    rows = events(900, 5, hot=0.3)
    pick = random.Random(8)
    ordered = sorted(rows, key=lambda r: (r[1].timestamp() + pick.randrange(400), r[2]))
    pieces = [ordered[at : at + 300] for at in range(0, 900, 300)]
    assert max(r[1] for r in pieces[0]) > min(r[1] for r in pieces[1])
    found = run_stream(spark, tmp_path, pieces, delay="400 seconds")
    assert outcome(found) == one_by_one(rows)
    assert found.count() == len(rows)


def test_late_events_and_dropped_state(spark, tmp_path):
    """A late event is told and changes nothing; an attempt without events for ``keep`` starts as a new one."""
    day = [datetime.datetime(2026, 1, 1) + datetime.timedelta(hours=h) for h in range(100)]
    pieces = [
        [("a", day[0], 1, "start", None), ("b", day[5], 2, "start", None)],
        [("a", day[0] + datetime.timedelta(minutes=1), 3, "stop", None), ("b", day[6], 4, "phase", "parsing")],
        [("b", day[70], 5, "stop", None)],
        [("a", day[75], 6, "stop", None), ("b", day[76], 7, "stop", None)],
    ]
    found = outcome(run_stream(spark, tmp_path, pieces, delay="1 hour", keep=datetime.timedelta(days=2)))
    assert found[3] == ("a", "late_event", "running", "preflight")
    assert found[4] == ("b", "accepted", "running", "parsing")
    assert found[6] == ("a", "invalid", "idle", "not_started")
    assert set(found) == {1, 2, 3, 4, 5, 6, 7}


def test_large_ids_beside_null_ids(spark, tmp_path):
    """An event without an id leaves the ids of its attempt whole, also those that no double holds."""
    start = datetime.datetime(2026, 1, 1)
    large = (1 << 53) + 1
    rows = [("a", start, None, "start", None), ("a", start + datetime.timedelta(minutes=1), large, "phase", "parsing")]
    found = run_stream(spark, tmp_path, [rows], delay="1 hour")
    assert {(r.event_id, r.outcome) for r in found.collect()} == {(None, "accepted"), (large, "accepted")}
    folded = fold_attempts(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r.event_id, r.outcome) for r in folded} == {(None, "accepted"), (large, "accepted")}
