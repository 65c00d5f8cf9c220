"""The guard by time stamp: older changes lose, whatever their batch, and deletes stay as marks."""

import random
from collections import Counter

import pytest
from test_silver import CHANGES, change, rows_of, winners

from tidemark.operators import silver
from tidemark.plans.rebuild import rebuild
from tidemark.schemas import MESSAGE, SILVER_STORE
from tidemark.streaming.worker import TicketWorker, WorkerOptions
from cases import envelope


def guarded_fold(changes):
    """Batch by batch: a winner older than what its ticket has seen is passed over."""
    state, seen, late = [], {}, []
    for batch_id in sorted({row[0] for row in changes}):
        for row in winners([r for r in changes if r[0] == batch_id]):
            key = (row[4], row[9])
            if None not in key:
                if row[11] < seen.get(key, row[11]):
                    late.append(row)
                    continue
                seen[key] = row[11]
                state = [old for old in state if (old[4], old[9]) != key]
            if row[10] != "d":
                state.append(row)
    return Counter(tuple(row[4:]) for row in state), late


def drawn(seed, batches=6, size=50):
    draw = random.Random(seed)
    return [
        change(
            n // size, n, draw.choice([None, *range(10)]), draw.choice(["a", "b", "b", None]), draw.choice("ccuuddr"),
            draw.randrange(25), draw.choice(["Open", "Closed"]),
        )
        for n in range(batches * size)
    ]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_guarded_state_equals_fold(spark, seed):
    changes = drawn(seed)
    frame = spark.createDataFrame(changes, CHANGES)
    expected, late = guarded_fold(changes)
    assert rows_of(silver.silver_state(frame, guard_ts=True)) == expected
    found = silver.late_changes(silver.latest_per_key(frame)).collect()
    assert Counter((r.batch_id, r.offset) for r in found) == Counter((r[0], r[3]) for r in late)
    assert late and expected != rows_of(silver.silver_state(frame))


@pytest.mark.parametrize("seed", [1, 2])
def test_merging_with_marks_equals_fold(spark, seed):
    """The state keeps deletes, so what is older stays out in later batches too."""
    changes = drawn(seed)
    state = spark.createDataFrame([], SILVER_STORE)
    loose = []
    for batch_id in range(6):
        batch = spark.createDataFrame([row for row in changes if row[0] == batch_id], CHANGES)
        deciding = silver.latest_per_key(batch).select(*SILVER_STORE.fieldNames())
        merged = silver.merge_dealt(state, deciding, guard_ts=True)
        newer = silver.newer_changes(state, deciding)
        assert rows_of(silver.merge_keyed(state, newer).where(silver.IS_UPSERT)) - rows_of(
            newer.where(silver.key_incomplete())
        ) == rows_of(merged.where(silver.IS_UPSERT))
        loose += deciding.where(silver.key_incomplete()).where(silver.IS_UPSERT).collect()
        state = spark.createDataFrame(merged.collect(), SILVER_STORE)
    kept = rows_of(state.where(silver.IS_UPSERT)) + rows_of(spark.createDataFrame(loose, SILVER_STORE))
    assert kept == guarded_fold(changes)[0]


def messages(spark, *bodies, start=0):
    rows = [("t", 0, start + n, None, bytearray(envelope(**body).encode())) for n, body in enumerate(bodies)]
    return spark.createDataFrame(rows, MESSAGE)


def image(id, status="Open"):
    return {"id": id, "project_id": 1, "reporter_id": 1, "status": status, "priority": "Low"}


BATCHES = [
    [dict(op="c", ts_ms=10, after=image(1)), dict(op="c", ts_ms=10, after=image(2)), dict(op="c", ts_ms=5, after=image(None))],
    [dict(op="d", ts_ms=20, before=image(1), after=None), dict(op="u", ts_ms=9, after=image(2, "Late"))],
    [dict(op="u", ts_ms=15, after=image(1, "Late")), dict(op="u", ts_ms=10, after=image(2, "Tie"))],
    [dict(op="u", ts_ms=20, after=image(1, "Back")), dict(op="d", ts_ms=1, before=image(2), after=None)],
]
AFTER = [{("1", "Open"), ("2", "Open")}, {("2", "Open")}, {("2", "Tie")}, {("1", "Back"), ("2", "Tie")}]


@pytest.mark.parametrize("rewritten", [(), (1,), (0, 1, 2)])
def test_guarded_job(spark, tmp_path, rewritten):
    """Silver and Gold after each batch, with and without full states in between, and after a rebuild."""
    worker = TicketWorker(spark, str(tmp_path / "lake"), WorkerOptions(guard_ts=True))
    for batch_id, bodies in enumerate(BATCHES):
        worker.apply_batch(messages(spark, *bodies, start=10 * batch_id), batch_id)
        worker.apply_batch(messages(spark, *bodies, start=10 * batch_id), batch_id)
        expected = AFTER[batch_id] | {("None", "Open")}
        assert {(str(r.id), r.status) for r in worker.tables.silver().collect()} == expected
        counts = Counter(status for _, status in expected)
        assert {(r.status, r["count"]) for r in worker.refresh_gold().collect()} == set(counts.items())
        if batch_id in rewritten:
            assert worker.rewrite_silver()
            assert {(str(r.id), r.status) for r in worker.tables.silver().collect()} == expected
            if batch_id == 1:  # the delete of ticket 1 is kept as a mark
                assert worker.tables.state(1).where("op = 'd'").count() == 1
    rebuild(worker.tables)
    assert {(str(r.id), r.status) for r in worker.tables.silver().collect()} == AFTER[-1] | {("None", "Open")}


def test_no_guard_unless_asked(spark, tmp_path):
    worker = TicketWorker(spark, str(tmp_path / "lake"))
    for batch_id, bodies in enumerate(BATCHES[:3]):
        worker.apply_batch(messages(spark, *bodies, start=10 * batch_id), batch_id)
    assert {(str(r.id), r.status) for r in worker.tables.silver().collect()} == {
        ("1", "Late"), ("2", "Tie"), ("None", "Open")
    }
