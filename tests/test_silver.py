"""Silver against a plain loop over batches, and the clauses of the merge one by one."""

import random
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from tidemark.operators import gold, silver
from tidemark.schemas import SILVER, SILVER_STORE

CHANGES = T.StructType(
    [
        T.StructField("batch_id", T.LongType()),
        T.StructField("topic", T.StringType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("offset", T.LongType()),
        *SILVER.fields,
    ]
)


def change(batch_id, offset, id, db, op, ts_ms, status="Open"):
    return (batch_id, "t", 0, offset, id, 1, 2, status, "Low", db, op, ts_ms)


def logical(row):
    return tuple(row[4:])


def winners(batch):
    """Latest change per key; a missing key part groups like any other value."""
    best = {}
    for row in sorted(batch, key=lambda r: (r[11], r[3]), reverse=True):
        best.setdefault((row[4], row[9]), row)
    return list(best.values())


def fold(changes):
    state = []
    for batch_id in sorted({row[0] for row in changes}):
        for row in winners([r for r in changes if r[0] == batch_id]):
            key = (row[4], row[9])
            if None not in key:
                state = [old for old in state if (old[4], old[9]) != key]
            if row[10] != "d":
                state.append(row)
    return Counter(map(logical, state))


def rows_of(frame):
    return Counter(tuple(row) for row in frame.select(*SILVER.fieldNames()).collect())


events = st.tuples(
    st.integers(0, 4),
    st.sampled_from([1, 2, 3, None]),
    st.sampled_from(["a", "b", None]),
    st.sampled_from("cudr"),
    st.integers(0, 3),
    st.sampled_from(["Open", "Closed", None]),
)


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck), derandomize=True)
@given(st.lists(events, min_size=1, max_size=60))
def test_state_equals_fold(spark, drawn):
    changes = [change(b, n, i, db, op, ts, status) for n, (b, i, db, op, ts, status) in enumerate(drawn)]
    frame = spark.createDataFrame(changes, CHANGES)
    expected = fold(changes)
    assert rows_of(silver.silver_state(frame)) == expected
    # The winners of the batches alone lead to the same state.
    stored = silver.latest_per_key(frame).select(*SILVER_STORE.fieldNames())
    assert rows_of(silver.silver_state(stored)) == expected


@pytest.mark.parametrize("seed", [1, 2])
def test_merging_batch_by_batch_equals_fold(spark, seed):
    draw = random.Random(seed)
    changes = [
        change(
            n // 60,
            n,
            draw.choice([None, *range(12)]),
            draw.choice(["a", "b", "b", None]),
            draw.choice("ccuudr"),
            draw.randrange(20),
            draw.choice(["Open", "Closed"]),
        )
        for n in range(300)
    ]
    state = spark.createDataFrame([], SILVER_STORE)
    for batch_id in range(5):
        batch = spark.createDataFrame([row for row in changes if row[0] == batch_id], CHANGES)
        deciding = silver.latest_per_key(batch).select(*SILVER_STORE.fieldNames())
        merged = silver.merge_changes(state, deciding)
        added = deciding.where(silver.IS_UPSERT)
        counts = gold.gold_after_changes(gold.gold_counts(state), silver.replaced_rows(state, deciding), added)
        assert Counter(map(tuple, counts.collect())) == Counter(map(tuple, gold.gold_counts(merged).collect()))
        state = spark.createDataFrame(merged.select(*SILVER_STORE.fieldNames()).collect(), SILVER_STORE)
    assert rows_of(state) == fold(changes)


def test_one_hot_ticket_and_no_other(spark):
    changes = [change(n // 500, n, 7, "a", "u", n * 31 % 97, str(n)) for n in range(3000)]
    frame = spark.createDataFrame(changes, CHANGES).repartition(8, "offset")
    assert rows_of(silver.silver_state(frame)) == fold(changes)


def stored(spark, *rows):
    return spark.createDataFrame([row[4:] for row in rows], SILVER)


def test_merge_clauses(spark):
    target = stored(
        spark,
        change(0, 0, 1, "a", "c", 9),
        change(0, 1, 2, "a", "c", 9),
        change(0, 2, 3, "a", "c", 9),
        change(0, 3, None, "a", "c", 9),
        change(0, 4, 1, "b", "c", 9),
    )
    batch = stored(
        spark,
        change(1, 5, 1, "a", "u", 1, "Closed"),  # older ts_ms than the stored row, still an update
        change(1, 6, 2, "a", "d", 1),
        change(1, 7, 4, "a", "d", 1),
        change(1, 8, 5, "a", "r", 1),
        change(1, 9, None, "a", "u", 1),
    )
    keys = lambda frame: sorted(((r.id or 0, r.source_db, r.op, r.ts_ms) for r in frame.collect()))
    assert keys(silver.merge_updates(target, batch)) == [(1, "a", "u", 1)]
    assert keys(silver.merge_deletes(target, batch)) == [(2, "a", "c", 9)]
    assert keys(silver.merge_inserts(target, batch)) == [(0, "a", "u", 1), (5, "a", "r", 1)]
    assert keys(silver.merge_changes(target, batch)) == [
        (0, "a", "c", 9),
        (0, "a", "u", 1),
        (1, "a", "u", 1),
        (1, "b", "c", 9),
        (3, "a", "c", 9),
        (5, "a", "r", 1),
    ]


def test_merge_with_an_added_column(spark):
    target = stored(spark, change(0, 0, 1, "a", "c", 9))
    wider = T.StructType([*SILVER.fields, T.StructField("title", T.StringType())])
    batch = spark.createDataFrame([(*change(1, 1, 2, "a", "c", 1)[4:], "new")], wider)
    merged = {row.id: row.title for row in silver.merge_changes(target, batch).collect()}
    assert merged == {1: None, 2: "new"}


def test_first_batch_of_deletes_is_empty(spark):
    assert silver.first_batch(stored(spark, change(0, 0, 1, "a", "d", 1))).isEmpty()


def test_gold_of_empty_silver(spark):
    table = gold.gold_counts(spark.createDataFrame([], SILVER))
    assert table.collect() == []
    assert table.dtypes == [("source_db", "string"), ("status", "string"), ("count", "bigint")]
    assert gold.gold_summary(table).collect() == []


def test_gold_views_leave_out_unnamed_groups(spark):
    rows = [
        change(0, 0, 1, "a", "c", 1, "Open"),
        change(0, 1, 2, "a", "c", 1, "Open"),
        change(0, 2, 3, "b", "c", 1, "Closed"),
        change(0, 3, 4, None, "c", 1, "Open"),
        change(0, 4, 5, "b", "c", 1, None),
    ]
    table = gold.gold_counts(stored(spark, *rows))
    assert {(r.source_db, r.status, r["count"]) for r in table.collect()} == {
        ("a", "Open", 2),
        ("b", "Closed", 1),
        (None, "Open", 1),
        ("b", None, 1),
    }
    summary = {r.source_db: r.summary for r in gold.gold_summary(table).collect()}
    assert summary == {"a": {"Open": 2}, "b": {"Closed": 1}}
    for databases in (None, ["a", "b"]):
        pivoted = gold.gold_pivot(table, databases)
        assert sorted(map(tuple, pivoted.select("status", "a", "b").collect())) == [("Closed", 0, 1), ("Open", 2, 0)]


def test_pivot_has_every_database(spark):
    rows = [("db_1", "Open", 2), ("elsewhere", "Open", 3), ("elsewhere", "Done", 1), (None, "Open", 9)]
    table = spark.createDataFrame(rows, "source_db string, status string, count bigint")
    found = {tuple(sorted(row.asDict().items())) for row in gold.gold_pivot(table).collect()}
    assert found == {
        (("db_1", 2), ("elsewhere", 3), ("status", "Open")), (("db_1", 0), ("elsewhere", 1), ("status", "Done"))
    }
