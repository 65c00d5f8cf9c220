"""The queries of `queries.py` once more, as SQL for an independent engine (DuckDB).

The SQL builds the same messages from `events`, reads them with that engine's own JSON functions and
follows the definition of each step: batch winners first, then the last batch per key.
"""

from __future__ import annotations

_FEED = """
numbered AS (
  SELECT event_id AS n, event_id % 97 AS form, user_id, event_type, props,
         epoch_us(ts) - 1704067200000000 AS since_start, ts,
         CAST(event_id % 2 + 1 AS VARCHAR) AS server
  FROM events
),
parts AS (
  SELECT *,
    'db_' || server AS db,
    CASE form WHEN 53 THEN 'Users' WHEN 59 THEN 'ClosedTickets' ELSE 'Tickets' END AS tab,
    CASE WHEN form = 5 THEN 'r' WHEN form = 61 THEN 't'
      WHEN n % 11 = 0 THEN 'd' WHEN n % 3 = 0 THEN 'c' ELSE 'u' END AS op,
    CASE form WHEN 71 THEN ',"ts_ms":"5"' WHEN 73 THEN '' WHEN 17 THEN ',"ts_ms":1.0'
      ELSE ',"ts_ms":' || CAST(n * 7919 % 100 AS VARCHAR) END AS ts_part,
    CASE form WHEN 23 THEN '{}' WHEN 67 THEN 'null' WHEN 90 THEN '{"id":"x' || user_id || '"}' ELSE CAST(to_json(struct_pack(
      id := CASE WHEN form = 89 THEN NULL ELSE user_id END,
      project_id := n % 2 + 1, reporter_id := n % 3 + 1, title := 'Task ' || n, description := props,
      status := event_type, priority := (['Low', 'Medium', 'High', 'Critical'])[n % 4 + 1])) AS VARCHAR) END AS image
  FROM numbered
),
built AS (
  SELECT n // 500 AS batch_id, n AS "offset", CAST(user_id % 4 AS INTEGER) AS "partition", ts, form,
    make_timestamp(since_start // 10000 + 1704067200000000) AS "timestamp",
    db || '.dbo.' || tab AS source_table,
    CASE WHEN form = 96 THEN 'schema-changes.tickets_server_' || server
         ELSE 'tickets_server_' || server || '.' || db || '.dbo.' || tab END AS topic,
    '{"schema":{},"payload":{"op":"' || op || '"' || ts_part || ',"source":' ||
      CASE form WHEN 47 THEN '"none"' WHEN 79 THEN '{"table":"Tickets"}' WHEN 83 THEN '{"db":null,"table":"Tickets"}'
        ELSE '{"db":"' || db || '","table":"' || tab || '"}' END ||
      ',"before":' || CASE WHEN op = 'd' THEN image ELSE 'null' END ||
      ',"after":' || CASE WHEN op = 'd' THEN 'null' ELSE image END || '}}' AS plain
  FROM parts
),
feed AS (
  SELECT batch_id, "offset", "partition", ts, "timestamp", source_table, topic,
    CASE form WHEN 13 THEN NULL WHEN 29 THEN NULL WHEN 19 THEN plain || ' x' WHEN 31 THEN '{bad' WHEN 37 THEN '[1]'
      WHEN 41 THEN '{}' WHEN 43 THEN '{"schema":{},"payload":"{}"}' ELSE plain END AS text
  FROM built
),
decoded AS (
  SELECT * FROM feed
  WHERE regexp_matches(topic, '^tickets_server_.*')
    AND CASE WHEN json_valid(text) THEN json_type(text) = 'OBJECT' ELSE FALSE END
)"""

_CHANGES = """,
bodies AS (
  SELECT *, json_extract_string(text, '$.payload.op') AS op,
    CASE WHEN json_extract_string(text, '$.payload.op') = 'd' THEN json_extract(text, '$.payload.before')
         ELSE json_extract(text, '$.payload.after') END AS image
  FROM decoded
),
classified AS (
  SELECT *,
    CASE WHEN json_type(text, '$.payload') IS DISTINCT FROM 'OBJECT' THEN 'failed'
         WHEN json_type(text, '$.payload.source') IS DISTINCT FROM 'OBJECT' THEN 'failed'
         WHEN json_extract_string(text, '$.payload.source.table') IS DISTINCT FROM 'Tickets' THEN 'ignored'
         WHEN op IS NULL OR op NOT IN ('c', 'u', 'd', 'r') THEN 'failed'
         WHEN json_type(image) IS DISTINCT FROM 'OBJECT' THEN 'failed'
         WHEN NOT regexp_full_match(json_extract_string(image, '$.id'), '-?[0-9]+') THEN 'quarantined'
         ELSE 'ok' END AS outcome
  FROM bodies
),
changes AS (
  SELECT batch_id, topic, "partition", "offset", ts,
    TRY_CAST(json_extract_string(image, '$.id') AS BIGINT) AS id,
    CAST(json_extract_string(image, '$.project_id') AS BIGINT) AS project_id,
    CAST(json_extract_string(image, '$.reporter_id') AS BIGINT) AS reporter_id,
    json_extract_string(image, '$.status') AS status,
    json_extract_string(image, '$.priority') AS priority,
    CASE WHEN json_type(text, '$.payload.source.db') IS NULL THEN 'unknown'
         ELSE json_extract_string(text, '$.payload.source.db') END AS source_db,
    op,
    CASE WHEN json_type(text, '$.payload.ts_ms') IN ('UBIGINT', 'BIGINT')
         THEN CAST(json_extract_string(text, '$.payload.ts_ms') AS BIGINT) ELSE 0 END AS ts_ms
  FROM classified WHERE outcome = 'ok'
)"""

_SILVER_COLUMNS = "id, project_id, reporter_id, status, priority, source_db, op, ts_ms"

_WINNERS = """,
winners AS (
  SELECT * FROM changes
  QUALIFY row_number() OVER (PARTITION BY batch_id, id, source_db ORDER BY ts_ms DESC, "offset" DESC) = 1
)"""


def _state(name: str, winners: str) -> str:
    return f""",
{name} AS (
  SELECT {_SILVER_COLUMNS} FROM (
    SELECT *, max(batch_id) OVER (PARTITION BY id, source_db) AS last_batch FROM {winners})
  WHERE op <> 'd' AND (batch_id = last_batch OR id IS NULL OR source_db IS NULL)
)"""


_SILVER = _WINNERS + _state("silver", "winners")

_GOLD = """,
gold AS (
  SELECT source_db, status, count(*) AS "count" FROM silver GROUP BY source_db, status
),
named AS (SELECT * FROM gold WHERE source_db IS NOT NULL AND status IS NOT NULL)"""

_MERGE = (
    """,
history_winners AS (
  SELECT * FROM changes WHERE ts < TIMESTAMP '2024-01-16 00:00:00'
  QUALIFY row_number() OVER (PARTITION BY batch_id, id, source_db ORDER BY ts_ms DESC, "offset" DESC) = 1
),
batch AS (
  SELECT * FROM changes WHERE ts >= TIMESTAMP '2024-01-16 00:00:00'
  QUALIFY row_number() OVER (PARTITION BY id, source_db ORDER BY ts_ms DESC, "offset" DESC) = 1
)"""
    + _state("target", "history_winners")
)
_MATCHES_TARGET = "EXISTS (SELECT 1 FROM target t WHERE t.id = b.id AND t.source_db = b.source_db)"

_ONE_BATCH = """,
batch AS (
  SELECT * FROM changes
  QUALIFY row_number() OVER (PARTITION BY id, source_db ORDER BY ts_ms DESC, "offset" DESC) = 1
)"""

_MERGED = f"""SELECT {_SILVER_COLUMNS} FROM target t
WHERE NOT EXISTS (SELECT 1 FROM batch b WHERE t.id = b.id AND t.source_db = b.source_db)
UNION ALL
SELECT {_SILVER_COLUMNS} FROM batch WHERE op <> 'd'"""

_OUTCOMES = """,
outcomes AS (
  SELECT c.batch_id, count(*) AS received, any_value(coalesce(w.processed, 0)) AS processed,
    count(*) FILTER (c.outcome IN ('failed', 'quarantined')) AS failed, count(*) FILTER (c.outcome = 'ignored') AS ignored
  FROM classified c LEFT JOIN (SELECT batch_id, count(*) AS processed FROM winners GROUP BY 1) w USING (batch_id)
  GROUP BY c.batch_id
)"""

_POINTS = """,
counted AS (
  SELECT date_trunc('second', "timestamp") AS s, count(*) AS c FROM decoded GROUP BY 1
),
points AS (
  SELECT l.s AS interval_start, coalesce(k.c, 0) AS events_in_interval
  FROM (SELECT unnest(generate_series(min(s), max(s), INTERVAL 1 SECOND)) AS s FROM counted) l
  LEFT JOIN counted k ON l.s = k.s
)"""
_POINTS_3S = """,
counted AS (
  SELECT epoch_us("timestamp") // 3000000 AS i, count(*) AS c FROM decoded GROUP BY 1
),
points AS (
  SELECT make_timestamp(l.i * 3000000) AS interval_start, coalesce(k.c, 0) AS events_in_interval
  FROM (SELECT unnest(generate_series(min(i), max(i))) AS i FROM counted) l LEFT JOIN counted k ON l.i = k.i
)"""
_START_TEXT = "strftime(interval_start, '%Y-%m-%dT%H:%M:%S.%f+00:00') AS interval_start"


def _query(ctes: str, select: str) -> str:
    return f"WITH {ctes.strip()}\n{select}"


def _on_changes(select: str) -> str:
    return _query(_FEED + _CHANGES, select)


def _on_silver(select: str) -> str:
    return _query(_FEED + _CHANGES + _SILVER, select)


def _on_gold(select: str) -> str:
    return _query(_FEED + _CHANGES + _SILVER + _GOLD, select)


def _on_one_batch(select: str) -> str:
    return _query(_FEED + _CHANGES + _ONE_BATCH, select)


def _on_merge(select: str) -> str:
    return _query(_FEED + _CHANGES + _MERGE, select)


def _on_log(select: str) -> str:
    return _query(_FEED + _CHANGES + _WINNERS + _OUTCOMES, select)


_STREAM_FEED = _FEED.replace("n // 500", "n // (SELECT CAST(ceil(count(*) / 24.0) AS BIGINT) FROM events)")


def _on_stream(select: str) -> str:
    return _query(_STREAM_FEED + _CHANGES + _SILVER + _GOLD + _OUTCOMES, select)


def _on_points(select: str) -> str:
    return _query(_FEED + _POINTS, select)


def _per(unit: str) -> str:
    return f"""SELECT {_START_TEXT}, events_in_interval FROM (
  SELECT date_trunc('{unit}', s) AS interval_start, CAST(sum(c) AS BIGINT) AS events_in_interval FROM counted GROUP BY 1)"""


ORACLE_SQL: dict[str, str] = {
    "topic_subscription": _query(
        _FEED,
        """SELECT topic, "partition", "offset" FROM feed WHERE regexp_matches(topic, '^tickets_server_.*')""",
    ),
    "feed_union": _query(
        _FEED,
        """SELECT topic, "partition", count(*) AS messages, min("offset") AS first_offset, max("offset") AS last_offset
FROM feed
WHERE topic LIKE 'tickets!_server!_1.%' ESCAPE '!' OR topic LIKE 'tickets!_server!_2.%' ESCAPE '!'
GROUP BY ALL""",
    ),
    "capture_table_filter": _query(
        _FEED, """SELECT "offset", source_table FROM feed WHERE regexp_full_match(source_table, '.*Tickets$')"""
    ),
    "decode_valid_messages": _query(_FEED, """SELECT topic, "partition", "offset", text FROM decoded"""),
    "bronze_rows": _query(
        _FEED,
        """SELECT batch_id, topic, "partition", "offset",
  '{"topic":"' || topic || '","partition":' || "partition" || ',"offset":' || "offset" || ',"payload":' || text || '}'
    AS raw_payload
FROM decoded""",
    ),
    "raw_feed": _query(_FEED, """SELECT topic, "partition", "offset", text AS payload FROM decoded"""),
    "envelope_classify": _on_changes("""SELECT batch_id, "offset", outcome FROM classified"""),
    "ticket_changes": _on_changes(
        f"""SELECT batch_id, topic, "partition", "offset", {_SILVER_COLUMNS} FROM changes"""
    ),
    "quarantined_changes": _on_changes(
        """SELECT batch_id, topic, "partition", "offset",
  '{"topic":"' || topic || '","partition":' || "partition" || ',"offset":' || "offset" || ',"payload":' || text || '}'
    AS raw_payload
FROM classified WHERE outcome = 'quarantined'"""
    ),
    "ts_ms_default": _on_changes("SELECT ts_ms, count(*) AS events FROM changes GROUP BY ts_ms"),
    "source_db_default": _on_changes("SELECT source_db, count(*) AS events FROM changes GROUP BY source_db"),
    "latest_per_key": _on_silver(f"""SELECT batch_id, "offset", {_SILVER_COLUMNS} FROM winners"""),
    "silver_first_batch": _on_one_batch(f"SELECT {_SILVER_COLUMNS} FROM batch WHERE op <> 'd'"),
    "silver_merge": _on_merge(_MERGED),
    "silver_added_column": _on_merge(
        f"""SELECT {_SILVER_COLUMNS.replace("priority", "NULL AS priority")} FROM target t
WHERE NOT EXISTS (SELECT 1 FROM batch b WHERE t.id = b.id AND t.source_db = b.source_db)
UNION ALL
SELECT {_SILVER_COLUMNS} FROM batch WHERE op <> 'd'"""
    ),
    "silver_merge_updates": _on_merge(
        f"SELECT {_SILVER_COLUMNS} FROM batch b WHERE op <> 'd' AND {_MATCHES_TARGET}"
    ),
    "silver_merge_deletes": _on_merge(
        f"""SELECT {_SILVER_COLUMNS} FROM target t
WHERE EXISTS (SELECT 1 FROM batch b WHERE t.id = b.id AND t.source_db = b.source_db AND b.op = 'd')"""
    ),
    "silver_merge_inserts": _on_merge(
        f"SELECT {_SILVER_COLUMNS} FROM batch b WHERE op <> 'd' AND NOT {_MATCHES_TARGET}"
    ),
    "silver_null_keys": _on_silver(f"SELECT {_SILVER_COLUMNS} FROM silver WHERE id IS NULL OR source_db IS NULL"),
    "silver_state": _on_silver(f"SELECT {_SILVER_COLUMNS} FROM silver"),
    "silver_guarded": _on_changes(
        f"""SELECT {_SILVER_COLUMNS} FROM (
  SELECT *, row_number() OVER (PARTITION BY id, source_db, CASE WHEN id IS NULL OR source_db IS NULL THEN batch_id END
    ORDER BY ts_ms DESC, batch_id DESC, "offset" DESC) AS place
  FROM changes)
WHERE place = 1 AND op <> 'd'"""
    ),
    "late_changes": _query(
        _FEED + _CHANGES + _WINNERS,
        """SELECT batch_id, id, source_db, ts_ms, mark FROM (
  SELECT *, max(ts_ms) OVER (PARTITION BY id, source_db ORDER BY batch_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    AS mark
  FROM winners WHERE id IS NOT NULL AND source_db IS NOT NULL)
WHERE ts_ms < mark""",
    ),
    "gold_counts": _on_gold("""SELECT source_db, status, "count" FROM gold"""),
    "gold_refresh": _on_merge(
        f"""SELECT source_db, status, count(*) AS "count" FROM ({_MERGED}) merged GROUP BY source_db, status"""
    ),
    "gold_summary_map": _on_gold("""SELECT source_db, status, "count" FROM named"""),
    "gold_pivot": _on_gold(
        """SELECT status,
  CAST(coalesce(sum("count") FILTER (source_db = 'db_1'), 0) AS BIGINT) AS db_1,
  CAST(coalesce(sum("count") FILTER (source_db = 'db_2'), 0) AS BIGINT) AS db_2,
  CAST(coalesce(sum("count") FILTER (source_db = 'unknown'), 0) AS BIGINT) AS "unknown"
FROM named GROUP BY status"""
    ),
    "gold_of_no_tickets": _on_gold("""SELECT source_db, status, "count" FROM gold WHERE FALSE"""),
    "gold_dimensions": _on_gold(
        """SELECT 'source_db' AS dimension, source_db AS "value" FROM named
UNION SELECT 'status', status FROM named"""
    ),
    "batch_outcomes": _on_log("SELECT batch_id, received, processed, failed, ignored FROM outcomes"),
    "throughput_windows": _on_points(
        f"""SELECT {_START_TEXT}, events_in_interval, CAST(1.0 AS DOUBLE) AS interval_sec,
  CAST(floor(events_in_interval / 1.0) AS BIGINT) AS events_per_sec
FROM points"""
    ),
    "throughput_3s": _query(
        _FEED + _POINTS_3S,
        f"""SELECT {_START_TEXT}, events_in_interval, CAST(3.0 AS DOUBLE) AS interval_sec,
  CAST(floor(events_in_interval / 3.0) AS BIGINT) AS events_per_sec
FROM points""",
    ),
    "throughput_running_total": _on_points(
        f"""SELECT {_START_TEXT}, events_in_interval,
  CAST(sum(events_in_interval) OVER (ORDER BY points.interval_start) AS BIGINT) AS total_received
FROM points"""
    ),
    "throughput_last60": _on_points(
        f"""SELECT {_START_TEXT}, strftime(points.interval_start, '%H:%M:%S') AS "time",
  events_in_interval AS events_per_sec
FROM points ORDER BY points.interval_start DESC LIMIT 60"""
    ),
    "throughput_minutes": _on_points(_per("minute")),
    "throughput_hours": _on_points(_per("hour")),
    "stream_minutes": _on_points(_per("minute")),
    "stream_last60": _on_points(
        f"""SELECT {_START_TEXT}, strftime(points.interval_start, '%H:%M:%S') AS "time",
  events_in_interval AS events_per_sec
FROM points ORDER BY points.interval_start DESC LIMIT 60"""
    ),
    "stream_bronze": _on_stream(
        """SELECT batch_id, topic, "partition", "offset",
  '{"topic":"' || topic || '","partition":' || "partition" || ',"offset":' || "offset" || ',"payload":' || text || '}'
    AS raw_payload, outcome
FROM classified"""
    ),
    "stream_gold_report": _on_stream("""SELECT source_db, status, "count" FROM named"""),
    "stream_silver": _on_stream(f"SELECT {_SILVER_COLUMNS} FROM silver"),
    "stream_gold": _on_stream("""SELECT source_db, status, "count" FROM gold"""),
    "rebuild_gold": _on_stream("""SELECT source_db, status, "count" FROM gold"""),
    "stream_batch_log": _on_stream("SELECT batch_id, TRUE AS success, received, processed, failed, ignored FROM outcomes"),
    "stream_throughput": _on_points(
        f"""SELECT {_START_TEXT}, events_in_interval, CAST(1.0 AS DOUBLE) AS interval_sec,
  CAST(floor(events_in_interval / 1.0) AS BIGINT) AS events_per_sec,
  CAST(sum(events_in_interval) OVER (ORDER BY points.interval_start) AS BIGINT) AS total_received
FROM points"""
    ),
    "worker_metrics": _on_stream(
        """SELECT CAST(sum(received) AS BIGINT) AS events_received, count(*) AS batches_ok,
  CAST(1 AS BIGINT) AS batches_failed, 'Bronze write failed' AS last_error
FROM outcomes"""
    ),
    "worker_status": _on_stream("SELECT 'degraded' AS status, 'Bronze write failed' AS last_error"),
}
