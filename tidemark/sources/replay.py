"""The `events` table replayed as change messages of two ticket databases.

Event n is message n. Most are plain inserts, updates and deletes; by the remainder of n a few take
every irregular form a consumer has to cope with (IRREGULAR). The text is built from columns only, so
the same messages can be built by another SQL engine for comparison.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.once import with_computed_once

# Event numbers with this remainder of PERIOD take the named form.
IRREGULAR = {
    "snapshot_op": 5,
    "null_value": 13,
    "fraction_ts": 17,
    "trailing_text": 19,
    "empty_image": 23,
    "bad_utf8": 29,
    "bad_json": 31,
    "not_object": 37,
    "no_payload": 41,
    "text_payload": 43,
    "bad_source": 47,
    "foreign_table": 53,
    "similar_table": 59,
    "truncate_op": 61,
    "no_image": 67,
    "text_ts": 71,
    "no_ts": 73,
    "no_db": 79,
    "null_db": 83,
    "null_id": 89,
    "text_id": 90,
    "other_topic": 96,
}
PERIOD = 97

# The month of events is replayed in about four minutes.
REPLAY_START_MICROS = 1_704_067_200_000_000
REPLAY_SPEEDUP = 10_000


def _choose(default: str, **forms: str) -> str:
    """SQL text: `default`, or the value given for the irregular form the event takes."""
    cases = " ".join(f"WHEN {IRREGULAR[name]} THEN {value}" for name, value in forms.items())
    return f"CASE form {cases} ELSE {default} END"


def _with_parts(events: DataFrame, irregular: bool) -> DataFrame:
    """Database, table, operation and row image of each event."""
    user_id = _choose("user_id", null_id="NULL")
    image = f"""to_json(
        named_struct('id', {user_id}, 'project_id', event_id % 2 + 1, 'reporter_id', event_id % 3 + 1,
                     'title', 'Task ' || event_id, 'description', props, 'status', event_type,
                     'priority', element_at(array('Low', 'Medium', 'High', 'Critical'), int(event_id % 4 + 1))),
        map('ignoreNullFields', 'false'))"""
    form = f"event_id % {PERIOD}" if irregular else "-1"
    numbered = events.selectExpr(
        "event_id", "ts", "user_id", "event_type", "props", f"{form} AS form", "string(event_id % 2 + 1) AS server"
    )
    plain_op = "CASE WHEN event_id % 11 = 0 THEN 'd' WHEN event_id % 3 = 0 THEN 'c' ELSE 'u' END"
    return numbered.selectExpr(
        "*",
        "'db_' || server AS db",
        _choose("'Tickets'", foreign_table="'Users'", similar_table="'ClosedTickets'") + " AS table",
        _choose(plain_op, snapshot_op="'r'", truncate_op="'t'") + " AS op",
        _choose(image, empty_image="'{}'", no_image="'null'", text_id="""'{"id":"x' || user_id || '"}'""") + " AS image",
    )


def _envelope_text() -> str:
    ts_ms = _choose(
        """',"ts_ms":' || event_id * 7919 % 100""",
        text_ts="""',"ts_ms":"5"'""",
        no_ts="''",
        fraction_ts="""',"ts_ms":1.0'""",
    )
    source = _choose(
        """'{"db":"' || db || '","table":"' || table || '"}'""",
        bad_source="""'"none"'""",
        no_db="""'{"table":"Tickets"}'""",
        null_db="""'{"db":null,"table":"Tickets"}'""",
    )
    return f"""concat('{{"schema":{{}},"payload":{{"op":"', op, '"', {ts_ms}, ',"source":', {source},
        ',"before":', if(op = 'd', image, 'null'), ',"after":', if(op = 'd', 'null', image), '}}}}')"""


def change_messages(
    events: DataFrame, batch_rows: int = 500, irregular: bool = True, with_value: bool = True
) -> DataFrame:
    """Messages with `batch_id` and `source_table` beside the message columns.

    `irregular=False` gives the plain inserts, updates and deletes only, as many as there are events.
    `with_value=False` leaves the text out and so reads no `props`.
    """
    value = _choose(
        "binary(plain)",
        null_value="NULL",
        bad_utf8="X'FF7B'",
        trailing_text="binary(plain || ' x')",
        bad_json="binary('{bad')",
        not_object="binary('[1]')",
        no_payload="binary('{}')",
        text_payload="""binary('{"schema":{},"payload":"{}"}')""",
    )
    topic = _choose(
        "'tickets_server_' || server || '.' || db || '.dbo.' || table",
        other_topic="'schema-changes.tickets_server_' || server",
    )
    since_start = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', cast(ts AS TIMESTAMP_NTZ))"
    parts = _with_parts(events, irregular)
    if with_value:
        parts = with_computed_once(parts.selectExpr("*", f"{_envelope_text()} AS plain"), value=F.expr(value))
    return parts.selectExpr(
        f"event_id div {batch_rows} AS batch_id",
        f"{topic} AS topic",
        "int(user_id % 4) AS partition",
        "event_id AS offset",
        f"timestamp_micros({since_start} div {REPLAY_SPEEDUP} + {REPLAY_START_MICROS}) AS timestamp",
        "db || '.dbo.' || table AS source_table",
        *(["value"] if with_value else []),
    )
