"""Hand-made messages: one per way a message can be read, with the outcome it must have."""

import json

IMAGE = {"id": 1, "project_id": 1, "reporter_id": 2, "status": "Open", "priority": "Low"}
SOURCE = {"db": "db_1", "table": "Tickets"}


def envelope(**changed) -> str:
    """A good update event with some fields replaced; a field given as `...` is left out."""
    body = {"op": "u", "ts_ms": 1_700_000_000_000, "source": SOURCE, "before": None, "after": IMAGE, **changed}
    return json.dumps({"schema": {}, "payload": {k: v for k, v in body.items() if v is not ...}})


# Messages that never reach Bronze.
SKIPPED = {
    "null value": None,
    "bad utf-8": b"\xff{",
    "lone surrogate": b'{"a":"\xed\xa0\x80"}',
    "broken": b"{bad",
    "empty": b"",
    "white space": b"  ",
    "list": b"[1]",
    "number": b"5",
    "null": b"null",
    "text": b'"{}"',
    "cut off": b'{"a":{"b":1}',
    "two values": b'{"a":1}{"b":2}',
    "two elements": b'{"a":1},{"b":2}',
    "trailing text": b'{"a":1} x',
    "trailing brace": b'{"a":1}}',
    "closed array": b'{"a":1}] junk }',
    "closed array of two": b'{"a":1},0] junk }',
    "closed array of three": b'{"a":1},0,0] junk }',
    "trailing bracket": b'{"a":1}]',
    "byte order mark": b'\xef\xbb\xbf{"a":1}',
    "single quotes": b"{'a':1}",
    "leading zero": b'{"a":01}',
    "no number": b'{"a":NaN}',
    "end mark of its own": b'{"a":1},{"~":"1"}] junk }',
    "end mark and more": b'{"a":1},{"~":"1"}]',
    "null and more": b'null,{"a":1}',
}

# text -> (outcome, ticket fields that must hold if the outcome is ok)
READ = {
    "plain update": (envelope(), "ok", {"id": 1, "source_db": "db_1", "op": "u", "ts_ms": 1_700_000_000_000}),
    "space around": (f" \n{envelope()}\r\n\t", "ok", {"id": 1}),
    "unicode": (envelope(after={**IMAGE, "status": "Öffnen ✓"}), "ok", {"status": "Öffnen ✓"}),
    "empty object": ("{}", "failed", {}),
    "payload missing": (json.dumps({"schema": {}}), "failed", {}),
    "payload null": (json.dumps({"payload": None}), "failed", {}),
    "payload list": (json.dumps({"payload": [1]}), "failed", {}),
    "payload text": (json.dumps({"payload": "{}"}), "failed", {}),
    "payload text of an object": (json.dumps({"payload": envelope()}), "failed", {}),
    "source missing": (envelope(source=...), "failed", {}),
    "source text": (envelope(source="db_1"), "failed", {}),
    "source list": (envelope(source=[SOURCE]), "failed", {}),
    "source broken before table": (envelope(source=None, op="t"), "failed", {}),
    "foreign table": (envelope(source={"db": "db_1", "table": "Users"}), "ignored", {}),
    "foreign table, bad op": (envelope(source={"db": "db_1", "table": "Users"}, op="x"), "ignored", {}),
    "similar table": (envelope(source={"db": "db_1", "table": "ClosedTickets"}), "ignored", {}),
    "table missing": (envelope(source={"db": "db_1"}), "ignored", {}),
    "op missing": (envelope(op=...), "failed", {}),
    "op null": (envelope(op=None), "failed", {}),
    "truncate": (envelope(op="t"), "failed", {}),
    "logical message": (envelope(op="m"), "failed", {}),
    "op list": (envelope(op=["u"]), "failed", {}),
    "update without after": (envelope(after=None), "failed", {}),
    "delete without before": (envelope(op="d"), "failed", {}),
    "after list": (envelope(after=[IMAGE]), "failed", {}),
    "delete": (envelope(op="d", before=IMAGE, after=None), "ok", {"id": 1, "op": "d", "status": "Open"}),
    "create": (envelope(op="c"), "ok", {"op": "c"}),
    "snapshot": (envelope(op="r"), "ok", {"op": "r"}),
    "id null": (envelope(after={**IMAGE, "id": None}), "ok", {"id": None, "status": "Open"}),
    "id text": (envelope(after={**IMAGE, "id": "one"}), "quarantined", {"id": None}),
    "id text of a number": (envelope(after={**IMAGE, "id": "-5"}), "ok", {"id": -5}),
    "id fraction": (envelope(after={**IMAGE, "id": 1.5}), "quarantined", {}),
    "id boolean": (envelope(after={**IMAGE, "id": True}), "quarantined", {}),
    "id object": (envelope(after={**IMAGE, "id": {"id": 1}}), "quarantined", {}),
    "id too large": (envelope(after={**IMAGE, "id": 10**20}), "quarantined", {}),
    "empty image": (envelope(after={}), "ok", {"id": None, "status": None, "source_db": "db_1"}),
    "extra fields": (envelope(after={**IMAGE, "title": "T", "assignee_id": 3}), "ok", {"id": 1}),
    "ts missing": (envelope(ts_ms=...), "ok", {"ts_ms": 0}),
    "ts null": (envelope(ts_ms=None), "ok", {"ts_ms": 0}),
    "ts fraction": (envelope(ts_ms=1.0), "ok", {"ts_ms": 0}),
    "ts text": (envelope(ts_ms="5"), "ok", {"ts_ms": 0, "id": 1, "status": "Open"}),
    "ts negative": (envelope(ts_ms=-7), "ok", {"ts_ms": -7}),
    "db missing": (envelope(source={"table": "Tickets"}), "ok", {"source_db": "unknown"}),
    "db null": (envelope(source={"db": None, "table": "Tickets"}), "ok", {"source_db": None}),
    "db empty": (envelope(source={"db": "", "table": "Tickets"}), "ok", {"source_db": ""}),
}
