"""Reading a change event: outcome, row image and its fields.

Differences from a dynamically typed reader, all of them on malformed input: a number in a text field
becomes its text, an `id` that is no whole number sets the change aside, and a boolean `ts_ms` counts as
absent.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

# The captured table, the accepted operations, and the stand-in for an absent database.
TICKET_TABLE = "Tickets"
OPERATIONS = ("c", "u", "d", "r")
DELETE = "d"
UNKNOWN_DB = "unknown"

OK, IGNORED, FAILED, QUARANTINED = "ok", "ignored", "failed", "quarantined"


def row_image(body: Column) -> Column:
    """The row after the change, or before it for a delete; NULL unless it is a JSON object."""
    return F.when(body["op"] == DELETE, body["before"]).otherwise(body["after"])


def ticket_id(image: Column) -> Column:
    """The id as a number; NULL if there is none, or it is no whole number."""
    return F.when(image["id"].rlike(r"^-?\d+$"), image["id"].try_cast("bigint"))


def event_outcome(body: Column) -> Column:
    """`failed`, `ignored`, `quarantined` or `ok`; the order of the tests decides which one wins.

    A NULL `source` also covers an envelope or payload that is not an object. Changes with an id that is
    no whole number would all become one ticket without id; they are kept in Bronze and go no further.
    """
    source, image = body["source"], row_image(body)
    return (
        F.when(source.isNull(), FAILED)
        .when(~F.try_element_at(source, F.lit("table")).eqNullSafe(TICKET_TABLE), IGNORED)
        .when(~F.coalesce(body["op"].isin(*OPERATIONS), F.lit(False)), FAILED)
        .when(image.isNull(), FAILED)
        .when(image["id"].isNotNull() & ticket_id(image).isNull(), QUARANTINED)
        .otherwise(OK)
    )


def source_database(body: Column) -> Column:
    """Database name; `unknown` if the key is missing, NULL if it is there and null.

    The source is read as a map, which tells these two apart; of a repeated key the first counts.
    """
    named = F.map_contains_key(body["source"], F.lit("db"))
    return F.when(named, F.try_element_at(body["source"], F.lit("db"))).otherwise(UNKNOWN_DB)


def change_time(body: Column) -> Column:
    """`ts_ms` of the connector, 0 when it is absent or not an integer."""
    return F.coalesce(body["ts_ms"], F.lit(0).cast("bigint"))
