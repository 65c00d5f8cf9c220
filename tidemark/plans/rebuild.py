"""Silver and Gold anew from the whole of Bronze, in one batch job."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidemark.operators import silver, tickets
from tidemark.session import session_for
from tidemark.streaming.tables import TicketTables


def deciding_changes(bronze: DataFrame, parse_again: bool = False, guard_ts: bool = False) -> DataFrame:
    """Every ticket's deciding change, deletes included; one shuffle, of winners only.

    Reads the stored ticket fields, a few columns beside the raw text. `parse_again` reads the text
    instead, for rows stored before a change to the parsing.
    """
    if parse_again:
        bronze = tickets.classify_events(bronze.select(*tickets.POSITION, "raw_payload"))
    changes = tickets.ticket_changes(bronze)
    # With a guard the highest time of all batches decides, not that of the batches' winners; it is one of them.
    return silver.last_change(changes, guard_ts)


def state_from_bronze(bronze: DataFrame, parse_again: bool = False) -> DataFrame:
    """Every ticket as its deciding change leaves it."""
    return deciding_changes(bronze, parse_again).where(silver.IS_UPSERT)


def rebuild(tables: TicketTables, parse_again: bool = False) -> int:
    """Writes Silver and Gold after the last committed batch and returns that batch, -1 if there is none.

    For a stopped worker: the pending changes up to that batch are part of the new state. Gold of that
    batch goes before the new state comes, so that after a crash in between it is missing, not stale.
    """
    through = tables.committed_through()
    if through >= 0:
        sized = tables.within(session_for(tables.spark, tables.packs("bronze").size()))
        # The last full state and what came after it bound the size of the new one.
        state_bytes = sum(tables.state_sizes(tables.full_state_through(through), through))
        tables.remove("gold", f"through={through}")
        winners = deciding_changes(sized.bronze(), parse_again, tables.guard_ts)
        keyed, unkeyed = sized.next_state(-1, winners)
        sized.write_full_state(keyed, unkeyed, through, sized.buckets_for(state_bytes))
        tables.write_gold(through)
    return through
