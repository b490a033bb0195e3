"""Broadcasts behind a check of the size of what is sent."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Rows of a narrow table (ids, hashes, short strings) that may be broadcast.
BROADCAST_ROWS = 50_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows, else as it is, for a shuffle join.

    Meant for written tables of fixed-width columns, where counting is cheap.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: Bytes that a message between two groups of a packed exchange holds on average, and least and most bytes of a group.
MESSAGE_BYTES = 64 << 10
GROUP_BYTES = (2 << 20, 64 << 20)


def group_bytes(total: int) -> int:
    """Bytes of text for each group of a packed exchange, in which every group sends to every part.

    The geometric mean of the whole and a message: groups times parts is then
    the whole by MESSAGE_BYTES, so messages grow in proportion to the input (up
    to 64 GB of text; beyond, groups stay within a worker's memory and messages
    get smaller instead, but never smaller than one n-gram).
    """
    return int(min(max((total * MESSAGE_BYTES) ** 0.5, GROUP_BYTES[0]), GROUP_BYTES[1]))
