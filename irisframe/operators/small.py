"""Side tables that are expected to be small, checked before they are broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_BROADCAST_ROWS = 50_000


def evaluated_if_small(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame | None:
    """``df`` evaluated once into a local table, or None when it has more than
    ``max_rows`` rows. At most ``max_rows + 1`` rows ever reach the driver."""
    table = df.limit(max_rows + 1).toArrow()
    if table.num_rows > max_rows:
        return None
    rows = table if table.num_rows else []
    return df.sparkSession.createDataFrame(rows, df.schema)


def checked_broadcast(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``df`` only when it has at most ``max_rows`` rows.

    A larger table comes back unchanged, so the join that uses it becomes a
    shuffle join, where adaptive execution splits skewed keys.
    """
    local = evaluated_if_small(df, max_rows)
    return df if local is None else F.broadcast(local)
