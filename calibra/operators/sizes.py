"""Sizes that are checked before a table is broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def small(table: DataFrame, most: int = 100_000) -> DataFrame:
    """A configured table, marked for broadcasting; one of more rows is an error.

    For joins that have no other way than a nested loop over the small side."""
    if table.limit(most + 1).count() > most:
        raise ValueError(f"a configured table has more than {most} rows")
    return F.broadcast(table)
