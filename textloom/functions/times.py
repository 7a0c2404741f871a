"""Time scalars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch(column: str | Column) -> Column:
    """Seconds since 1970, with their fraction."""
    c = F.col(column) if isinstance(column, str) else column
    return c.cast("timestamp").cast("double")


def epoch_millis(column: str | Column) -> Column:
    """Milliseconds since 1970, the nearest; a half goes away from 0."""
    c = F.col(column) if isinstance(column, str) else column
    micros = F.unix_micros(c.cast("timestamp"))
    return F.call_function("div", micros + F.when(micros < 0, -500).otherwise(500), F.lit(1000))
