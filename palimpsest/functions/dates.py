"""Dates as the model stores them: whole milliseconds since the epoch, halves to even."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def millis(name: str) -> Column:
    """Milliseconds of a timestamp without zone."""
    return F.expr(f"cast(rint(timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {name}) / 1000.0D) as bigint)")


def from_millis(name: str) -> Column:
    """The timestamp without zone of a number of milliseconds."""
    return F.expr(f"timestampadd(MILLISECOND, {name}, timestamp_ntz'1970-01-01 00:00:00')")
