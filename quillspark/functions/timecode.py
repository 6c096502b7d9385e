"""Times of a meeting as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def timestamp_of_ms(ms: Column) -> Column:
    """``HH:MM:SS``; hours go on past 99, negative times are zero."""
    return timestamp_of_seconds(F.greatest(ms, F.lit(0)) / 1000)


def timestamp_of_seconds(seconds: Column) -> Column:
    whole = F.floor(F.greatest(seconds, F.lit(0))).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(whole / 3600).cast("long"), F.floor(whole / 60).cast("long") % 60, whole % 60)


def clock_of_ms(ms: Column, seconds: bool = False) -> Column:
    """``HH:MM`` or ``HH:MM:SS`` as a clock shows it: hours begin again after a day."""
    whole = F.floor(ms / 1000).cast("long")
    parts = [F.floor(whole / 3600).cast("long") % 24, F.floor(whole / 60).cast("long") % 60]
    return F.format_string("%02d:%02d:%02d", *parts, whole % 60) if seconds else F.format_string("%02d:%02d", *parts)
