"""Calendar helpers with the reference's semantics.

- day and minute differences count calendar *boundaries* (a 00:00:59 ->
  00:01:01 difference is one minute), so both ends are truncated first;
- weekday numbers are 0 = Sunday .. 6 = Saturday;
- export timestamps ('4 Nov 2022 10:35') parse to ``timestamp_ntz`` without
  touching the session time zone; unparseable text becomes null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from orderlens.config import RAW_TIMESTAMP_FORMAT


def parse_export_timestamp(text: Column, fmt: str = RAW_TIMESTAMP_FORMAT) -> Column:
    """'d MMM yyyy HH:mm' text -> timestamp_ntz; bad or null text -> null.

    ``try_to_timestamp`` decides whether the text parses; only then is it
    parsed again straight into ``timestamp_ntz`` (CASE evaluates the branch
    lazily), so no time-zone conversion is involved.
    """
    ok = F.try_to_timestamp(text, F.lit(fmt)).isNotNull()
    return F.when(ok, F.to_timestamp_ntz(text, F.lit(fmt)))


def day_diff(start: Column, end: Column) -> Column:
    """Number of midnights between two timestamps (DATE_DIFF('day', ...))."""
    return F.datediff(F.to_date(end), F.to_date(start))


def minute_diff(start: Column, end: Column) -> Column:
    """Number of minute boundaries between two timestamps."""
    return F.timestamp_diff("MINUTE", F.date_trunc("minute", start), F.date_trunc("minute", end))


def weekday0(d: Column) -> Column:
    """0 = Sunday .. 6 = Saturday."""
    return F.dayofweek(d) - 1


def year_month(d: Column) -> Column:
    """'yyyy-MM' label of a date or timestamp."""
    return F.date_format(d, "yyyy-MM")
