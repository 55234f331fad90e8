"""Time expressions. The session's zone must be UTC (see ``session.pin_utc``)."""

from __future__ import annotations

from datetime import date, datetime, timezone
from zoneinfo import ZoneInfo, ZoneInfoNotFoundError

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_format(text: Column, *formats: str) -> Column:
    """The text as a wall-clock timestamp by the first format that fits, else null."""
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in formats)).cast("timestamp_ntz")


def local_to_utc(local: Column, zone: str) -> Column:
    return F.to_utc_timestamp(local.cast("timestamp"), zone)


def check_zone(zone: str) -> str:
    try:
        ZoneInfo(zone)
    except (ZoneInfoNotFoundError, ValueError) as e:
        raise ValueError(f"unknown time zone: {zone!r}") from e
    return zone


def parse_bound(text: str | datetime | None) -> datetime | None:
    """An ISO-8601 bound; without an offset it is UTC."""
    if text is None:
        return None
    at = datetime.fromisoformat(text) if isinstance(text, str) else text
    return at if at.tzinfo else at.replace(tzinfo=timezone.utc)


def parse_date(value: str | date | None) -> date | None:
    if value is None or isinstance(value, date) and not isinstance(value, datetime):
        return value
    return value.date() if isinstance(value, datetime) else date.fromisoformat(str(value))
