"""Date predicates: validity windows, seasons and effective dates."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO_DATE = r"^\d{4}-\d{2}-\d{2}$"


def as_date(value: str | date | Column) -> Column:
    """A date column from a literal or a column; a malformed literal is refused."""
    if isinstance(value, Column):
        return value
    return F.lit(value if isinstance(value, date) else date.fromisoformat(value))


def covers(at: str | date | Column, start: str = "valid_from", end: str = "valid_to") -> Column:
    """True when ``at`` lies in the window; both bounds are inclusive, null is open."""
    day = as_date(at)
    opened = F.col(start).isNull() | (F.col(start) <= day)
    still_open = F.col(end).isNull() | (F.col(end) >= day)
    return opened & still_open


def season_allows(month: Column | int, seasonality: str = "seasonality", null_kind_passes: bool = False) -> Column:
    """True unless the service is seasonal and the month is not listed.

    With ``null_kind_passes`` an absent kind counts as year round; without it
    an absent kind never passes.
    """
    kind = F.col(f"{seasonality}.kind")
    listed = F.coalesce(F.array_contains(F.col(f"{seasonality}.months"), month), F.lit(False))
    passes = (kind != "seasonal") | listed
    return F.coalesce(passes, F.lit(null_kind_passes))


def effective_date(at: str | Column | None, as_of: str | date | Column) -> Column:
    """The requested date when it is written ``YYYY-MM-DD``, else null; ``as_of`` when none is requested."""
    fallback = as_date(as_of)
    if at is None:
        return fallback
    asked = at if isinstance(at, Column) else F.lit(at)
    return F.when(asked.isNull(), fallback).when(asked.rlike(ISO_DATE), F.try_to_date(asked))


def release_id(as_of: Column, sequence: Column | int) -> Column:
    number = sequence if isinstance(sequence, Column) else F.lit(sequence)
    return F.concat(F.date_format(as_of, "yyyy.MM.dd"), F.lit("."), number.cast("string"))


def is_stale(valid_to: Column, now: Column) -> Column:
    """A condition is stale when its end cannot be read or has passed."""
    end = F.try_to_timestamp(valid_to)
    return end.isNull() | (now > end)


def whole_seconds_between(start: Column, end: Column) -> Column:
    """Rounded seconds; zero when reversed or unreadable."""
    micros = F.timestamp_diff("MICROSECOND", start, end)
    return F.when(micros >= 0, F.floor(micros / 1e6 + F.lit(0.5)).cast("long")).otherwise(F.lit(0).cast("long"))
