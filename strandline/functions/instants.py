"""Instants, keys and kinds out of dirty strings. All of it stays inside generated JVM code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_US = 86_400_000_000
DAY_S = 86_400


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nonblank(c: Column | str) -> Column:
    """True if the string is neither null, empty nor only spaces; never null."""
    return F.coalesce(F.trim(_col(c)) != "", F.lit(False))


def iso_instant(c: Column | str) -> Column:
    """The timestamp an ISO string names; without an offset it is UTC, whatever the session's zone. Unreadable: null."""
    s = F.trim(_col(c))
    zoned = s.rlike(r"([zZ]|[+-]\d{2}(:?\d{2})?)$")
    return F.when(zoned | ~s.contains(":"), s).otherwise(F.concat(s, F.lit("Z"))).try_cast("timestamp")


def micros(c: Column | str) -> Column:
    """Microseconds since the epoch, as a long."""
    return F.unix_micros(_col(c))


def epoch_day(us: Column) -> Column:
    """UTC day number of an instant in microseconds (floor, so right before 1970 too)."""
    return period_no(us, DAY_US).cast("int")


def period_no(us: Column, period_us: int) -> Column:
    """Number of the period that holds the instant, counted from the epoch; exact, since only a multiple is divided."""
    return ((us - F.pmod(us, F.lit(period_us).cast("long"))) / F.lit(period_us)).cast("long")


def day_string(day: Column) -> Column:
    return F.date_format(F.date_from_unix_date(day), "yyyy-MM-dd")


def plain_kind(c: Column | str) -> Column:
    """An event type without letter case, spaces, ``_``, ``-`` and ``.``."""
    return F.translate(F.lower(_col(c)), " _-.", "")


def plain_name(name: str) -> str:
    """``plain_kind`` of a string at hand."""
    return name.lower().translate(str.maketrans("", "", " _-."))


def joined_dims(c: Column | str) -> Column:
    """Non-null elements in order, joined by ``|``; an empty string for none or a null list."""
    return F.coalesce(F.array_join(_col(c), "|"), F.lit(""))
