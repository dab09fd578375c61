"""Time helpers.  The session time zone is UTC (see ``session.CORE_CONF``)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def day_string(epoch_s: Column | str, fmt: str = "yyyy/MM/dd") -> Column:
    """Epoch seconds -> day text, e.g. ``2015/08/01``."""
    return F.from_unixtime(F.col(epoch_s) if isinstance(epoch_s, str) else epoch_s, fmt)


def week_of_day_string(day: Column | str) -> Column:
    """ISO week (1..53) of a ``yyyy/MM/dd`` day text (years are not kept)."""
    c = F.col(day) if isinstance(day, str) else day
    return F.weekofyear(F.to_date(F.regexp_replace(c, "/", "-")))


def week_of_epoch_s(epoch_s: Column | str) -> Column:
    """ISO week of an epoch-seconds instant, without going through text."""
    c = F.col(epoch_s) if isinstance(epoch_s, str) else epoch_s
    return F.weekofyear(F.to_date(F.timestamp_seconds(c)))


def year_of_epoch_s(epoch_s: Column | str) -> Column:
    """The year that the instant's ISO week belongs to."""
    c = F.col(epoch_s) if isinstance(epoch_s, str) else epoch_s
    return F.extract(F.lit("YEAROFWEEK"), F.to_date(F.timestamp_seconds(c))).cast("int")


def week_of_epoch_ms(epoch_ms: Column | str) -> Column:
    """ISO week of an epoch-milliseconds instant (ms / 1000, whole seconds)."""
    c = F.col(epoch_ms) if isinstance(epoch_ms, str) else epoch_ms
    return week_of_epoch_s(F.floor(c / 1000))
