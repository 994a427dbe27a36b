"""Time arithmetic on zone-less UTC timestamps.

Every rule takes its clock as an ``as_of`` value, never the wall clock, so a
run can be repeated and compared.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_SECOND = 1_000_000
MICROS_PER_DAY = 86_400 * MICROS_PER_SECOND

Instant = datetime | str | Column


def instant(value: Instant) -> Column:
    """A ``timestamp_ntz`` column from a datetime, ISO text or column."""
    if isinstance(value, Column):
        return value
    if isinstance(value, datetime):
        value = value.isoformat(sep=" ")
    return F.lit(value).cast("timestamp_ntz")


def days(n: int) -> Column:
    return F.expr(f"INTERVAL '{int(n)}' DAY")


def micros_until(end: Column, as_of: Column) -> Column:
    """Microseconds between two zone-less timestamps.

    Taken from the interval's fields: ``timestampdiff`` would first move both
    values into the session time zone, where a day may have 23 hours.
    """
    left = end - as_of
    part = {n: F.extract(F.lit(n), left) for n in ("DAY", "HOUR", "MINUTE", "SECOND")}
    minutes = (part["DAY"].cast("long") * 24 + part["HOUR"]) * 60 + part["MINUTE"]
    return minutes * (60 * MICROS_PER_SECOND) + (part["SECOND"] * MICROS_PER_SECOND).cast("long")


def whole(numerator: Column, unit: int) -> Column:
    """Integer division that stays in 64-bit integers."""
    return F.call_function("div", numerator, F.lit(unit).cast("long"))


def _while_running(end: Column, as_of: Column, value: Column, to: str) -> Column:
    return F.when(end > as_of, value).otherwise(F.lit(0)).cast(to)


def seconds_remaining(end: Column, as_of: Column, rounding: str = "nearest") -> Column:
    """Seconds left until ``end``, 0 once it has passed.

    ``nearest`` rounds half up, ``floor`` cuts the fraction off.
    """
    lift = {"nearest": MICROS_PER_SECOND // 2, "floor": 0}[rounding]
    left = whole(micros_until(end, as_of) + F.lit(lift), MICROS_PER_SECOND)
    return _while_running(end, as_of, left, "long")


def days_remaining(end: Column, as_of: Column, mode: str = "floor") -> Column:
    """24-hour days left until ``end``, whole (``floor``) or started (``ceil``);
    0 once it has passed."""
    if mode == "floor":
        left = F.extract(F.lit("DAY"), end - as_of)
    elif mode == "ceil":
        left = whole(micros_until(end, as_of) + F.lit(MICROS_PER_DAY - 1), MICROS_PER_DAY)
    else:
        raise ValueError(f"unknown days mode {mode!r}")
    return _while_running(end, as_of, left, "int")


def countdown_parts(end: Column, as_of: Column) -> dict[str, Column]:
    """Days, hours, minutes and seconds left, each 0 once ``end`` has passed."""
    left = seconds_remaining(end, as_of, "floor")
    return {
        "days": whole(left, 86_400).cast("int"),
        "hours": whole(left % 86_400, 3_600).cast("int"),
        "minutes": whole(left % 3_600, 60).cast("int"),
        "seconds": (left % 60).cast("int"),
    }


def _epoch() -> Column:
    return instant("1970-01-01 00:00:00")


def from_epoch(seconds: Column) -> Column:
    """Epoch seconds to a UTC timestamp, whatever the session time zone."""
    return F.timestamp_add("SECOND", seconds, _epoch())


def from_epoch_micros(micros: Column) -> Column:
    return F.timestamp_add("MICROSECOND", micros, _epoch())


def epoch_micros(ts: Column) -> Column:
    return micros_until(ts, _epoch())


def date_text(ts: Column) -> Column:
    return ts.cast("date").cast("string")
