"""Clock and calendar expressions over minutes since midnight."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from diurna.schemas import MINUTES_PER_DAY


def clock_to_minutes(clock: Column) -> Column:
    """'HH:MM' -> minutes since midnight."""
    parts = F.split(clock, ":")
    return parts[0].cast("int") * 60 + parts[1].cast("int")


def minutes_to_clock(minutes: Column) -> Column:
    """Minutes -> 'HH:MM', with ' (+Nd)' when the value lies N days later.

    Fractions are cut towards zero; negative minutes wrap into the day before
    and carry no suffix. NULL stays NULL.
    """
    whole = minutes.cast("long")
    day = F.floor(whole / F.lit(MINUTES_PER_DAY))
    minute = F.pmod(whole, F.lit(MINUTES_PER_DAY))
    text = F.format_string("%02d:%02d", F.floor(minute / F.lit(60)), F.pmod(minute, F.lit(60)))
    return F.when(whole.isNull(), F.lit(None)).when(
        day > 0, F.concat(text, F.format_string(" (+%dd)", day))
    ).otherwise(text)


def weekday_of(day_index: Column) -> Column:
    """0 = Monday; day 0 is a Monday."""
    return F.pmod(day_index, F.lit(7)).cast("int")


def next_weekday(weekday: Column) -> Column:
    return ((weekday + 1) % 7).cast("int")


def is_school_day(weekday: Column) -> Column:
    return weekday.between(0, 4)


def is_weekend_day(weekday: Column) -> Column:
    return weekday.isin(5, 6)


def minutes_until(now: Column, hour: Column, minute: Column) -> Column:
    """Minutes from ``now`` (timestamp without zone) to the next hh:mm.

    The very instant counts as 0 minutes; a passed one means tomorrow's. NULL
    for an hour outside 0-23 or a minute outside 0-59 (callers reject those
    rows, see :func:`valid_clock`).
    """
    day_micros = F.lit(24 * 3600 * 1_000_000)
    midnight = F.date_trunc("day", now).cast("timestamp_ntz")
    since_midnight = F.timestamp_diff("MICROSECOND", midnight, now)
    target = (hour.cast("long") * 60 + minute.cast("long")) * F.lit(60_000_000)
    ahead = target - since_midnight
    wait = F.when(ahead < 0, ahead + day_micros).otherwise(ahead)
    return F.when(valid_clock(hour, minute), wait / F.lit(60_000_000.0))


def valid_clock(hour: Column, minute: Column) -> Column:
    return hour.between(0, 23) & minute.between(0, 59)
