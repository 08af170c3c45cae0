"""Cleaning of strings, dates and fill values as column expressions; what is missing becomes null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The fill number of drifter files and MATLAB's day number of 1970-01-01.
FILL, EPOCH_DAY = -1e34, 719_529


def to_float(value: Column, default: float | None = None) -> Column:
    """Number of a string; the default where it isn't one or is NaN."""
    x = value.try_cast("double")
    return F.coalesce(F.when(~F.isnan(x), x), F.lit(default).cast("double"))


def cut(value: Column, most: int) -> Column:
    return F.substring(value, 1, most)


def drop_unit(value: Column, count: int) -> Column:
    """A string without its last ``count`` characters."""
    return F.when(F.length(value) > count, F.substring(value, F.lit(1), F.length(value) - count)).otherwise(F.when(value.isNotNull(), ""))


def drop_suffix(value: Column, suffix: str) -> Column:
    """A string without this very ending, if it has it."""
    return F.when(F.endswith(value, F.lit(suffix)), F.substring(value, F.lit(1), F.length(value) - len(suffix))).otherwise(value)


def unfill(value: Column, default: float | None = None) -> Column:
    """The default for the fill number, infinities and NaN."""
    bad = value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")) | (F.abs(value - FILL) < 1e30)
    return F.when(~bad, value).otherwise(F.lit(default).cast("double"))


def unfill_date(value: Column) -> Column:
    """Null for a date given as the fill number."""
    return F.when(F.abs(value - FILL) >= 1e30, value)


def missing(value: Column, *marks) -> Column:
    """Null for any of these marks of a missing value."""
    return F.when(~value.isin(*marks), value)


def ascii_only(value: Column) -> Column:
    return F.trim(F.regexp_replace(value, r"[^\x00-\x7F]", ""))


def heading(value: Column) -> Column:
    """Degrees of a coordinate like ``28.0N`` or ``94.8W``: south and west negative, anything else null."""
    number = F.regexp_extract(F.trim(value), r"^([0-9.]+)([NSEW])$", 1).try_cast("double")
    side = F.regexp_extract(F.trim(value), r"^([0-9.]+)([NSEW])$", 2)
    return F.when(side.isin("N", "E"), number).when(side.isin("S", "W"), -number)


def date_time(date: Column, time: Column, fmt: str | None = None) -> Column:
    """Timestamp of a date and a time string; null where they make none."""
    both = F.concat_ws(" ", date, time)
    return F.try_to_timestamp(both) if fmt is None else F.try_to_timestamp(both, F.lit(fmt))


def iso_time(value: Column) -> Column:
    """Timestamp of an ISO string with its zone dropped; null where it is none."""
    return F.try_to_timestamp(F.regexp_replace(F.trim(value), r"(Z|[+-][0-9]{2}:?[0-9]{2})$", ""))


def fraction_date(year: Column, month: Column, day: Column) -> Column:
    """Timestamp of a date whose day has a fraction, to the microsecond; null for no date."""
    whole = F.floor(day)
    base = F.try_make_timestamp(year.cast("int"), month.cast("int"), whole.cast("int"), F.lit(0), F.lit(0), F.lit(0))
    return F.timestamp_micros((F.unix_micros(base) + F.round((day - whole) * 86_400_000_000)).cast("long"))


def matlab_time(day: Column) -> Column:
    """Timestamp of a MATLAB day number, to the microsecond."""
    return F.timestamp_micros(F.round((day - EPOCH_DAY) * 86_400_000_000).cast("long"))


def seconds(time: Column) -> Column:
    """Seconds since 1970 of a timestamp, as a double."""
    return F.unix_micros(time.cast("timestamp")) / 1e6


def from_seconds(value: Column) -> Column:
    """Timestamp of whole seconds; fractions are cut off."""
    return F.timestamp_seconds(F.floor(value))


def drogue_on(lost: Column, time: Column, row: str = "row_idx") -> Column:
    """Whether the drogue is on: always, if its loss is unknown or not before the row's last time; else until the loss."""
    last = F.max(time).over(Window.partitionBy(row))
    return F.when(lost.isNull() | (lost >= last), True).otherwise(time < lost)


def number_in(name: Column, pattern: str) -> Column:
    """The digits that a pattern's first group finds in a name; null where it finds none."""
    return F.nullif(F.regexp_extract(name, pattern, 1), F.lit(""))


def flat(value: Column) -> Column:
    """Arrays in an array as one array."""
    return F.flatten(value)
