"""Best-effort reading of recorded timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracelight.functions.columns import let

# Accepted shapes. Separators of the date may be ':' or '-'.
STAMP = (
    r"^(\d{4})[:-](\d{2})[:-](\d{2})[ T](\d{2}):(\d{2})(?::(\d{2})(?:\.\d+)?)?"
    r"(Z|[+-]\d{2}:?\d{2})?$"
)
DATE = r"^(\d{4})-?(\d{2})-?(\d{2})$"
# Two ISO forms beyond these: an offset of whole hours, and week dates.
SHORT_OFFSET = r"^(\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?[+-]\d{2})$"
WEEK = r"^(\d{4})-?W(\d{2})(?:-?([1-7]))?$"


def whole(raw: Column) -> Column:
    text = F.trim(raw.cast("string"), F.lit(" \t\r\n"))
    offset = F.substring(text, -3, 1).isin("+", "-")
    return F.when(offset, F.regexp_replace(text, SHORT_OFFSET, "$1:00")).otherwise(text)


def week_day(text: Column) -> Column:
    """The date of an ISO week and day (Monday if no day is given); null for week numbers the year
    does not have."""
    year, week, day = (F.regexp_extract(text, WEEK, i).try_cast("int") for i in (1, 2, 3))
    fourth = F.when(text.rlike(WEEK), F.make_date(year, F.lit(1), F.lit(4)))
    monday = F.trunc(fourth, "week")
    found = F.date_add(monday, (week - 1) * 7 + F.coalesce(day, F.lit(1)) - 1)
    right = (week >= 1) & (F.extract(F.lit("YEAROFWEEK"), found) == year)
    return F.when(right, found.cast("timestamp"))


def _stamped(text: Column, rest: Column) -> Column:
    """The instant of a text of the shape STAMP, whose ``rest`` follows the minutes."""
    seconds = F.when(rest.startswith(":"), F.substring(rest, 2, 2)).otherwise("00")
    local = F.concat(
        F.substring(text, 1, 4), F.lit("-"), F.substring(text, 6, 2), F.lit("-"),
        F.substring(text, 9, 2), F.lit(" "), F.substring(text, 12, 5), F.lit(":"), seconds,
    ).try_cast("timestamp")

    def shifted(zone: Column) -> Column:
        minutes = (
            F.substring(zone, 2, 2).try_cast("int") * 60 + F.right(zone, F.lit(2)).try_cast("int")
        )
        shift = (
            F.when(zone.isin("", "Z"), 0).when(F.left(zone, F.lit(1)) == "-", -minutes).otherwise(minutes)
        )
        at = F.timestamp_micros(F.unix_micros(local) - shift.cast("long") * 60_000_000)
        return F.struct(at.alias("at"), (at.isNotNull() & (zone != "")).alias("zoned"))

    return let(F.regexp_replace(rest, "^[0-9:.]+", ""), shifted)


def reading(raw: Column) -> Column:
    """(at, zoned): the UTC instant of ``raw``, null when unreadable, and whether it names a zone.

    A time without a zone is placed as if UTC. A text is matched against each shape once; the
    fields of a stamp then lie at fixed places.
    """

    def plain(at: Column) -> Column:
        return F.struct(at.alias("at"), F.lit(False).alias("zoned"))

    def shaped(text: Column) -> Column:
        digits = F.replace(text, F.lit("-"), F.lit(""))
        day = F.concat(
            F.substring(digits, 1, 4), F.lit("-"), F.substring(digits, 5, 2), F.lit("-"), F.substring(digits, 7, 2)
        ).try_cast("timestamp")
        return (
            F.when(text.startswith("0000") | text.isNull(), plain(F.lit(None).cast("timestamp")))
            .when(text.rlike(STAMP), _stamped(text, F.substring(text, F.lit(17), F.length(text))))
            .when(text.rlike(DATE), plain(day))
            .when(text.rlike(WEEK), plain(week_day(text)))
            .otherwise(plain(F.lit(None).cast("timestamp")))
        )

    return let(whole(raw), shaped)


def tz_known(raw: Column) -> Column:
    """Whether a *readable* timestamp carries a zone; false for junk."""
    return F.coalesce(reading(raw)["zoned"], F.lit(False))


def instant(raw: Column) -> Column:
    """UTC timestamp; a time without a zone is placed as if UTC; null when unreadable."""
    return reading(raw)["at"]
