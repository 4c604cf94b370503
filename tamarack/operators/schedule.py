"""When scheduled work is due: the next time a cron line fires, in column expressions.

A line's fields become sets of bits. The next time is found by first-set-bit searches: a later minute of this hour, a
later hour of this day, or the first hour and minute of the next day that is set. The days of a month are one set too: days of
the month and days of the week, laid out over the month from its first weekday.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamarack.functions.binding import once

# Least and greatest value of a cron line's fields in order, and the names that stand for values.
FIELDS = (("minute", 0, 59), ("hour", 0, 23), ("day", 1, 31), ("month", 1, 12), ("weekday", 0, 7))
NAMES = {
    "month": ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"),
    "weekday": ("sun", "mon", "tue", "wed", "thu", "fri", "sat"),
}
#: Months searched: eight years hold every day that there is, the last of February of a leap year too.
MONTHS = 97
_FIELD = r"^(\*|\d+(-\d+)?)(/[1-9]\d*)?(,(\*|\d+(-\d+)?)(/[1-9]\d*)?)*$"


def _bits(text: Column, low: int, high: int) -> Column:
    """Set of the values of one field: lists of ``*``, ``a``, ``a-b``, each with ``/step``; null for anything else or out of range."""
    part = lambda item, i: F.get(F.split(item, "/"), F.lit(i))
    bound = lambda item, i: F.get(F.split(part(item, 0), "-"), F.lit(i)).try_cast("int")
    stepped = lambda item: part(item, 1).isNotNull()
    first = lambda item: F.coalesce(bound(item, 0), F.lit(low))
    last = lambda item: F.coalesce(bound(item, 1), F.when(bound(item, 0).isNull() | stepped(item), high).otherwise(bound(item, 0)))
    step = lambda item: F.coalesce(part(item, 1).try_cast("int"), F.lit(1))
    fits = lambda item: (first(item) >= low) & (last(item) <= high) & (first(item) <= last(item))
    one = lambda item: F.when(fits(item), F.aggregate(F.sequence(first(item), F.when(fits(item), last(item)).otherwise(first(item)), step(item)), F.lit(0).cast("long"), lambda got, v: got.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), v))))
    return F.when(text.rlike(_FIELD), F.aggregate(F.split(text, ","), F.lit(0).cast("long"), lambda got, item: got.bitwiseOR(one(item))))


def parsed(cron: Column) -> Column:
    """{minute, hour, day, month, weekday: sets of bits, either: whether a day may match by either day field}; null for a line that is none."""
    parts = F.split(F.lower(F.trim(cron)), r"\s+")
    sets = {}
    for i, (name, low, high) in enumerate(FIELDS):
        text = F.get(parts, F.lit(i))
        for value, word in enumerate(NAMES.get(name, ()), low):
            text = F.regexp_replace(text, rf"\b{word}\b", str(value))
        sets[name] = _bits(text, low, high)
    # Sunday is 0 and 7
    sets["weekday"] = sets["weekday"].bitwiseOR(F.shiftright(sets["weekday"], 7)).bitwiseAND(F.lit(127).cast("long"))
    whole = lambda i: F.get(parts, F.lit(i)).startswith("*")
    known = F.size(parts) == 5
    for bits in sets.values():
        known = known & bits.isNotNull()
    return F.when(known, F.struct(*[bits.alias(name) for name, bits in sets.items()], (~whole(2) & ~whole(4)).alias("either")))


def _first_from(bits: Column, least: Column) -> Column:
    """The least value in a set that is ``least`` or more, null for none."""
    rest = F.call_function("shiftleft", F.call_function("shiftright", bits, least), least)
    return F.when(rest != 0, F.bit_count(rest.bitwiseAND(-rest) - F.lit(1).cast("long")))


def _days(at: Column, first: Column) -> Column:
    """Set of the days of the month of ``first`` (its first day) on which a parsed line fires."""
    shift = lambda how, x, by: F.call_function(how, x, by)
    weekday = (F.dayofweek(first) - 1).cast("int")
    week = shift("shiftright", at["weekday"], weekday).bitwiseOR(shift("shiftleft", at["weekday"], 7 - weekday)).bitwiseAND(F.lit(127).cast("long"))
    by_week = F.lit(0).cast("long")
    for start in range(1, 32, 7):
        by_week = by_week.bitwiseOR(F.shiftleft(week, start))
    length = shift("shiftleft", F.lit(2).cast("long"), F.dayofmonth(F.last_day(first))) - F.lit(2).cast("long")
    both = F.when(at["either"], at["day"].bitwiseOR(by_week)).otherwise(at["day"].bitwiseAND(by_week))
    return F.when(shift("shiftright", at["month"], F.month(first)).bitwiseAND(F.lit(1).cast("long")) == 1, both.bitwiseAND(length)).otherwise(F.lit(0).cast("long"))


def with_next_fire(rows: DataFrame, cron: str, after: str, name: str = "next_fire", zone: str = "UTC") -> DataFrame:
    """Adds when the line in ``cron`` fires next, later than the timestamp in ``after``; both are told by the clock of ``zone``.

    Null for a line that cannot be read, that never fires (the 30th of February) or without a time. Where both day fields
    are given a day counts if either holds. Seconds do not count. The session's time zone has to be UTC.
    """
    local = F.from_utc_timestamp(after, zone)
    # reading a line costs more than the search, and lines are few beside rows
    lines = rows.select(F.col(cron).alias("__line")).distinct().select("__line", parsed(F.col("__line")).alias("__at"))
    when = once(F.struct(F.col("__at").alias("at"), F.date_trunc("minute", local).alias("last")), lambda x: _next(x["at"], x["last"]))
    return rows.join(lines, F.col(cron) == F.col("__line"), "left").withColumn(name, F.to_utc_timestamp(when, zone)).drop("__line", "__at")


def _ahead(at: Column, month: Column, low: int, high: int) -> Column:
    """The first day on which a line fires in the ``low``-th to ``high``-th month after ``month``, null for none."""
    days = lambda m: once(F.add_months(month, m), lambda first: F.date_add(first, _first_from(_days(at, first), F.lit(1)) - 1))
    return F.get(F.filter(F.transform(F.sequence(F.lit(low), F.lit(high)), days), lambda d: d.isNotNull()), F.lit(0))


def _next(at: Column, last: Column) -> Column:
    """The next time after the minute ``last`` at which a parsed line fires."""
    minute_now = _first_from(at["minute"], F.minute(last) + 1)
    hour_now = F.when(_first_from(at["hour"], F.hour(last)) == F.hour(last), minute_now)
    hour_later = _first_from(at["hour"], F.hour(last) + 1)
    month = F.trunc(last, "MM")
    first_hour, first_minute = _first_from(at["hour"], F.lit(0)), _first_from(at["minute"], F.lit(0))
    same_day = F.coalesce(F.hour(last) * 60 + hour_now, hour_later * 60 + first_minute)

    def by_days(days: Column) -> Column:
        today = F.call_function("shiftright", days, F.dayofmonth(last)).bitwiseAND(F.lit(1).cast("long")) == 1
        later = _first_from(days, F.dayofmonth(last) + 1)
        now = F.when(today, same_day)
        # months are searched only where this one has no day left, and the far ones only where the near ones have none
        far = F.coalesce(*[_ahead(at, month, low, high) for low, high in ((1, 2), (3, 12), (13, MONTHS))])
        day = F.when(now.isNotNull(), F.to_date(last)).when(later.isNotNull(), F.date_add(month, later - 1)).otherwise(far)
        return F.timestamp_seconds(F.unix_timestamp(day.cast("timestamp")) + 60 * F.coalesce(now, first_hour * 60 + first_minute))

    return once(_days(at, month), by_days)


def tick(jobs: DataFrame, now: Column, zone: str = "UTC") -> DataFrame:
    """``jobs`` (name, cron, last_run) after one look at the clock, with ``due``: a time it fires at lies after its last run and not after ``now``.

    A job that is due has run now. A job without a last run is not due, its clock starts now, so nothing is made up for.
    Several missed times are one. A line that cannot be read is never due.
    """
    rows = with_next_fire(jobs.drop("due"), "cron", "last_run", "__next", zone)
    due = F.coalesce(F.col("__next") <= now, F.lit(False))
    return rows.withColumn("due", due).withColumn("last_run", F.when(F.col("last_run").isNull() | F.col("due"), now).otherwise(F.col("last_run"))).drop("__next")
