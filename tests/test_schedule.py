"""Cron lines against a search minute by minute."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tamarack.operators import schedule


def values(text, low, high, names=()):
    out = set()
    for item in text.split(","):
        span, _, step = item.partition("/")
        if span == "*":
            a, b = low, high
        else:
            a, _, b = span.partition("-")
            a = names.index(a) + low if a in names else int(a)
            b = (names.index(b) + low if b in names else int(b)) if b else high if step else a
        out |= set(range(a, b + 1, int(step or 1)))
    return out


def by_minutes(line, last, most_days=3000):
    m, h, d, mo, w = line.lower().split()
    minutes, hours, days, months = values(m, 0, 59), values(h, 0, 23), values(d, 1, 31), values(mo, 1, 12, schedule.NAMES["month"])
    weekdays = {x % 7 for x in values(w, 0, 7, schedule.NAMES["weekday"])}
    either = not d.startswith("*") and not w.startswith("*")
    day = last.date()
    for _ in range(most_days):
        in_week = (day.weekday() + 1) % 7 in weekdays
        if day.month in months and ((day.day in days or in_week) if either else (day.day in days and in_week)):
            for hour in sorted(hours):
                for minute in sorted(minutes):
                    at = dt.datetime.combine(day, dt.time(hour, minute))
                    if at > last:
                        return at
        day += dt.timedelta(days=1)
    return None


LINES = (
    "* * * * *", "*/15 * * * *", "30 2 * * *", "0 9 * * 1-5", "0 0 31 * *", "15 6 29 2 *", "0 12 1,15 * 5", "59 23 * * 7", "5/20 */7 * * *", "0 0 1 jan *", "10-12,50 3-5 * feb,DEC sun,Wed", "0 0 30 2 *", "0 0 29 2 1", "7 7 7 7 7",
    "0 0 */10 * 0",
)


@pytest.mark.parametrize("seed", [1, 2])
def test_next_fire_by_minutes(spark, seed):
    rng = random.Random(seed)
    edges = [dt.datetime(2024, 2, 28, 23, 59, 59), dt.datetime(2024, 2, 29, 6, 15), dt.datetime(2023, 12, 31, 23, 59), dt.datetime(2024, 1, 31), dt.datetime(2024, 4, 30, 12, 0, 30), dt.datetime(2099, 12, 31, 23, 58)]
    times = edges + [dt.datetime(2020, 1, 1) + dt.timedelta(seconds=rng.randrange(10**8)) for _ in range(12)]
    rows = [(line, t) for line in LINES for t in times]
    got = schedule.with_next_fire(spark.createDataFrame(rows, "line string, t timestamp"), "line", "t").collect()
    assert {(r.line, r.t): r.next_fire for r in got} == {(line, t): by_minutes(line, t.replace(second=0, microsecond=0) if by_minutes(line, t) else t) for line, t in rows}


def test_lines_that_are_none(spark):
    lines = ["", "* * * *", "60 * * * *", "* 24 * * *", "* * 0 * *", "* * * 13 *", "* * * * 8", "a * * * *", "5-1 * * * *", "*/0 * * * *", "1,,2 * * * *", None, "* * * * * *"]
    got = schedule.with_next_fire(spark.createDataFrame([(x, dt.datetime(2024, 1, 1)) for x in lines], "line string, t timestamp"), "line", "t").collect()
    assert [r.next_fire for r in got] == [None] * len(lines)


def test_zone(spark):
    rows = [("0 9 * * *", dt.datetime(2024, 7, 1, 13, 59)), ("0 9 * * *", dt.datetime(2024, 1, 1, 14, 0))]
    got = [r.next_fire for r in schedule.with_next_fire(spark.createDataFrame(rows, "line string, t timestamp"), "line", "t", zone="America/Chicago").collect()]
    assert got == [dt.datetime(2024, 7, 1, 14), dt.datetime(2024, 1, 1, 15)]


def test_tick(spark):
    at = lambda h, m=0: dt.datetime(2024, 1, 1, h, m)
    jobs = spark.createDataFrame([("first", "0 2 * * *", None), ("missed", "0 2 * * *", at(1)), ("ran", "0 2 * * *", at(2)), ("often", "*/5 * * * *", at(1)), ("broken", "x", at(1))], "name string, cron string, last_run timestamp")
    got = {r.name: (r.due, r.last_run) for r in schedule.tick(jobs, F.lit(at(2, 30))).collect()}
    assert got == {"first": (False, at(2, 30)), "missed": (True, at(2, 30)), "ran": (False, at(2)), "often": (True, at(2, 30)), "broken": (False, at(1))}
    again = schedule.tick(schedule.tick(jobs, F.lit(at(2, 30))), F.lit(at(2, 31)))
    assert not any(r.due for r in again.collect())


def test_a_line_is_read_once_not_for_each_row(spark):
    rows = spark.range(100).selectExpr("id", "if(id % 2 = 0, '*/15 * * * *', '0 0 29 feb *') AS line", "timestamp'2024-01-01 00:07:00' AS ts")
    df = schedule.with_next_fire(rows, "line", "ts")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" in plan and "RLIKE" not in plan[: plan.index("Join")]
    assert {str(r.next_fire) for r in df.collect()} == {"2024-01-01 00:15:00", "2024-02-29 00:00:00"}
