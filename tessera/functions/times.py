"""Dates and times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def plus(c: Column, interval: str) -> Column:
    return c + F.expr(f"interval {interval}")


def day_start(c: Column) -> Column:
    return F.date_trunc("day", c)


def day_end(c: Column) -> Column:
    """The last millisecond of the day."""
    return plus(plus(day_start(c), "1 day"), "-1 millisecond")


def month_end(c: Column) -> Column:
    return plus(F.add_months(F.date_trunc("month", c), 1).cast("timestamp_ntz"), "-1 millisecond")


def week_start(c: Column) -> Column:
    """Monday at midnight."""
    return F.date_trunc("week", c)


def half(c: Column) -> Column:
    return F.when(F.hour(c) < 12, "AM").otherwise("PM")


def half_start(c: Column) -> Column:
    return F.when(F.hour(c) < 12, day_start(c)).otherwise(plus(day_start(c), "12 hours"))


def half_end(c: Column) -> Column:
    """11:59:59.999 or 23:59:59.999."""
    return plus(plus(half_start(c), "12 hours"), "-1 millisecond")


def half_point(day: Column, part: Column, begin: bool) -> Column:
    """The start or end of a half day as written in forms: an afternoon ends at 23:59:00, a morning at 11:59:59."""
    at = day.cast("timestamp_ntz")
    am, pm = ("0 seconds", "12 hours") if begin else ("'11:59:59' hour to second", "'23:59:00' hour to second")
    return F.when(part == "AM", plus(at, am)).when(part == "PM", plus(at, pm))


def next_half(c: Column) -> Column:
    """The start of the half day after."""
    return plus(half_start(c), "12 hours")


def previous_half_end(c: Column) -> Column:
    return plus(half_start(c), "-1 millisecond")


def slices(start: Column, end: Column, days: int = 29) -> Column:
    """array<struct<from, to>> in epoch seconds: slices of ``days`` days that share their ends."""
    a, b = F.unix_seconds(start.cast("timestamp")), F.unix_seconds(end.cast("timestamp"))
    step = days * 86_400
    return F.transform(F.sequence(a, F.greatest(a, b - 1), F.lit(step).cast("long")), lambda x: F.struct(x.alias("from"), F.least(x + step, b).alias("to")))


def over_24h(day: Column, clock: Column) -> Column:
    """A day plus a clock time that may pass midnight, as 31:00."""
    h, m = F.split(clock, ":")[0].cast("int"), F.split(clock, ":")[1].cast("int")
    return day.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), h, m, F.lit(0))


def seconds_of_day(c: Column) -> Column:
    return F.hour(c) * 3600 + F.minute(c) * 60 + F.floor(F.second(c)).cast("int")


def clock_seconds(clock: Column) -> Column:
    return F.split(clock, ":")[0].cast("int") * 3600 + F.split(clock, ":")[1].cast("int") * 60


def within_clock(c: Column, span: Column) -> Column:
    """Strictly inside HH:mm-HH:mm; an end marked 次日 is on the next day."""
    a, b = F.split(span, "-")[0], F.split(span, "-")[1]
    end = clock_seconds(F.replace(b, F.lit("次日"), F.lit(""))) + F.when(b.startswith("次日"), 86_400).otherwise(0)
    s = seconds_of_day(c)
    return ((s > clock_seconds(a)) & (s < end)) | ((s + 86_400 > clock_seconds(a)) & (s + 86_400 < end))


def minutes_between(a: Column, b: Column) -> Column:
    """Whole minutes from a to b, cut towards zero."""
    return F.timestamp_diff("MINUTE", a, b)


def duration(amount: Column, unit: Column) -> Column:
    """Seconds of an amount of days or hours."""
    return F.when(unit == "DAY", amount * 86_400).otherwise(amount * 3600)


# Names of days from Sunday on.
DAYS = ("星期日", "星期一", "星期二", "星期三", "星期四", "星期五", "星期六")


def weekday_name(c: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, DAYS)), F.dayofweek(c))


def leave_days(first: Column, first_half: Column, last: Column, last_half: Column) -> Column:
    """Days from one half day to another, both included; null where a half is not known or the end lies before."""
    position = lambda h: F.when(h == "AM", 0).when(h == "PM", 1)
    halves = 2 * F.datediff(last, first) + position(last_half) - position(first_half) + 1
    return F.when(halves > 0, halves / 2)


def lunch(c: Column) -> Column:
    """The end of the lunch break: later from June to September."""
    return F.when(F.month(c).between(6, 9), "13:30").otherwise("13:00")


def free_slot(start: Column, end: Column, conflicts: Column) -> Column:
    """struct<start, end> of an interval cut by conflicts array<struct<start, end>> in order of their start; null where nothing is left.

    A conflict that covers a start moves it to the conflict's end, one that covers an end moves that to its start.
    """
    state = F.struct(start.alias("start"), end.alias("end"))

    def cut(s: Column, c: Column) -> Column:
        covers_start = (c["start"] <= s["start"]) & (c["end"] > s["start"])
        covers_end = (c["start"] < s["end"]) & (c["end"] >= s["end"])
        return F.struct(F.when(covers_start, F.least(c["end"], s["end"])).otherwise(s["start"]).alias("start"), F.when(covers_end & ~covers_start, F.greatest(c["start"], s["start"])).otherwise(s["end"]).alias("end"))

    out = F.aggregate(F.array_sort(conflicts), state, cut)
    return F.when(out["start"] < out["end"], out)
